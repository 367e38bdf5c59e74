"""Parsers of scoreboard and roster strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """``MM:SS`` with seconds under 60, or ``S.t`` under 60, in seconds; anything else is null."""
    minutes, seconds = (F.regexp_extract(text, r"^([0-9]{1,2}):([0-5][0-9])\z", i) for i in (1, 2))
    tenths = F.regexp_extract(text, r"^([0-9]{1,2}\.[0-9])\z", 1)
    short = F.when(tenths != "", F.when(F.expr("true"), tenths)).cast("double")
    return F.when(minutes != "", F.nullif(minutes, F.lit("")).cast("double") * 60 + F.nullif(seconds, F.lit("")).cast("double")).when(short < 60, short)


def period(text: Column) -> Column:
    """A digit 1 to 4, alone or with an ending (``ST``, ``ND``, ``RD``, ``TH``, or ``87``, as ``TH`` is misread), ``OT`` for 5, ``nOT`` for 4 + n; anything else is null."""
    up = F.upper(F.trim(text))
    part = lambda pattern: F.nullif(F.regexp_extract(up, pattern, 1), F.lit("")).cast("int")
    return F.when(up == "OT", 5).otherwise(F.coalesce(part(r"^([1-4])(?:ST|ND|RD|TH|87)?\z"), part(r"^([1-9])OT\z") + 4))


def jersey_number(text: Column) -> Column:
    """One or two ASCII digits, kept as a string ("0" and "00" differ); anything else is null."""
    return F.when(text.rlike(r"^[0-9]{1,2}\z"), text)


def clock_label(seconds: Column) -> Column:
    """``M:SS`` from a minute upward, ``S.t`` below it."""
    whole = F.floor(seconds)
    return F.when(seconds >= 60, F.concat_ws(":", F.floor(whole / 60).cast("string"), F.lpad((whole % 60).cast("string"), 2, "0"))).when(seconds >= 0, F.format_string("%.1f", F.floor(seconds * 10) / 10))


def track_key(text: Column) -> tuple[Column, Column]:
    """``"segment:track"`` as its two numbers; null where it isn't one."""
    return tuple(F.nullif(F.regexp_extract(text, r"^([0-9]+):([0-9]+)\z", i), F.lit("")).cast("long") for i in (1, 2))


def observation_id(run: Column, frame: Column, n: Column) -> Column:
    return F.concat_ws(":", run, frame.cast("string"), n.cast("string"))


def roster_subject(text: Column) -> tuple[Column, Column]:
    """Team and number of a ``roster:team:number`` subject; null for anonymous ones."""
    return tuple(F.nullif(F.regexp_extract(text, r"^roster:(.+):([0-9]{1,2})\z", i), F.lit("")) for i in (1, 2))


def canonical_sha256(value: Column) -> Column:
    """SHA-256 of a map or struct as JSON with its keys in order: maps are sorted, structs are written as declared, nulls kept."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def without_private(value: Column) -> Column:
    """A map without the keys that begin with ``_``."""
    return F.map_filter(value, lambda k, _: ~F.startswith(k, F.lit("_")))


def merged(*maps: Column) -> Column:
    """Maps as one; of a key that several have the last one's value."""
    if len(maps) == 1:
        return maps[0]
    first, last = merged(*maps[:-1]), maps[-1]
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(last, k)), last)


def metric_at(document: Column, path: list[str]) -> Column:
    """A number deep in a JSON document; null where the path ends elsewhere, in a boolean, or in a number that isn't finite."""
    found = F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path))
    number = F.when(found.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"), found).cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def flattened(document: Column, depth: int = 3) -> Column:
    """A JSON document's values by dotted path, as a map of texts; nested documents down to ``depth``, deeper ones as JSON."""
    kind = "map<string,string>"

    def level(text: Column, left: int) -> Column:
        entries = F.map_entries(F.coalesce(F.from_json(text, kind), F.create_map().cast(kind)))
        if left == 1:
            return entries

        def one(e: Column) -> Column:
            below = F.transform(level(e["value"], left - 1), lambda b: F.struct(F.concat(e["key"], F.lit("."), b["key"]).alias("key"), b["value"].alias("value")))
            return F.when(F.startswith(e["value"], F.lit("{")), below).otherwise(F.array(e))

        return F.flatten(F.transform(entries, one))

    return F.map_from_entries(level(document, depth))


def path_stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*\z", "")


def path_suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)\z", 1))


def split_of(path: Column, splits: list[str]) -> Column:
    """The first folder of a relative path that names a split."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)))
    return F.get(F.filter(folders, lambda f: f.isin(*splits)), F.lit(0))


def ancestors(path: Column) -> Column:
    """The folders of a relative path, the nearest first, the root ("") last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def label(text: Column, most: int = 64) -> Column:
    """A trimmed name of 1 to ``most`` characters; else null."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean).between(1, most), clean)


def minutes_label(seconds: Column) -> Column:
    """``MM:SS.ff`` of a video time; null and negative times are 0."""
    s = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.format_string("%.2f", s - F.floor(s / 60) * 60), 5, "0"))


def game_clock_label(seconds: Column) -> Column:
    """``M:SS``, with tenths where there are any; a dash without a clock."""
    part = F.round((seconds - F.floor(seconds)) * 10).cast("int")
    text = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"), F.when(seconds % 1 != 0, F.concat(F.lit("."), part.cast("string"))).otherwise(""))
    return F.coalesce(text, F.lit("—"))


def period_label(period: Column, quarter: str = "Q", overtime: str = "OT") -> Column:
    return F.when(period <= 4, F.concat(F.lit(quarter), period.cast("string"))).otherwise(F.concat(F.lit(overtime), (period - 4).cast("string")))


def score_label(labels: list[tuple[str, str]], scores: Column) -> Column:
    """Team labels with their scores, a dash where there is none."""
    return F.concat_ws("  ·  ", *[F.concat(F.lit(f"{text} "), F.coalesce(scores[team].cast("string"), F.lit("—"))) for team, text in labels])
