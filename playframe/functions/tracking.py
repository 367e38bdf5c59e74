"""Rules over the columns of one observation: inclusion, identity, team, valid points, display.

Every rule takes and returns columns, so that it stays in generated code and can be
pushed to the scan where it only filters. A null argument is missing evidence and
never counts as agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far apart two team colours must be, and the pairs used where they aren't.
LEAST_COLOR_DISTANCE = 120.0


def run_keys(df: DataFrame) -> list[str]:
    """The columns that keep runs apart: ``run_id`` where a table holds it. Frame, track and segment numbers begin anew in every run."""
    return ["run_id"] if "run_id" in df.columns else []


def same_keys(keys: list[str]) -> Column:
    """Equal keys on both sides of a join, the right ones marked by an underscore."""
    on = F.lit(True)
    for c in keys:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return on


def between(t: Column, spans: Column) -> Column:
    """Whether ``t`` is in one of the half-open ``spans`` (array of structs ``start``, ``end``)."""
    return F.exists(spans, lambda s: (t >= s["start"]) & (t < s["end"]))


def included(t: Column, include: Column, exclude: Column) -> Column:
    """In an include span, or none is given, and in no exclude span."""
    return ((F.size(include) == 0) | between(t, include)) & ~between(t, exclude)


def crosses(before: Column, now: Column, boundaries: Column) -> Column:
    """Whether a boundary lies in (before, now]; false for a first row."""
    return F.coalesce(F.exists(boundaries, lambda b: (before < b) & (b <= now)), F.lit(False))


def identity(suppressed: Column, resolved_team: Column, resolved_number: Column, has_majority: Column, jersey_status: Column, jersey_identity: Column, jersey_team: Column, jersey_number: Column) -> Column:
    """The (team, number) a person may be named by, else null.

    Suppression voids everything; a resolved identity comes first; where a majority was
    voted on, whatever its outcome, a frame's own reading no longer counts; else a
    confirmed number that is unique in the roster does.
    """
    none = F.lit(None).cast("struct<team: string, number: string>")
    pair = lambda team, number: F.struct(team.cast("string").alias("team"), number.cast("string").alias("number"))
    own = (jersey_identity == "unique_number") & (jersey_status == "confirmed")
    named = F.when(resolved_team.isNotNull() & (resolved_team != "") & resolved_number.isNotNull(), pair(resolved_team, resolved_number))
    named = named.when(F.coalesce(has_majority, F.lit(False)), none).when(own, pair(jersey_team, jersey_number))
    return F.when(F.coalesce(suppressed, F.lit(False)), none).otherwise(named)


def team(conflict: Column, resolved_team: Column, has_group: Column, group_team: Column, has_majority: Column, jersey_status: Column, jersey_team: Column) -> Column:
    """The person's team: none under a colour conflict, then the resolved one, the group's if it was decided, and a confirmed jersey's."""
    rest = F.when(F.coalesce(has_group, F.lit(False)), group_team).when(F.coalesce(has_majority, F.lit(False)), None).when(jersey_status == "confirmed", jersey_team)
    known = F.when(resolved_team.isNotNull() & (resolved_team != ""), resolved_team).otherwise(rest)
    return F.when(F.coalesce(conflict, F.lit(False)), None).otherwise(known)


def anonymous(segment: Column, track: Column) -> Column:
    return F.concat(F.lit("anonymous-s"), segment.cast("string"), F.lit("-t"), track.cast("string"))


def subject(named: Column, segment: Column, track: Column) -> Column:
    """``roster:team:number`` of a (team, number) struct, else the track's anonymous name."""
    return F.coalesce(F.concat(F.lit("roster:"), named["team"], F.lit(":"), named["number"]), anonymous(segment, track))


def shown_number(suppressed: Column, resolved_number: Column, has_majority: Column, majority_number: Column, jersey_status: Column, jersey_number: Column, observed: Column) -> Column:
    """The number to display: resolved, voted, confirmed, and last the only one seen on the track."""
    own = F.when(jersey_status == "confirmed", jersey_number)
    rest = F.when(F.coalesce(has_majority, F.lit(False)), majority_number).otherwise(F.coalesce(own, observed))
    return F.when(F.coalesce(suppressed, F.lit(False)), None).otherwise(F.coalesce(resolved_number, rest))


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def on_court(x: Column, y: Column, length: Column, width: Column, status: Column, has_matrix: Column) -> Column:
    """Whether a person's position counts: a calibrated frame, and a finite point inside the court, edges included."""
    inside = finite(x) & finite(y) & (x >= 0) & (x <= length) & (y >= 0) & (y <= width)
    return F.coalesce(status.isin("fit", "propagated") & has_matrix & inside, F.lit(False))


def ball_usable(is_included: Column, status: Column, x: Column, y: Column, confidence: Column, width: Column, height: Column, least: float = 0.35) -> Column:
    """Whether the ball counts: included, status ok, finite, confident, inside the image, edges included."""
    seen = F.coalesce(is_included, F.lit(True)) & (status == "ok") & finite(x) & finite(y) & finite(confidence) & (confidence >= least)
    return F.coalesce(seen & (x >= 0) & (x <= width) & (y >= 0) & (y <= height), F.lit(False))


def rgb(color: Column) -> list[Column]:
    """The three channels of ``#RRGGBB``; null where the text isn't one."""
    text = F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), color)
    return [F.conv(F.substring(text, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def color_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(rgb(a), rgb(b), strict=True)), F.lit(0.0)))


def team_colors(a: Column, b: Column, default_a: str, default_b: str) -> tuple[Column, Column]:
    """The two display colours, or the default pair where the teams' own can't be told apart."""
    apart = color_distance(a, b) >= LEAST_COLOR_DISTANCE
    return F.when(apart, a).otherwise(default_a), F.when(apart, b).otherwise(default_b)


def person_color(role: Column, team_color: Column, group_color: Column, referee: str, unassigned: str) -> Column:
    """Referees and others have a colour of their own; players their team's, else their group's."""
    return F.when(role == "referee", referee).when(role != "player", unassigned).otherwise(F.coalesce(team_color, group_color, F.lit(unassigned)))


def hue_distance(kind_a: Column, hue_a: Column, kind_b: Column, hue_b: Column) -> Column:
    """Between two colour signatures (hue, dark or light): 180 for different kinds, else around the circle of 180 hues."""
    d = F.abs(hue_a - hue_b)
    return F.when(kind_a != kind_b, 180.0).when(kind_a != "hue", 0.0).otherwise(F.least(d, 180.0 - d))


def signature(hue: Column, saturation: Column, value: Column) -> Column:
    """Colour of a patch from the arrays of its pixels: struct ``kind``, ``hue``, or null for a mixed or unreadable one.

    Hue counts if 70 % of the pixels are coloured and 80 % of those are in the fullest
    of 18 bins or beside it; it is their circular mean. Else 70 % dark or light decide.
    """
    zero = F.lit(0.0)
    pixels = F.arrays_zip(hue.alias("h"), saturation.alias("s"), value.alias("v"))
    n = F.size(hue).cast("double")
    colored = F.filter(pixels, lambda p: (p["s"] >= 75) & (p["v"] >= 50))
    bins = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda b: F.size(F.filter(colored, lambda p: F.floor(p["h"] / 10) == b)))
    centre = (F.array_position(bins, F.array_max(bins)) - 1).cast("int")
    near = F.filter(colored, lambda p: F.pmod(F.floor(p["h"] / 10).cast("int") - centre + 1, F.lit(18)) <= 2)
    total = lambda f: F.aggregate(near, zero, lambda s, p: s + f(p["h"] * F.lit(2 * 3.141592653589793 / 180)))
    angle = F.atan2(total(F.sin), total(F.cos))
    turned = F.when(angle < 0, angle + F.lit(2 * 3.141592653589793)).otherwise(angle) * F.lit(180 / (2 * 3.141592653589793))
    share = lambda f: F.size(F.filter(pixels, f)) / n
    found = F.when((F.size(colored) / n >= 0.7) & (F.size(near) / F.size(colored) >= 0.8), F.struct(F.lit("hue").alias("kind"), turned.alias("hue")))
    found = found.when(share(lambda p: p["v"] <= 85) >= 0.7, F.struct(F.lit("dark").alias("kind"), zero.alias("hue")))
    return found.when(share(lambda p: (p["v"] >= 175) & (p["s"] <= 60)) >= 0.7, F.struct(F.lit("light").alias("kind"), zero.alias("hue")))
