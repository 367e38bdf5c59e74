"""From votes and readings to names: vote histograms, assignments, episodes, handoffs between tracks, lineups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.geometry import distance, foot_distance
from playframe.functions.tracking import run_keys, same_keys
from playframe.operators.aggregates import majority

TRACK = ["segment_id", "track_id"]
#: Fixed values of the handoff rule, in seconds, body heights and frames.
MAX_GAP, MAX_DISTANCE, BASE_DISTANCE, CROWD, LEAST_FRAMES, HEIGHT_RATIO = 0.20, 0.55, 0.35, 0.65, 4, 0.65


def histogram(votes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the votes as a map from value to count, their number, and the share of the leading value; nulls don't vote."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "_n")))).alias("counts"), F.sum("_n").alias("votes"), F.max("_n").alias("_top"))
    return rows.withColumn("share", F.col("_top") / F.col("votes")).drop("_top")


def observed_numbers(reads: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per track the one number ever read, or null and the list of ``conflicts`` where there are several."""
    rows = reads.where(F.col(number).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(number)).alias("_all"))
    one = F.size("_all") == 1
    return rows.select(*keys, F.when(one, F.element_at("_all", 1)).alias("number"), F.when(~one, F.col("_all")).alias("conflicts"))


def color_consensus(samples: DataFrame, keys: list[str], color: str, frame: str, least: int = 3, share: float = 0.9, span: int = 4) -> DataFrame:
    """Per episode the colour that holds ``share`` of at least ``least`` samples over at least ``span`` frames, else null."""
    rows = samples.where(F.col(color).isNotNull())
    counts = rows.groupBy(*keys, color).agg(F.count(F.lit(1)).alias("_n"), F.min(frame).alias("_a"), F.max(frame).alias("_z"))
    best = counts.groupBy(*keys).agg(F.sum("_n").alias("samples"), F.max(F.struct("_n", (-F.col("_a")).alias("_f"), color, "_a", "_z")).alias("_b"))
    fine = (F.col("samples") >= least) & (F.col("_b._n") / F.col("samples") >= share) & (F.col("_b._z") - F.col("_b._a") >= span)
    return best.select(*keys, F.when(fine, F.col(f"_b.{color}")).alias("consensus"), "samples")


def nearest_in_frames(left: DataFrame, right: DataFrame, keys: list[str], frame: str, value: str, reach: int = 8) -> DataFrame:
    """Every left row with ``nearest``: the right value at the closest frame within ``reach``, the earlier of two as close.

    Both sides lie in buckets of ``reach`` frames and meet in the same and the adjacent ones.
    """
    r = right.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(frame).alias("_f"), F.col(value).alias("_v")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_f") / reach) - 1, F.floor(F.col("_f") / reach) + 1)))
    rows = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", F.floor(F.col(frame) / reach))
    on = (F.col("_c") == F.col("_b")) & (F.abs(F.col("_f") - F.col(frame)) <= reach)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    met = rows.join(r, on, "left")
    near = F.min(F.when(F.col("_f").isNotNull(), F.struct(F.abs(F.col("_f") - F.col(frame)).alias("d"), "_f", "_v")))
    return met.groupBy("_id", *left.columns).agg(near.alias("_n")).select(*left.columns, F.col("_n._v").alias("nearest"))


def tracks_of(df: DataFrame) -> list[str]:
    """The key of a track: its number within a segment, within a run where there are several."""
    return [*run_keys(df), *TRACK]


def assignments(reads: DataFrame, roster: DataFrame, teams: DataFrame, colors: DataFrame, least_confidence: float = 0.8) -> DataFrame:
    """Per track the roster player it is: ``team, number, name, share, method``.

    Reads are (segment_id, track_id, frame_index, number, confidence), roster (team,
    number, name), teams (segment_id, track_id, team, mixed, counts: colour votes), colors
    (segment_id, track_id, frame_index, color). A number needs three confident reads and
    60 % of them. It goes to the track's team if that has the number. Without a team
    only a number of one player counts, with 90 %, three very confident frames over at
    least four, no very confident other number, and no colour but that team's. Colours
    at the frames of the reads must not contradict; on tracks of mixed colours they must
    agree.
    """
    track = tracks_of(reads)
    numbers = roster.select("number").distinct()
    kept = reads.where(F.col("confidence") >= least_confidence).join(numbers, "number", "left_semi")
    vote = majority(kept, track, "number", "frame_index", min_votes=3, min_share=0.6).where("winner is not null").select(*track, F.col("winner").alias("number"), "share")
    strong = kept.where("confidence >= 0.95").join(vote.select(*track, F.col("number").alias("_won")), track)
    sure = F.when(F.col("number") == F.col("_won"), F.col("frame_index"))
    strong = strong.groupBy(*track).agg(F.count_distinct(sure).alias("_frames"), (F.max(sure) - F.min(sure)).alias("_span"), F.max((F.col("number") != F.col("_won")).cast("int")).alias("_other"))
    local = nearest_in_frames(kept.join(vote.select(*track, "number"), [*track, "number"], "left_semi").select(*track, "frame_index"), colors, track, "frame_index", "color")
    local = majority(local, track, "nearest", "frame_index", min_votes=2, min_share=0.6).select(*track, F.col("winner").alias("_local"))
    candidates = roster.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy("number")))
    rows = vote.join(teams.withColumnsRenamed({"team": "_team"}), track, "left").join(strong, track, "left").join(local, track, "left").join(candidates, "number")
    seen = F.map_keys(F.map_filter(F.coalesce("counts", F.create_map().cast("map<string,bigint>")), lambda _, n: n > 0))
    single = (F.col("_same") == 1) & (F.col("share") >= 0.9) & (F.col("_frames") >= 3) & (F.col("_span") >= 4) & (F.col("_other") == 0) & (seen == F.array("team"))
    method = F.when(F.col("_team") == F.col("team"), "number_and_team").when(F.col("_team").isNull() & F.coalesce(single, F.lit(False)), "unique_number_corroborated")
    agrees = F.when(F.col("_local").isNotNull(), F.col("_local") == F.col("team")).otherwise(~F.coalesce("mixed", F.lit(False)))
    return rows.withColumn("method", method).where(F.col("method").isNotNull() & agrees).select(*track, "team", "number", "name", "share", "method")


def spans(persons: DataFrame) -> DataFrame:
    """Tracks cut where a frame is missing: adds ``span``, and one row per span from ``span_ends``."""
    from playframe.operators.sequence import islands

    return islands(persons.where("role = 'player' and track_id is not null"), tracks_of(persons), "frame_index", 1).withColumnRenamed("island", "span")


def span_ends(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Per span its first and last frame, time and box, its number of frames, and its colour: three votes with 80 % of them, else null."""
    track = tracks_of(rows)
    first, last = ((f(F.struct("frame_index", F.col("timestamp_s").alias("t"), F.col("box").alias("box")))) for f in (F.min, F.max))
    ends = rows.groupBy(*track, "span").agg(first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("frames"))
    own = rows.select(*track, "span", "frame_index").join(votes, [*track, "frame_index"])
    color = majority(own, [*track, "span"], "color", "frame_index", min_votes=3, min_share=0.8).select(*track, "span", F.col("winner").alias("color"))
    return ends.join(color, [*track, "span"], "left")


def direct_spans(rows: DataFrame, assigned: DataFrame, votes: DataFrame) -> DataFrame:
    """Frames that a track's player is known on: whole spans with five votes of the team's colour and none of another, where no other track of the player is in the frame."""
    track, runs = tracks_of(rows), run_keys(rows)
    own = rows.join(assigned, track).join(votes, [*track, "frame_index"], "left")
    w = W.partitionBy(*track, "span")
    same, other = F.sum((F.col("color") == F.col("team")).cast("int")).over(w), F.sum((F.col("color") != F.col("team")).cast("int")).over(w)
    pure = own.withColumn("_same", F.coalesce(same, F.lit(0))).withColumn("_other", F.coalesce(other, F.lit(0))).where("_same >= 5 and _other = 0")
    held = F.count(F.lit(1)).over(W.partitionBy(*runs, "segment_id", "frame_index", "team", "number"))
    return pure.withColumn("_n", held).where("_n = 1").select(*track, "span", "frame_index", "team", "number")


def crowded(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Of the persons ``at`` (segment_id, frame_index, track_id, box, team) those with another player within 0.65 body heights whose colour isn't known to be another team's."""
    runs = run_keys(rows)
    other = rows.select(*runs, "segment_id", "frame_index", F.col("track_id").alias("_k"), F.col("box").alias("_box"), F.col("color").alias("_color"))
    box = lambda c: [F.col(c)[i] for i in range(4)]
    near = (F.col("track_id") != F.col("_k")) & (foot_distance(box("box"), box("_box")) < CROWD) & (F.col("_color").isNull() | (F.col("_color") == F.col("team")))
    return at.join(other, [*runs, "segment_id", "frame_index"]).where(near).select(*at.columns).distinct()


def handoffs(ends: DataFrame, named: DataFrame, cuts: DataFrame, crowd: DataFrame) -> DataFrame:
    """Spans that go on as another span: ``segment_id, track_id, span, to_track, to_span, team, number, gap, distance``.

    ``ends`` are span ends, ``named`` (track, span, team, number) those with a player,
    ``cuts`` (segment_id, frame_index), ``crowd`` (segment_id, frame_index, track_id). The
    target begins within 0.2 s behind the source, its first feet at most 0.35 + gap, and
    0.55 at most, body heights from the source's last, with heights in a ratio of 0.65;
    its colour doesn't contradict, it has no name of its own and four frames; no cut and
    no crowd at either end. A source and a target with more than one partner have none,
    and links of one player that overlap in time are both dropped.
    """
    track, runs = tracks_of(ends), run_keys(ends)
    segment = [*runs, "segment_id"]
    source = ends.join(named, [*track, "span"]).where(F.col("color").isNull() | (F.col("color") == F.col("team")))
    target = ends.join(named, [*track, "span"], "left_anti").where(F.col("frames") >= LEAST_FRAMES)
    target = target.select(*segment, F.col("track_id").alias("to_track"), F.col("span").alias("to_span"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("color").alias("_color"))
    # Both ends are put into buckets of the longest gap: an end meets the begins of its own bucket and the next.
    source = source.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("last.t") / MAX_GAP), F.floor(F.col("last.t") / MAX_GAP) + 1)))
    met = source.join(target.withColumn("_bucket", F.floor(F.col("_first.t") / MAX_GAP)), [*segment, "_bucket"])
    gap = F.col("_first.t") - F.col("last.t")
    a, b = ([F.col(c)[i] for i in range(4)] for c in ("last.box", "_first.box"))
    heights = [x[3] - x[1] for x in (a, b)]
    away = foot_distance(a, b)
    rows = met.withColumn("gap", gap).withColumn("distance", away)
    rows = rows.where((F.col("gap") > 0) & (F.col("gap") <= MAX_GAP + 1e-9) & (F.col("track_id") != F.col("to_track")) & (F.col("distance") <= F.least(F.lit(MAX_DISTANCE), BASE_DISTANCE + F.col("gap"))))
    rows = rows.where((F.least(*heights) / F.greatest(*heights) >= HEIGHT_RATIO) & (F.col("_color").isNull() | (F.col("_color") == F.col("team"))))
    cut = cuts.select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("frame_index").alias("_cut"))
    rows = rows.join(cut, same_keys(segment) & (F.col("_cut") > F.col("last.frame_index")) & (F.col("_cut") <= F.col("_first.frame_index")), "left_anti")
    for who, frame in (("track_id", "last.frame_index"), ("to_track", "_first.frame_index")):
        c = crowd.select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("frame_index").alias("_f"), F.col("track_id").alias("_k"))
        rows = rows.join(c, same_keys(segment) & (F.col(frame) == F.col("_f")) & (F.col(who) == F.col("_k")), "left_anti")
    n = F.count(F.lit(1))
    rows = rows.withColumn("_from", n.over(W.partitionBy(*track, "span"))).withColumn("_to", n.over(W.partitionBy(*segment, "to_track", "to_span"))).where("_from = 1 and _to = 1")
    rows = rows.select(*track, "span", "to_track", "to_span", "team", "number", F.round("gap", 4).alias("gap"), F.round("distance", 4).alias("distance"), F.col("_first.t").alias("start"), F.col("_last.t").alias("end"))
    return without_overlaps(rows, [*segment, "team", "number"], "start", "end").drop("start", "end")


def without_overlaps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans that overlap no other of their keys, ends included: each against the latest end before it and the next start after it."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    clear = F.coalesce(before < F.col(start), F.lit(True)) & F.coalesce(F.lead(start).over(w) > F.col(end), F.lit(True))
    return rows.withColumn("_clear", clear).where("_clear").drop("_clear")


def referees_kept_apart(players: DataFrame, referees: DataFrame, frame: str, least: float = 0.6) -> DataFrame:
    """Players (``frame``, ``box``) without those whose box overlaps a referee's of the frame by ``least`` IoU."""
    from playframe.operators.aggregates import box_iou

    r = referees.select(F.col(frame).alias("_f"), F.col("box").alias("_box"))
    iou = box_iou([F.col("box")[i] for i in range(4)], [F.col("_box")[i] for i in range(4)])
    return players.join(r, (F.col(frame) == F.col("_f")) & (iou >= least), "left_anti")


def smoothed_roles(persons: DataFrame, frame: str, least: float = 0.6) -> DataFrame:
    """Adds ``smooth_role``: a player with a confident referee on the same place in the frame before and the one after is a referee."""
    from playframe.operators.aggregates import box_iou

    box = lambda c: [F.col(c)[i] for i in range(4)]
    rows = persons.withColumn("_id", F.monotonically_increasing_id())
    r = persons.where((F.col("role") == "referee") & (F.col("confidence") >= least)).select(F.col(frame).alias("_f"), F.col("box").alias("_box"))
    met = rows.where("role = 'player'").withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).join(r, F.col(frame) + F.col("_side") == F.col("_f"))
    both = met.where(box_iou(box("box"), box("_box")) >= least).groupBy("_id").agg(F.count_distinct("_side").alias("_n")).where("_n = 2").select("_id", F.lit("referee").alias("_role"))
    return rows.join(both, "_id", "left").withColumn("smooth_role", F.coalesce("_role", "role")).drop("_id", "_role")


def completed_lineups(known: DataFrame, lineups: DataFrame, keys: list[str]) -> DataFrame:
    """The one number that completes what is known of a team in a frame: ``known`` (keys, team, numbers) within exactly one lineup (team, players), one short of it."""
    met = known.join(lineups.withColumnRenamed("team", "_team"), F.col("team") == F.col("_team"))
    met = met.where(F.size(F.array_except("numbers", "players")) == 0).withColumn("_left", F.array_except("players", "numbers"))
    rows = met.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left"))
    return rows.where((F.col("_n") == 1) & (F.size("_left") == 1)).select(*keys, "team", F.element_at("_left", 1).alias("number"))


def lineup_changes(plays: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Substitutions read from play descriptions: ``incoming`` and ``outgoing`` of lines like "A enters the game for B"."""
    pattern = r"^(.+) enters the game for (.+)\z"
    rows = plays.where(F.col(text).rlike(pattern))
    return rows.select(*keys, order, F.trim(F.regexp_extract(text, pattern, 1)).alias("incoming"), F.trim(F.regexp_extract(text, pattern, 2)).alias("outgoing"))


def lineups_after(starters: DataFrame, subs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The players on court after each change: a player is on if his or her last event in ``order`` was coming in, starters before all."""
    first = starters.select(*keys, F.lit(None).cast(dict(subs.dtypes)[order]).alias("_at"), F.col("player"), F.lit(1).alias("_on"))
    moves = subs.select(*keys, F.col(order).alias("_at"), F.explode(F.array(F.struct(F.col("incoming").alias("player"), F.lit(1).alias("_on")), F.struct(F.col("outgoing").alias("player"), F.lit(0).alias("_on")))).alias("_m")).select(*keys, "_at", "_m.*")
    events = first.unionByName(moves)
    until = F.lead("_at").over(W.partitionBy(*keys, "player").orderBy(F.col("_at").asc_nulls_first()))
    stints = events.withColumn("_until", until).where("_on = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_at").alias("_from"), "_until", "player")
    on = (F.col("_from").isNull() | (F.col("_from") <= F.col(order))) & (F.col("_until").isNull() | (F.col("_until") > F.col(order)))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return subs.select(*keys, order).distinct().join(stints, on).groupBy(*keys, order).agg(F.sort_array(F.collect_set("player")).alias("players"))


def camera_links(first: DataFrame, second: DataFrame, keys: list[str], most: float = 0.5, margin: float = 0.12) -> DataFrame:
    """Bodies of one frame continued in the next: ``a_id, b_id, cost`` of rows (keys, id, x, y, height).

    The camera's shift, the median displacement of bodies to their nearest, is taken
    out first. A link costs its distance in body heights, up to ``most``, and must be
    the best of both its ends by ``margin``.
    """
    a, b = (df.select(*keys, F.col("id").alias(f"{s}_id"), F.col("x").alias(f"_{s}x"), F.col("y").alias(f"_{s}y"), F.col("height").alias(f"_{s}h")) for df, s in ((first, "a"), (second, "b")))
    met = a.join(b, keys)
    near = met.withColumn("_d", distance(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))).groupBy(*keys, "a_id").agg(F.min_by(F.struct((F.col("_bx") - F.col("_ax")).alias("x"), (F.col("_by") - F.col("_ay")).alias("y")), "_d").alias("_s"))
    shift = near.groupBy(*keys).agg(F.median("_s.x").alias("_sx"), F.median("_s.y").alias("_sy"))
    rows = met.join(shift, keys).withColumn("cost", distance(F.col("_ax") + F.col("_sx"), F.col("_ay") + F.col("_sy"), F.col("_bx"), F.col("_by")) / F.greatest("_ah", "_bh"))

    def clear(end: str) -> Column:
        w = W.partitionBy(*keys, end).orderBy("cost")
        return (F.row_number().over(w) == 1) & F.coalesce(F.lead("cost").over(w) - F.col("cost") >= margin, F.lit(True))

    rows = rows.withColumn("_a", clear("a_id")).withColumn("_b", clear("b_id"))
    return rows.where((F.col("cost") <= most) & F.col("_a") & F.col("_b")).select(*keys, "a_id", "b_id", "cost")
