"""Queries on the driver's tables, each with the DuckDB SQL that gives the same rows.

The tables stand in for tracking data: events are observations of a user's track,
orders and line items are labelled spans and readings, embeddings hold boxes.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playframe.functions import text
from playframe.operators import aggregates as agg
from playframe.operators import distance as dist
from playframe.operators import joins, matching, sequence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000
GAP = 12 * HOUR


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


EV = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"


@query(f"""
WITH {EV}, m AS (SELECT *, (us - lag(us) OVER w > {GAP} OR lag(us) OVER w IS NULL)::INT AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY us)::BIGINT - 1 AS island FROM m""")
def q_islands(spark, sf_dir):
    return sequence.islands(events(spark, sf_dir), ["user_id"], "us", GAP).select("event_id", "user_id", "island")


@query(f"""
WITH {EV}, m AS (SELECT *, (us - lag(us) OVER w > {GAP} OR lag(us) OVER w IS NULL)::INT AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us)::BIGINT - 1 AS island FROM m)
SELECT user_id, island, min(us) AS first, max(us) AS last, count(*) AS n FROM i GROUP BY ALL""")
def q_island_ranges(spark, sf_dir):
    return sequence.island_ranges(events(spark, sf_dir), ["user_id"], "us", GAP)


PAIRS = f"""
WITH {EV}, p AS (
  SELECT user_id, event_id, us / 3600e6 AS h, value AS x, (user_id % 15)::DOUBLE AS y, (us - lag(us) OVER w) / 3600e6 AS dt,
         sqrt((value - lag(value) OVER w) ** 2) AS step
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT *, CASE WHEN dt IS NULL THEN 'interval_start' WHEN dt > 12 THEN 'timestamp_gap' WHEN step IS NULL THEN 'missing_point' WHEN step > 40 * dt THEN 'implausible_speed' END AS reason FROM p)
"""


def event_pairs(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 3.6e9).alias("h"), F.col("value").alias("x"), (F.col("user_id") % 15).cast("double").alias("y"), "us")
    paired = dist.distance_pairs(rows.withColumn("t", F.col("us")), ["user_id"], "t", ("x", "y"), 12 * HOUR, 40 / HOUR)
    return paired.withColumn("dt", F.col("dt") / 3.6e9)


@query(PAIRS + "SELECT user_id, event_id, round(dt, 6) AS dt, CASE WHEN reason IS NULL THEN round(step, 6) END AS distance, reason FROM r")
def q_pair_distance(spark, sf_dir):
    return event_pairs(spark, sf_dir).select("user_id", "event_id", r6("dt"), r6("distance"), "reason")


@query(PAIRS + """, s AS (
SELECT user_id, sum(step) FILTER (reason IS NULL) AS distance, coalesce(sum(dt) FILTER (reason IS DISTINCT FROM 'interval_start'), 0) AS tracked,
       coalesce(sum(dt) FILTER (reason IS NULL), 0) AS measured, count(*) FILTER (reason IS NULL) AS n_pairs,
       count(*) FILTER (reason IS NOT NULL AND reason <> 'interval_start') AS n_excluded FROM r GROUP BY user_id)
SELECT user_id, round(distance, 6) AS distance, round(tracked, 6) AS tracked, round(measured, 6) AS measured, n_pairs, n_excluded,
       round(CASE WHEN tracked > 0 THEN measured / tracked END, 6) AS coverage,
       CASE WHEN n_pairs = 0 OR measured <= 0 THEN 'unavailable' WHEN measured < tracked - 1e-9 THEN 'partial' ELSE 'ok' END AS status FROM s""")
def q_subject_rollup(spark, sf_dir):
    totals = dist.subject_totals(event_pairs(spark, sf_dir), ["user_id"])
    return totals.select("user_id", r6("distance"), r6("tracked"), r6("measured"), "n_pairs", "n_excluded", r6("coverage"), "status")


@query(PAIRS + "SELECT user_id, reason, count(*) AS n FROM r WHERE reason <> 'interval_start' GROUP BY ALL")
def q_excluded_intervals(spark, sf_dir):
    return dist.excluded_intervals(event_pairs(spark, sf_dir), ["user_id"])


@query(f"""
WITH RECURSIVE {EV}, o AS (SELECT user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us, value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE value IS NOT NULL),
f AS (SELECT user_id, k, n, us, value AS v FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.n, o.us, f.v + (1 - exp(-(o.us - f.us) / {6.0 * HOUR})) * (o.value - f.v) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, round(v, 6) AS smoothed, n FROM f WHERE k = n""")
def q_distance_smoothed(spark, sf_dir):
    return sequence.smoothed(events(spark, sf_dir), ["user_id"], "us", "value", 6.0 * HOUR).select("user_id", r6("smoothed"), "n")


@query(f"""
WITH RECURSIVE {EV}, o AS (SELECT event_id, user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us, value) AS k FROM e WHERE value IS NOT NULL),
f AS (SELECT user_id, k, us, event_id, value AS v FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.us, o.event_id, f.v + (1 - exp(-(o.us - f.us) / {6.0 * HOUR})) * (o.value - f.v) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT event_id, round(v, 6) AS smooth_value FROM f""")
def q_smoothed_rows(spark, sf_dir):
    return sequence.smoothed_rows(events(spark, sf_dir), ["user_id"], "us", ["value"], 6.0 * HOUR).select("event_id", r6("smooth_value"))


@query(f"""
WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n, min(us) AS f FROM e GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c)
SELECT user_id, CASE WHEN n / votes >= 0.3 AND votes >= 3 THEN event_type END AS winner, round(CASE WHEN votes >= 3 THEN n / votes ELSE 0 END, 6) AS share, votes::BIGINT AS votes FROM b WHERE k = 1""")
def q_majority(spark, sf_dir):
    found = agg.majority(events(spark, sf_dir), ["user_id"], "event_type", "us", min_votes=3, min_share=0.3, strict=False)
    return found.select("user_id", "winner", r6("share"), "votes")


@query(f"""
WITH {EV}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us, event_id) AS attempt, count(*) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS own FROM e),
d AS (SELECT *, own >= 3 AND own >= 0.4 * attempt AS confirmed FROM c),
x AS (SELECT *, coalesce(bool_or(confirmed) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM d)
SELECT user_id, event_id, attempt, confirmed FROM x WHERE NOT done""")
def q_running_confirm(spark, sf_dir):
    return sequence.until_confirmed(events(spark, sf_dir), ["user_id"], "us", "event_type", 3, 0.4, "event_id").select("user_id", "event_id", "attempt", "confirmed")


@query(f"""
WITH {EV}, k AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM e),
s AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER b AS tb,
             first_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER a AS ta
      FROM k WINDOW b AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, coalesce(v, CASE WHEN us - tb <= {15 * HOUR} AND ta - us <= {15 * HOUR} THEN CASE WHEN bv = av THEN bv END
  WHEN us - tb <= {6 * HOUR} AND coalesce(ta - us > {15 * HOUR}, true) THEN bv WHEN ta - us <= {6 * HOUR} AND coalesce(us - tb > {15 * HOUR}, true) THEN av END) AS filled FROM s""")
def q_smooth_fill(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("event_type")))
    return sequence.smooth_fill(rows, ["user_id"], "us", "v", 15 * HOUR, 6 * HOUR).select("user_id", "event_id", "filled")


@query(f"""
WITH RECURSIVE {EV}, k AS (SELECT user_id, us, CASE WHEN event_type IN ('click', 'view') THEN 'a' WHEN event_type IN ('purchase', 'signup') THEN 'b' END AS v FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i,
        count(*) FILTER (v = 'a') OVER w AS na, count(*) FILTER (v = 'b') OVER w AS nb,
        first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0
      FROM k WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
f AS (SELECT user_id, i, us, v, v0 AS now, 0 AS episode FROM o WHERE i = 1
      UNION ALL SELECT o.user_id, o.i, o.us, o.v,
        CASE WHEN o.v <> f.now AND CASE o.v WHEN 'a' THEN o.na >= 3 AND o.nb = 0 ELSE o.nb >= 3 AND o.na = 0 END THEN o.v ELSE f.now END,
        f.episode + coalesce(o.v <> f.now AND CASE o.v WHEN 'a' THEN o.na >= 3 AND o.nb = 0 ELSE o.nb >= 3 AND o.na = 0 END, false)::INT
      FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, us, v, episode FROM f""")
def q_sustained_switch(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "a").when(F.col("event_type").isin("purchase", "signup"), "b")
    return sequence.switches(events(spark, sf_dir).withColumn("v", kind), ["user_id"], "us", "v")


@query(f"""
WITH {EV}, c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT c.event_id, c.user_id, CASE WHEN c.us - p.us <= {GAP} THEN p.value END AS held FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.us >= p.us""")
def q_asof_hold(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = joins.asof(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id"], "us", "value", GAP, "held")
    return found.select("event_id", "user_id", "held")


SPANS = f"WITH {EV}, s AS (SELECT event_id, user_id, event_type, us AS a, us + (value * {HOUR})::BIGINT AS z FROM e WHERE value > 0)"


def spans(spark, sf_dir):
    rows = events(spark, sf_dir).where("value > 0")
    return rows.select("event_id", "user_id", "event_type", F.col("us").alias("a"), (F.col("us") + F.round(F.col("value") * HOUR).cast("long")).alias("z"))


OVERLAP = SPANS + """, c AS (SELECT x.user_id, x.event_id AS click_id, y.event_id AS buy_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'purchase' AND x.a < y.z AND y.a < x.z AND x.z > x.a AND y.z > y.a)"""


def overlapping(spark, sf_dir):
    rows = spans(spark, sf_dir)
    side = lambda kind, p: rows.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("a").alias(f"{p}_a"), F.col("z").alias(f"{p}_z"))
    return joins.overlaps(side("click", "click"), side("purchase", "buy"), ["user_id"], ("click_a", "click_z"), ("buy_a", "buy_z"), 24 * HOUR).select("user_id", "click_id", "buy_id")


@query(OVERLAP + "SELECT * FROM c")
def q_interval_overlap(spark, sf_dir):
    return overlapping(spark, sf_dir)


@query(OVERLAP + "SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY click_id) = 1 AND count(*) OVER (PARTITION BY buy_id) = 1")
def q_unique_pair(spark, sf_dir):
    return joins.unique_pairs(overlapping(spark, sf_dir), ["click_id"], ["buy_id"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER w AS n_holders FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_partkey) QUALIFY count(*) OVER w > 1")
def q_collisions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return joins.collisions(rows, ["l_orderkey", "l_partkey"])


@query(SPANS + """, u AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT user_id, sum(greatest(z - greatest(a, coalesce(p, a)), 0))::BIGINT AS duration FROM u GROUP BY user_id""")
def q_union_duration(spark, sf_dir):
    return agg.union_duration(spans(spark, sf_dir), ["user_id"], "a", "z")


@query(SPANS + f"SELECT event_type, sum(greatest(0, least(z, {1705276800000000}) - greatest(a, {1704672000000000})))::BIGINT AS duration FROM s GROUP BY event_type")
def q_phase_durations(spark, sf_dir):
    return agg.clipped_durations(spans(spark, sf_dir), ["event_type"], "a", "z", 1704672000000000, 1705276800000000)


@query(f"""
WITH {EV} SELECT event_id, user_id, count(*) FILTER (event_type = 'click') OVER w AS votes, round(count(*) FILTER (event_type = 'click') OVER w / count(*) OVER w, 6) AS share
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {GAP} PRECEDING AND {GAP} FOLLOWING)""")
def q_window_contacts(spark, sf_dir):
    found = agg.window_votes(events(spark, sf_dir), ["user_id"], "us", F.col("event_type") == "click", GAP)
    return found.select("event_id", "user_id", "votes", r6("share"))


@query("""
WITH s AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
m AS (SELECT *, (o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR lag(k) OVER w IS NULL)::INT AS new FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY k) AS g FROM m)
SELECT o_custkey, o_orderstatus, min(k)::BIGINT AS first, max(k)::BIGINT + 1 AS last, count(*) AS n_spans FROM i GROUP BY o_custkey, g, o_orderstatus""")
def q_span_merge(spark, sf_dir):
    ranked = agg.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 1 << 30)
    rows = ranked.select("o_custkey", "o_orderstatus", F.col("rank").cast("long").alias("first"), (F.col("rank") + 1).cast("long").alias("last"))
    return sequence.merge_spans(rows, ["o_custkey"], "first", "last", ["o_orderstatus"])


@query(f"WITH {EV} SELECT event_id, user_id, round(sum(value) OVER w, 6) AS total, bool_or(value IS NOT NULL) OVER w AS measured FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)")
def q_cumulative_asof(spark, sf_dir):
    return sequence.cumulative(events(spark, sf_dir), ["user_id"], "us", "value").select("event_id", "user_id", r6("total"), "measured")


@query("""
SELECT conv_id, turn, role AS last_role, concat_ws('>', lag(role, 2) OVER w, lag(role) OVER w, role) AS roles FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lag(turn, 2) OVER w = turn - 2""")
def q_causal_windows(spark, sf_dir):
    found = sequence.contiguous_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", 3)
    return found.select("conv_id", "turn", F.col("role").alias("last_role"), F.concat_ws(">", "window").alias("roles"))


GRID = f"""
WITH {EV}, p AS (SELECT user_id, event_type, least(value, 28.0) AS x, (user_id % 15)::DOUBLE AS y, value AS w FROM e WHERE value IS NOT NULL),
g AS (SELECT event_type, greatest(0, least(27, floor(x / 28.0 * 28)))::INT AS cell_x, greatest(0, least(15, floor(y / 15.0 * 16)))::INT AS cell_y, sum(w) AS mass FROM p GROUP BY ALL)
"""


def event_grid(spark, sf_dir):
    rows = events(spark, sf_dir).where("value is not null").select("event_type", F.least("value", F.lit(28.0)).alias("x"), (F.col("user_id") % 15).cast("double").alias("y"), F.col("value").alias("w"))
    return agg.grid_mass(rows, ["event_type"], "x", "y", "w", (28.0, 15.0), (28, 16))


@query(GRID + "SELECT event_type, cell_x, cell_y, round(mass, 6) AS mass FROM g")
def q_grid_presence(spark, sf_dir):
    return event_grid(spark, sf_dir).select("event_type", "cell_x", "cell_y", r6("mass"))


@query(f"""
WITH {EV} SELECT greatest(0, least(2, floor(least(value, 28.0) / 28.0 * 3)))::INT AS cell_x, greatest(0, least(2, floor((user_id % 15)::DOUBLE / 15.0 * 3)))::INT AS cell_y, round(sum(value), 6) AS mass
FROM e WHERE value IS NOT NULL GROUP BY 1, 2""")
def q_zone_grid(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.least("value", F.lit(28.0)).alias("x"), (F.col("user_id") % 15).cast("double").alias("y"), "value").where("value is not null")
    return agg.grid_mass(rows, [], "x", "y", "value", (28.0, 15.0), (3, 3)).select("cell_x", "cell_y", r6("mass"))


@query(GRID + """, t AS (SELECT *, mass / sum(mass) OVER (PARTITION BY event_type) AS s FROM g)
SELECT cell_x, cell_y, round(coalesce(sum(s) FILTER (event_type = 'click'), 0) - coalesce(sum(s) FILTER (event_type = 'purchase'), 0), 6) AS difference FROM t GROUP BY 1, 2""")
def q_compare_shares(spark, sf_dir):
    return agg.share_difference(event_grid(spark, sf_dir), "event_type", "click", "purchase").select("cell_x", "cell_y", r6("difference"))


@query(GRID + """, kx AS (SELECT a.i::INT AS f, b.i::INT AS t, exp(-((a.i - b.i) ** 2) / (2 * 0.85 * 0.85)) AS k FROM range(28) a(i), range(28) b(i)),
ky AS (SELECT a.i::INT AS f, b.i::INT AS t, exp(-((a.i - b.i) ** 2) / (2 * 0.85 * 0.85)) AS k FROM range(16) a(i), range(16) b(i)),
nx AS (SELECT f, t, k / sum(k) OVER (PARTITION BY f) AS k FROM kx), ny AS (SELECT f, t, k / sum(k) OVER (PARTITION BY f) AS k FROM ky)
SELECT event_type, nx.t AS cell_x, ny.t AS cell_y, round(sum(mass * nx.k * ny.k), 6) AS density FROM g JOIN nx ON nx.f = cell_x JOIN ny ON ny.f = cell_y GROUP BY ALL""")
def q_density(spark, sf_dir):
    return agg.density(event_grid(spark, sf_dir), ["event_type"], (28, 16), 0.85).select("event_type", "cell_x", "cell_y", r6("density"))


MATRIX = [1.1, 0.2, 3.0, -0.1, 0.9, 1.0, 0.01, 0.02, 1.0]


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), w AS (SELECT *, 0.01 * x + 0.02 * y + 1.0 AS w FROM p)
SELECT vec_id, round((1.1 * x + 0.2 * y + 3.0) / w, 6) AS px, round((-0.1 * x + 0.9 * y + 1.0) / w, 6) AS py FROM w""")
def q_homography(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    x, y = (F.col("embedding")[i].cast("double") for i in (0, 1))
    px, py = agg.homography(x, y, MATRIX)
    return rows.select("vec_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


BOXES = """
WITH b AS (SELECT vec_id, vec_id // 20 AS frame, least(embedding[1], embedding[3])::DOUBLE AS x1, least(embedding[2], embedding[4])::DOUBLE AS y1,
                  greatest(embedding[1], embedding[3])::DOUBLE AS x2, greatest(embedding[2], embedding[4])::DOUBLE AS y2, embedding[5]::DOUBLE AS score FROM embeddings)
"""


def boxes(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("vec_id div 20").alias("frame"),
        F.least(e(0), e(2)).alias("x1"), F.least(e(1), e(3)).alias("y1"), F.greatest(e(0), e(2)).alias("x2"), F.greatest(e(1), e(3)).alias("y2"), e(4).alias("score"),
    )


@query(BOXES + """, p AS (SELECT a.frame, a.vec_id AS id_a, b.vec_id AS id_b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.frame = b.frame AND a.vec_id < b.vec_id)
SELECT frame, id_a, id_b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM p WHERE i > 0""")
def q_iou_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    side = lambda p: rows.select("frame", *[F.col(c).alias(f"{c}_{p}") for c in ("id", "x1", "y1", "x2", "y2")])
    pairs = side("a").join(side("b"), "frame").where("id_a < id_b and x1_a < x2_b and x1_b < x2_a and y1_a < y2_b and y1_b < y2_a")
    iou = agg.box_iou(*[[F.col(f"{c}_{p}") for c in ("x1", "y1", "x2", "y2")] for p in "ab"])
    return pairs.select("frame", "id_a", "id_b", F.round(iou, 6).alias("iou"))


@query(BOXES.replace("WITH b AS", "WITH RECURSIVE b AS") + """, pr AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, vec_id) AS r FROM b WHERE vec_id % 2 = 0), tr AS (SELECT * FROM b WHERE vec_id % 2 = 1),
o AS (SELECT a.frame, a.r, t.vec_id AS t, greatest(0, least(a.x2, t.x2) - greatest(a.x1, t.x1)) * greatest(0, least(a.y2, t.y2) - greatest(a.y1, t.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM pr a JOIN tr t ON a.frame = t.frame),
c AS (SELECT frame, r, t, i / (s - i) AS iou FROM o WHERE s > i AND i / (s - i) >= 0.1),
g AS (SELECT DISTINCT frame, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS t, NULL::DOUBLE AS iou FROM pr
  UNION ALL SELECT s.frame, s.r, CASE WHEN s.t IS NULL THEN s.taken ELSE list_append(s.taken, s.t) END, s.t, s.iou FROM (
    SELECT g.frame, g.r + 1 AS r, g.taken, arg_max(c.t, (c.iou, -c.t)) AS t, max(c.iou) AS iou FROM g JOIN pr ON pr.frame = g.frame AND pr.r = g.r + 1 LEFT JOIN c ON c.frame = g.frame AND c.r = g.r + 1 AND NOT list_contains(g.taken, c.t) GROUP BY g.frame, g.r, g.taken) s)
SELECT pr.frame, CASE WHEN t IS NULL THEN 'fp' ELSE 'tp' END AS outcome, vec_id AS prediction_id, t AS truth_id, round(iou, 6) AS iou FROM g JOIN pr ON pr.frame = g.frame AND pr.r = g.r
UNION ALL SELECT frame, 'fn', NULL, vec_id, NULL FROM tr WHERE vec_id NOT IN (SELECT t FROM g WHERE t IS NOT NULL)""")
def q_greedy_match(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    found = matching.greedy_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").drop("score"), "frame", 0.1)
    return found.select("frame", "outcome", "prediction_id", "truth_id", r6("iou"))


@query()
def q_assignment(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return matching.optimal_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").drop("score"), "frame", 0.1)


@query("""
WITH l AS (UNPIVOT (SELECT label, embedding[1]::DOUBLE AS v1, embedding[2]::DOUBLE AS v2, embedding[3]::DOUBLE AS v3 FROM embeddings) ON v1, v2, v3 INTO NAME name VALUE x),
c AS (SELECT label, name, quantile_disc(x, 0.5) AS centre FROM l GROUP BY ALL)
SELECT label, name, round(centre, 6) AS centre, round(quantile_disc(abs(x - centre), 0.5), 6) AS spread, count(*) AS n FROM l JOIN c USING (label, name) GROUP BY label, name, centre""")
def q_prototype(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"v{i + 1}") for i in range(3)])
    return agg.prototypes(rows, "label", ["v1", "v2", "v3"]).select("label", "name", r6("centre"), r6("spread"), "n")


@query(f"""
WITH {EV}, p AS (SELECT user_id, (us - 1704067200000000) / 8.64e10 / 30 AS t, value AS y FROM e WHERE value IS NOT NULL),
s AS (SELECT user_id, count(*) AS n, sum(t) AS s1, sum(t ** 2) AS s2, sum(t ** 3) AS s3, sum(t ** 4) AS s4, sum(y) AS y0, sum(t * y) AS y1, sum(t * t * y) AS y2 FROM p GROUP BY user_id),
d AS (SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS d FROM s)
SELECT user_id, n, round(CASE WHEN n >= 4 AND abs(d) > 1e-9 THEN (y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / d END, 4) AS a FROM d""")
def q_quadratic(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", ((F.col("us") - 1704067200000000) / 8.64e10 / 30).alias("t"), F.col("value").alias("y"))
    return agg.quadratic_fit(rows, ["user_id"], "t", "y").select("user_id", "n", F.round("a", 4).alias("a"))


SCORED = "WITH s AS (SELECT d.lang, d.source, l.quality = 1 AS truth, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id").select("lang", "source", (F.col("quality") == 1).alias("truth"), "n_chars")


COUNTS = "count(*) FILTER (truth AND p) AS tp, count(*) FILTER (NOT truth AND p) AS fp, count(*) FILTER (truth AND NOT p) AS fn"
RATIOS = "tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall"


@query(f"{SCORED}, c AS (SELECT {COUNTS} FROM (SELECT truth, n_chars >= 1000 AS p FROM s)) SELECT {RATIOS}, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c")
def q_prf(spark, sf_dir):
    return agg.precision_recall(scored(spark, sf_dir), [], F.col("truth"), F.col("n_chars") >= 1000).select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(f"{SCORED}, c AS (SELECT threshold, {COUNTS} FROM (SELECT threshold, truth, n_chars >= threshold AS p FROM s, (SELECT unnest(range(0, 5001, 100))::DOUBLE AS threshold)) GROUP BY threshold) SELECT threshold, {RATIOS} FROM c")
def q_pr_sweep(spark, sf_dir):
    found = agg.threshold_sweep(scored(spark, sf_dir), F.col("truth"), F.col("n_chars"), [float(t) for t in range(0, 5001, 100)])
    return found.select("threshold", "tp", "fp", "fn", r6("precision"), r6("recall"))


@query(f"""{SCORED}, c AS (SELECT lang, source, grouping(lang, source)::BIGINT AS level, {COUNTS} FROM (SELECT *, n_chars >= 1000 AS p FROM s) GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT lang, source, level, tp, fp, fn FROM c""")
def q_pr_groups(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("p", F.col("n_chars") >= 1000)
    n = lambda c: F.count(F.when(F.expr(c), 1))
    sets = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source")
    return sets.agg(F.grouping_id().alias("level"), n("truth and p").alias("tp"), n("not truth and p").alias("fp"), n("truth and not p").alias("fn"))


@query("SELECT o_orderpriority, o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)::INT AS rank FROM orders QUALIFY rank <= 10")
def q_rank_protocol(spark, sf_dir):
    from pyspark.sql import Window as W

    ranked = table(spark, sf_dir, "orders").withColumn("rank", F.dense_rank().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))))
    return ranked.where("rank <= 10").select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM lineitem QUALIFY rank <= 5")
def q_topk_stable(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return agg.first_per_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12")
def q_quota(spark, sf_dir):
    return agg.first_per_key(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 12).select("source", "doc_id")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, position::INT AS position FROM r WHERE n <= 7 OR position IN (SELECT round_even(i * (n - 1) / 6.0, 0)::BIGINT FROM range(7) t(i))""")
def q_even_sample(spark, sf_dir):
    return agg.even_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 7)


@query("""
WITH v AS (SELECT DISTINCT o_orderkey AS v FROM orders WHERE o_orderkey % 7 <> 3), g AS (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM v)
SELECT p + 1 AS first, v - 1 AS last, v - p - 1 AS n FROM g WHERE v - p > 1""")
def q_missing_ranges(spark, sf_dir):
    return sequence.missing_ranges(table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3"), "o_orderkey")


@query("SELECT md5(text) AS content_md5, count(DISTINCT source) AS n_splits, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def q_leakage(spark, sf_dir):
    return joins.leaks(table(spark, sf_dir, "documents"), F.col("text"), "source")


@query("""
WITH r AS (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN s END AS s_suppkey, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS lookup_status
FROM customer LEFT JOIN r ON c_nationkey = s_nationkey""")
def q_roster_lookup(spark, sf_dir):
    numbers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    return joins.lookup(numbers, table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("c_custkey", "s_suppkey", "lookup_status")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def q_allow_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return table(spark, sf_dir, "customer").join(allowed, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_reject_anti(spark, sf_dir):
    rejected = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(rejected, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH b AS (SELECT o_custkey AS k, max(struct_pack(s := o_totalprice, o := o_orderkey)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
c AS (SELECT o_custkey AS k, max(struct_pack(s := o_totalprice, o := o_orderkey)) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(b.k, c.k) AS o_custkey, CASE WHEN c.k IS NULL OR b.m.s >= c.m.s THEN b.m.s ELSE c.m.s END AS o_totalprice, CASE WHEN c.k IS NULL OR b.m.s >= c.m.s THEN b.m.o ELSE c.m.o END AS o_orderkey
FROM b FULL JOIN c ON b.k = c.k""")
def q_merge_best(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return joins.merge_best(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 60) || '.' || (o_orderkey % 10) ELSE (o_orderkey % 13) || ':' || lpad((o_orderkey % 70)::VARCHAR, 2, '0') END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9]{1,2}:[0-5][0-9]') THEN split_part(s, ':', 1)::DOUBLE * 60 + split_part(s, ':', 2)::DOUBLE
  WHEN regexp_full_match(s, '[0-9]{1,2}\\.[0-9]') AND s::DOUBLE < 60 THEN s::DOUBLE END AS clock_s FROM t""")
def q_parse_clock(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.concat_ws(".", (k % 60).cast("string"), (k % 10).cast("string"))).otherwise(F.concat_ws(":", (k % 13).cast("string"), F.lpad((k % 70).cast("string"), 2, "0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clock_seconds(s).alias("clock_s"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 END AS period FROM orders""")
def q_parse_period(spark, sf_dir):
    names = F.array(*map(F.lit, ["1ST", " 2nd", "3RD", "4TH", "OT", "2OT", "3ot", "HALF"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.period(names[(F.col("o_orderkey") % 8).cast("int")]).alias("period"))


@query("SELECT o_orderkey, CASE WHEN length((o_orderkey % 150)::VARCHAR) <= 2 THEN (o_orderkey % 150)::VARCHAR END AS number FROM orders")
def q_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.jersey_number((F.col("o_orderkey") % 150).cast("string")).alias("number"))


@query(f"""
WITH {EV} SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_tracks, count(*) FILTER (event_type = 'error') AS n_errors, count(value) AS n_values,
round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio, count(DISTINCT (user_id, event_type)) AS n_track_types FROM e""")
def q_health(spark, sf_dir):
    errors = F.count(F.when(F.col("event_type") == "error", 1))
    return events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_tracks"), errors.alias("n_errors"), F.count("value").alias("n_values"),
        F.round(errors / F.count(F.lit(1)), 6).alias("error_ratio"), F.countDistinct("user_id", "event_type").alias("n_track_types"),
    )


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def q_latency(spark, sf_dir):
    found = agg.latency(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return found.select("l_returnflag", "l_linestatus", "median", F.round("p95", 4).alias("p95"), F.round("mean", 4).alias("mean"), "n")


@query("""
WITH m AS (SELECT n_name AS metric, sum(c_acctbal) AS value, avg(c_acctbal) * 40 AS baseline FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
p(metric, rule, lim) AS (VALUES ('NATION_0', 'min', 1000.0), ('NATION_1', 'max', 1000.0), ('NATION_2', 'max_drop', 50000.0), ('NATION_3', 'max_ratio', 1.25), ('NOWHERE', 'min', 0.0))
SELECT p.metric, p.rule, coalesce(CASE p.rule WHEN 'min' THEN value >= lim WHEN 'max' THEN value <= lim WHEN 'max_drop' THEN baseline - value <= lim + 1e-12 WHEN 'max_ratio' THEN baseline > 0 AND value <= lim * baseline END, false) AS passed
FROM p LEFT JOIN m USING (metric)""")
def q_gate(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    metrics = joined.groupBy(F.col("n_name").alias("metric")).agg(F.sum("c_acctbal").alias("value"), (F.avg("c_acctbal") * 40).alias("baseline"))
    policy = [("NATION_0", "min", 1000.0), ("NATION_1", "max", 1000.0), ("NATION_2", "max_drop", 50000.0), ("NATION_3", "max_ratio", 1.25), ("NOWHERE", "min", 0.0)]
    return agg.gate(metrics, spark.createDataFrame(policy, "metric string, rule string, limit double")).select("metric", "rule", "passed")


@query("""
SELECT 'nonpositive_quantity' AS rule, count(*) FILTER (l_quantity <= 0) AS n FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (l_discount < 0 OR l_discount > 1) FROM lineitem
UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orphan_line', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""")
def q_expectations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ranges = lines.agg(F.count(F.when(F.col("l_quantity") <= 0, 1)).alias("a"), F.count(F.when((F.col("l_discount") < 0) | (F.col("l_discount") > 1), 1)).alias("b"))
    ranges = ranges.select(F.expr("stack(2, 'nonpositive_quantity', a, 'discount_range', b) as (rule, n)"))
    repeated = lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("repeated_line").alias("rule"), F.count(F.lit(1)).alias("n"))
    orphans = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("orphan_line").alias("rule"), F.count(F.lit(1)).alias("n"))
    return ranges.unionByName(repeated).unionByName(orphans)
