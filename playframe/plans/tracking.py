"""Queries of the tracking operators: frames of eight persons made of the orders, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.operators import frames as fr
from playframe.operators import heatmaps, identity, observed, play, shots
from playframe.plans.bindings import query, r6, table

LENGTH, WIDTH = 32.0, 16.0

P = """p AS (
SELECT o_orderkey AS k, o_orderkey // 8000 AS run_id, o_orderkey // 8 AS frame_index, o_orderkey % 8 + 1 AS track_id, o_orderkey // 800 AS segment_id, (o_orderkey // 8)::DOUBLE / 10 AS timestamp_s,
  (o_orderkey // 8) % 97 <> 50 AS included, (o_orderkey // 8) % 250 = 170 AS scene_cut, CASE WHEN o_orderkey % 8 = 7 THEN 'referee' ELSE 'player' END AS role,
  CASE WHEN o_custkey % 19 <> 3 THEN 2 + 3 * (o_orderkey % 8 + 1) + ((o_orderkey // 8) % 40)::DOUBLE / 20 + (o_custkey % 10)::DOUBLE / 50 END AS x,
  CASE WHEN o_custkey % 19 <> 3 THEN 2 + o_orderkey % 8 + (o_custkey % 7)::DOUBLE / 40 END AS y,
  CASE WHEN o_custkey % 23 = 5 THEN 'box' ELSE 'feet' END AS ground_point_method, CASE WHEN o_custkey % 19 <> 3 THEN 'projected' ELSE 'outside_court' END AS position_status,
  CASE WHEN o_orderkey % 8 < 4 THEN 'a' ELSE 'b' END AS team, CASE WHEN o_custkey % 37 = 0 THEN '1' ELSE ((o_orderkey % 8 + 1) % 4)::VARCHAR END AS number, o_custkey % 11 <> 1 AS known, o_custkey AS c
FROM orders WHERE o_custkey % 29 <> 7)"""


def persons(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    frame, slot = F.floor(k / 8), k % 8
    seen = c % 19 != 3
    rows = table(spark, sf_dir, "orders").where("o_custkey % 29 <> 7")
    number = F.when(c % 37 == 0, "1").otherwise(((slot + 1) % 4).cast("string"))
    team = F.when(slot < 4, "a").otherwise("b")
    return rows.select(
        k.alias("k"), F.floor(k / 8000).alias("run_id"), frame.alias("frame_index"), (slot + 1).alias("track_id"), F.floor(k / 800).alias("segment_id"), (frame.cast("double") / 10).alias("timestamp_s"), (frame % 97 != 50).alias("included"),
        (frame % 250 == 170).alias("scene_cut"), F.when(slot == 7, "referee").otherwise("player").alias("role"),
        F.when(seen, 2 + 3 * (slot + 1) + (frame % 40).cast("double") / 20 + (c % 10).cast("double") / 50).alias("x"), F.when(seen, 2 + slot + (c % 7).cast("double") / 40).alias("y"),
        F.when(c % 23 == 5, "box").otherwise("feet").alias("ground_point_method"), F.when(seen, "projected").otherwise("outside_court").alias("position_status"),
        team.alias("team"), number.alias("number"), (c % 11 != 1).alias("known"), c.alias("c"), F.when(c % 11 != 1, F.struct(team.alias("team"), number.alias("number"))).alias("named"),
    )


CONTRIBUTIONS = f"""WITH {P}, q AS (SELECT *, known AND count(*) OVER (PARTITION BY frame_index, team, number, known) > 1 AS conflict FROM p WHERE role = 'player'),
s AS (SELECT *, CASE WHEN known AND NOT conflict THEN 'roster:' || team || ':' || number ELSE 'anonymous-s' || segment_id || '-t' || track_id END AS subject FROM q WHERE included),
l AS (SELECT *, lag(frame_index) OVER w AS pf, lag(timestamp_s) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(ground_point_method) OVER w AS pm, lag(subject) OVER w AS ps, lag(conflict) OVER w AS pc
  FROM s WINDOW w AS (PARTITION BY segment_id, track_id ORDER BY frame_index)),
d AS (SELECT *, coalesce(pf = frame_index - 1, false) AS joined, timestamp_s - pt AS dt, sqrt((x - px) ** 2 + (y - py) ** 2) AS step FROM l),
r AS (SELECT *, CASE WHEN NOT joined THEN 'interval_start' WHEN subject <> ps OR conflict OR pc THEN 'identity_transition_or_conflict' WHEN dt > 0.2 THEN 'timestamp_gap' WHEN step IS NULL THEN position_status
  WHEN ground_point_method <> pm THEN 'ground_point_method_change' WHEN step > 12 * dt THEN 'implausible_speed' END AS reason FROM d),
g AS (SELECT *, coalesce(lag(frame_index) OVER (PARTITION BY run_id, subject, segment_id, track_id ORDER BY frame_index) < frame_index - 1, false) AS gap FROM r)
"""


def contributions(spark, sf_dir):
    return observed.contributions(persons(spark, sf_dir), tau=0, deadband=0)


@query(CONTRIBUTIONS + """, t AS (SELECT run_id, subject, sum(step) FILTER (reason IS NULL) AS distance, sum(CASE WHEN joined AND ps = subject THEN dt ELSE 0 END) AS tracked, coalesce(sum(dt) FILTER (reason IS NULL), 0) AS measured,
  count(*) FILTER (reason IS NULL) AS pairs, count(DISTINCT (segment_id, track_id)) AS n_tracks FROM g GROUP BY run_id, subject)
SELECT run_id, subject, round(distance, 6) AS distance, round(tracked, 6) AS tracked, round(measured, 6) AS measured, pairs, n_tracks, round(CASE WHEN tracked > 0 THEN measured / tracked END, 6) AS coverage,
  CASE WHEN pairs = 0 THEN 'unavailable' WHEN measured < tracked - 1e-9 THEN 'partial' ELSE 'ok' END AS status FROM t""")
def q_distance_full(spark, sf_dir):
    found = observed.statistics(contributions(spark, sf_dir))
    return found.select("run_id", "subject", r6("distance"), r6("tracked"), r6("measured"), "pairs", F.size("tracks").cast("long").alias("n_tracks"), r6("coverage"), "status")


@query(CONTRIBUTIONS + """SELECT run_id, subject, reason, count(*) AS n FROM (SELECT run_id, subject, reason FROM g WHERE reason <> 'interval_start' UNION ALL SELECT run_id, subject, 'tracking_gap' FROM g WHERE gap) GROUP BY ALL""")
def q_distance_reasons(spark, sf_dir):
    return observed.statistics(contributions(spark, sf_dir)).select("run_id", "subject", F.explode("excluded").alias("reason", "n"))


@query(CONTRIBUTIONS + """SELECT run_id, subject, round(sum(step) FILTER (reason IS NULL), 6) AS distance, round(coalesce(sum(dt) FILTER (reason IS NULL), 0), 6) AS measured, max(frame_index) AS last_frame FROM g WHERE frame_index <= run_id * 1000 + 990 GROUP BY run_id, subject""")
def q_leaderboard_at(spark, sf_dir):
    return observed.metrics_at(contributions(spark, sf_dir), F.col("run_id") * 1000 + 990).select("run_id", "subject", r6("distance"), r6("measured"), "last_frame")


@query(CONTRIBUTIONS + """, t AS (SELECT run_id, subject, sum(step) FILTER (reason IS NULL) AS distance, sum(CASE WHEN joined AND ps = subject THEN dt ELSE 0 END) AS tracked, coalesce(sum(dt) FILTER (reason IS NULL), 0) AS measured FROM g GROUP BY run_id, subject)
SELECT split_part(subject, ':', 2) AS team, round(sum(distance), 6) AS distance, round(sum(measured), 6) AS measured, round(sum(measured) / sum(tracked), 6) AS coverage FROM t WHERE subject LIKE 'roster:%' GROUP BY 1""")
def q_player_card(spark, sf_dir):
    stats = observed.statistics(contributions(spark, sf_dir)).where("subject like 'roster:%'").withColumn("team", F.split("subject", ":")[1])
    return observed.player_card(stats, ["team"]).select("team", r6("distance"), r6("measured"), r6("coverage"))


FRAMES = f"""{P}, f AS (SELECT run_id, frame_index, any_value(timestamp_s) AS timestamp_s, any_value(segment_id) AS segment_id, any_value(scene_cut) AS scene_cut, any_value(included) AS included FROM p GROUP BY run_id, frame_index),
n AS (SELECT *, (scene_cut OR segment_id IS DISTINCT FROM lag(segment_id) OVER (PARTITION BY run_id ORDER BY frame_index))::INT AS new FROM f), plans AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY frame_index)::BIGINT - 1 AS plan FROM n)"""


def frame_table(spark, sf_dir):
    return persons(spark, sf_dir).select("run_id", "frame_index", "timestamp_s", "segment_id", "scene_cut", "included").distinct()


@query(f"WITH {FRAMES} SELECT run_id, frame_index, plan FROM plans")
def q_plans(spark, sf_dir):
    return heatmaps.plans(frame_table(spark, sf_dir)).select("run_id", "frame_index", "plan")


@query(f"""WITH {FRAMES} SELECT run_id, frame_index, sum((frame_index % 250 = 170)::INT) OVER (PARTITION BY run_id ORDER BY frame_index)::BIGINT AS run_segment, sum((frame_index % 250 = 170)::INT) OVER (ORDER BY frame_index)::BIGINT AS segment FROM f""")
def q_segments(spark, sf_dir):
    """Segments of the whole sequence of frames, and of each run."""
    runs = fr.segments(frame_table(spark, sf_dir), ["run_id"], F.col("scene_cut")).withColumnRenamed("segment", "run_segment")
    return fr.segments(runs, [], F.col("scene_cut")).select("run_id", "frame_index", "run_segment", "segment")


INTERVALS = f"""WITH {FRAMES}, q AS (SELECT p.*, plan, 'roster:' || team || ':' || number AS subject FROM p JOIN plans USING (run_id, frame_index) WHERE role = 'player'),
u AS (SELECT *, count(*) OVER (PARTITION BY frame_index, subject) AS same FROM q),
l AS (SELECT *, lag(frame_index) OVER w AS pf, lag(timestamp_s) OVER w AS pt, lag(included) OVER w AS pi, lag(subject) OVER w AS ps, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(ground_point_method) OVER w AS pm
  FROM u WHERE same = 1 WINDOW w AS (PARTITION BY run_id, plan, track_id ORDER BY frame_index)),
i AS (SELECT run_id, plan, track_id, frame_index, team, subject, pt AS start, timestamp_s AS "end", ground_point_method = pm AND sqrt((x - px) ** 2 + (y - py) ** 2) / (timestamp_s - pt) <= 12 AS sound, px, py, x, y
  FROM l WHERE pf = frame_index - 1 AND included AND pi AND timestamp_s - pt <= 0.2 + 1e-9 AND subject = ps),
j AS (SELECT run_id, plan, track_id, frame_index, team, subject, start, "end", CASE WHEN sound THEN px END AS x1, CASE WHEN sound THEN py END AS y1, CASE WHEN sound THEN x END AS x2, CASE WHEN sound THEN y END AS y2 FROM i)
"""


def heat_intervals(spark, sf_dir):
    rows = persons(spark, sf_dir).withColumn("subject", F.concat_ws(":", F.lit("roster"), "team", "number"))
    return heatmaps.intervals(rows.join(heatmaps.plans(frame_table(spark, sf_dir)).select("run_id", "frame_index", "plan"), ["run_id", "frame_index"]))


@query(INTERVALS + 'SELECT run_id, plan, track_id, frame_index, subject, round(start, 6) AS start, round("end", 6) AS "end", round(x1, 6) AS x1, round(y2, 6) AS y2 FROM j')
def q_heat_intervals(spark, sf_dir):
    return heat_intervals(spark, sf_dir).select("run_id", "plan", "track_id", "frame_index", "subject", r6("start"), r6("end"), r6("x1"), r6("y2"))


CLIPPED = INTERVALS + """, c AS (SELECT *, greatest(start, 3.05) AS a, least("end", 1e7) AS b FROM j WHERE greatest(start, 3.05) < least("end", 1e7)),
z AS (SELECT *, b - a AS seconds, x1 IS NOT NULL AS located, x1 + (a - start) / ("end" - start) * (x2 - x1) AS ax, y1 + (a - start) / ("end" - start) * (y2 - y1) AS ay,
  x1 + (b - start) / ("end" - start) * (x2 - x1) AS bx, y1 + (b - start) / ("end" - start) * (y2 - y1) AS byy FROM c)
"""


@query(CLIPPED + """, v AS (SELECT run_id, subject, a, b, max(b) OVER (PARTITION BY run_id, subject ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM z WHERE located),
w AS (SELECT run_id, subject, sum(greatest(0, b - greatest(a, coalesce(upto, a)))) AS video FROM v GROUP BY run_id, subject)
SELECT z.run_id, z.subject, round(sum(seconds), 6) AS observed, round(sum(seconds) FILTER (located), 6) AS localized, round(sum(seconds) FILTER (located) / sum(seconds), 6) AS coverage, round(any_value(video), 6) AS video
FROM z JOIN w USING (run_id, subject) GROUP BY z.run_id, z.subject""")
def q_heat_totals(spark, sf_dir):
    _, totals = heatmaps.heatmap(heat_intervals(spark, sf_dir), ["run_id", "subject"], 3.05, 1e7, LENGTH, WIDTH)
    return totals.select("run_id", "subject", r6("observed"), r6("localized"), r6("coverage"), r6("video"))


@query(CLIPPED + """, cn AS (SELECT run_id, team, seconds, ax, ay, bx, byy, greatest(1, ceil(sqrt((bx - ax) ** 2 + (byy - ay) ** 2) / 0.2))::INT AS n FROM z WHERE located),
s AS (SELECT run_id, team, seconds / n AS m, ax + (k + 0.5) / n * (bx - ax) AS px, ay + (k + 0.5) / n * (byy - ay) AS py FROM cn, unnest(range(n)) AS t(k))
SELECT run_id, team, least(2, floor(px / 32 * 3))::INT AS cell_x, least(2, floor(py / 16 * 3))::INT AS cell_y, round(sum(m), 5) AS mass FROM s GROUP BY ALL""")
def q_heat_zones(spark, sf_dir):
    grid, _ = heatmaps.heatmap(heat_intervals(spark, sf_dir), ["run_id", "team"], 3.05, 1e7, LENGTH, WIDTH, zones=True)
    return grid.select("run_id", "team", "cell_x", "cell_y", F.round("mass", 5).alias("mass"))


HALF = INTERVALS + """, hd AS (SELECT j.*, CASE plan % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS d FROM j),
tu AS (SELECT *, CASE d WHEN -1 THEN 32 - x1 WHEN 1 THEN x1 END - 16 AS ux, CASE d WHEN -1 THEN 32 - x2 WHEN 1 THEN x2 END - 16 AS vx, CASE d WHEN -1 THEN 16 - y1 WHEN 1 THEN y1 END AS uy, CASE d WHEN -1 THEN 16 - y2 WHEN 1 THEN y2 END AS vy FROM hd),
cr AS (SELECT *, CASE WHEN vx <> ux THEN -ux / (vx - ux) END AS cx FROM tu),
lh AS (SELECT *, CASE WHEN vx > ux THEN greatest(0, cx) ELSE 0 END AS lo, CASE WHEN vx < ux THEN least(1, cx) ELSE 1 END AS hi FROM cr WHERE NOT (vx = ux AND ux < 0)),
kp AS (SELECT *, (hi - lo) * ("end" - start) AS kept, ux + lo * (vx - ux) AS ax, uy + lo * (vy - uy) AS ay, ux + hi * (vx - ux) AS bx, uy + hi * (vy - uy) AS byy FROM lh WHERE hi >= lo)
"""


def half_intervals(spark, sf_dir):
    """Intervals of plans seen from either side, and every third plan without a direction."""
    plan = F.col("plan") % 3
    return heat_intervals(spark, sf_dir).withColumn("direction", F.when(plan == 0, 1).when(plan == 1, -1))


@query(HALF + """, hn AS (SELECT *, greatest(1, ceil(sqrt((bx - ax) ** 2 + (byy - ay) ** 2) / 0.2))::INT AS n FROM kp WHERE kept > 0),
s AS (SELECT run_id, team, kept / n AS m, ax + (k + 0.5) / n * (bx - ax) AS px, ay + (k + 0.5) / n * (byy - ay) AS py FROM hn, unnest(range(n)) AS t(k))
SELECT run_id, team, least(15, floor(px))::INT AS cell_x, least(15, floor(py))::INT AS cell_y, round(sum(m), 5) AS mass FROM s GROUP BY ALL""")
def q_heat_half(spark, sf_dir):
    grid, _ = heatmaps.heatmap(half_intervals(spark, sf_dir), ["run_id", "team"], 0.0, 1e7, LENGTH, WIDTH, half=True)
    return grid.select("run_id", "team", "cell_x", "cell_y", F.round("mass", 5).alias("mass"))


MOVED = CONTRIBUTIONS.rstrip() + INTERVALS[len("WITH ") + len(P) :].replace(", q AS", ", hq AS").replace("FROM q)", "FROM hq)").replace(", l AS", ", hl AS").replace("\n  FROM l WHERE", "\n  FROM hl WHERE").replace("\nl AS", "\nhl AS").replace("f AS (SELECT run_id", "hf AS (SELECT run_id").replace("FROM f)", "FROM hf)").replace("FROM l ", "FROM hl ")


@query(MOVED + """, mv AS (SELECT j.run_id, j.team, j.frame_index // 500 AS part, step FROM j JOIN g ON g.segment_id = j.frame_index // 100 AND g.track_id = j.track_id AND g.frame_index = j.frame_index WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND reason IS NULL AND g.subject = j.subject)
SELECT run_id, team, round(sum(step), 4) AS moved FROM mv GROUP BY ALL""")
def q_heat_movement(spark, sf_dir):
    found = heatmaps.with_distance(heat_intervals(spark, sf_dir), contributions(spark, sf_dir))
    grid, _ = heatmaps.heatmap(found, ["run_id", "team"], 0.0, 1e7, LENGTH, WIDTH, metric="movement", zones=True)
    return grid.groupBy("run_id", "team").agg(F.round(F.sum("mass"), 4).alias("moved"))


@query(CONTRIBUTIONS.replace("WITH p", "WITH RECURSIVE p", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY segment_id, track_id ORDER BY frame_index) AS i FROM g),
fl AS (SELECT segment_id, track_id, i, run_id, subject, x AS sx, y AS sy, x AS ax, y AS ay, NULL::DOUBLE AS d FROM o WHERE i = 1
  UNION ALL SELECT segment_id, track_id, i, run_id, subject, sx, sy, CASE WHEN reason IS NOT NULL THEN x WHEN st >= 0.025 THEN sx ELSE ax END, CASE WHEN reason IS NOT NULL THEN y WHEN st >= 0.025 THEN sy ELSE ay END, CASE WHEN reason IS NULL THEN CASE WHEN st >= 0.025 THEN st ELSE 0 END END
  FROM (SELECT *, sqrt((sx - ax) ** 2 + (sy - ay) ** 2) AS st FROM (SELECT o.segment_id, o.track_id, o.i, o.run_id, o.subject, o.reason, o.x, o.y, fl.ax, fl.ay,
    CASE WHEN reason IS NOT NULL THEN o.x ELSE fl.sx + (1 - exp(-o.dt / 0.12)) * (o.x - fl.sx) END AS sx, CASE WHEN reason IS NOT NULL THEN o.y ELSE fl.sy + (1 - exp(-o.dt / 0.12)) * (o.y - fl.sy) END AS sy
    FROM fl JOIN o ON o.segment_id = fl.segment_id AND o.track_id = fl.track_id AND o.i = fl.i + 1)))
SELECT run_id, subject, round(sum(d), 6) AS distance, count(d) AS pairs FROM fl GROUP BY ALL""")
def q_distance_filtered(spark, sf_dir):
    found = observed.contributions(persons(spark, sf_dir))
    return found.groupBy("run_id", "subject").agg(F.round(F.sum("distance"), 6).alias("distance"), F.count("distance").alias("pairs"))


@query(f"""WITH {P}, s AS (SELECT *, frame_index - row_number() OVER (PARTITION BY segment_id, track_id ORDER BY frame_index) AS g FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY segment_id, track_id, g) AS n FROM s) SELECT k FROM c WHERE known OR n >= 5""")
def q_visible(spark, sf_dir):
    return fr.visible(persons(spark, sf_dir), ["segment_id", "track_id"], F.col("known")).select("k")


@query(f"""WITH {FRAMES}, q AS (SELECT o_orderkey AS id, o_orderkey // 8000 AS run_id, o_orderkey // 8000 * 100 + o_totalprice / 5000 AS t FROM orders WHERE o_orderkey % 10 = 0), a AS (SELECT q.*, f.frame_index AS bf, f.timestamp_s AS bt FROM q ASOF LEFT JOIN f ON q.run_id = f.run_id AND q.t + 1e-6 >= f.timestamp_s),
b AS (SELECT a.*, f.frame_index AS af, f.timestamp_s AS at_ FROM a ASOF LEFT JOIN f ON a.run_id = f.run_id AND a.t + 1e-6 < f.timestamp_s)
SELECT run_id, round(t, 6) AS t, CASE WHEN bf IS NULL THEN af WHEN af IS NULL OR t - bt <= at_ - t THEN bf ELSE af END AS nearest, coalesce(bf, af) AS holding FROM b""")
def q_nearest_frame(spark, sf_dir):
    times = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.floor(F.col("o_orderkey") / 8000).alias("run_id"), (F.floor(F.col("o_orderkey") / 8000) * 100 + F.col("o_totalprice") / 5000).alias("t"))
    return fr.nearest_frames(times, frame_table(spark, sf_dir), ["run_id"], "t").select("run_id", r6("t"), "nearest", "holding")


EPISODES = f"e AS (SELECT segment_id, track_id, frame_index // 25 AS episode, min(frame_index) AS first, max(frame_index) - 2 AS last FROM p WHERE frame_index % 25 > 3 GROUP BY ALL)"


@query(f"WITH {P}, {EPISODES} SELECT p.k, e.episode FROM p LEFT JOIN e ON p.segment_id = e.segment_id AND p.track_id = e.track_id AND p.frame_index BETWEEN first AND last")
def q_in_episode(spark, sf_dir):
    rows = persons(spark, sf_dir).select("k", "segment_id", "track_id", "frame_index")
    spans = fr.first_and_last(rows.where("frame_index % 25 > 3").withColumn("episode", F.floor(F.col("frame_index") / 25)), ["segment_id", "track_id", "episode"], "frame_index")
    return fr.in_episode(rows, spans.withColumn("last", F.col("last") - 2), ["segment_id", "track_id"], "frame_index").select("k", "episode")


@query(f"WITH {P} SELECT k FROM p QUALIFY (frame_index - min(frame_index) OVER (PARTITION BY segment_id, track_id)) % 2 = 0")
def q_every_nth(spark, sf_dir):
    return fr.every_nth(persons(spark, sf_dir), ["segment_id", "track_id"], "frame_index", 2).select("k")


@query(f"""WITH {P}, r AS (SELECT k, segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY k) - 1 AS position, count(*) OVER (PARTITION BY segment_id) AS n FROM p)
SELECT segment_id, k, position::INT AS position FROM r WHERE n <= 9 OR position IN (SELECT (i * (n - 1)) // 8 FROM range(9) t(i))""")
def q_truncated_sample(spark, sf_dir):
    return fr.truncated_sample(persons(spark, sf_dir).select("segment_id", "k"), ["segment_id"], [F.col("k")], 9).select("segment_id", "k", "position")


@query(f"WITH {P} SELECT frame_index, team, k FROM p QUALIFY row_number() OVER (PARTITION BY frame_index, team ORDER BY c DESC, k) = 1")
def q_best_read(spark, sf_dir):
    return fr.best_of(persons(spark, sf_dir), ["frame_index", "team"], "c", "k").select("frame_index", "team", "k")


@query(f"WITH {P} SELECT frame_index, count(*) AS errors FROM p WHERE x IS NULL OR NOT known GROUP BY frame_index ORDER BY errors DESC, frame_index LIMIT 15")
def q_worst_frames(spark, sf_dir):
    return fr.worst_frames(persons(spark, sf_dir).where("x is null or not known"), "frame_index", 15)


@query(f"WITH {P} SELECT k FROM p WHERE frame_index BETWEEN 30 AND 59")
def q_page(spark, sf_dir):
    return fr.page(persons(spark, sf_dir), 30, 30).select("k")


@query(f"""WITH {P}, a AS (SELECT DISTINCT frame_index, track_id FROM p WHERE c % 5 <> 0), b AS (SELECT DISTINCT frame_index, track_id FROM p WHERE c % 3 <> 0)
SELECT *, 'first' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'second' FROM (FROM b EXCEPT FROM a)""")
def q_set_difference(spark, sf_dir):
    rows = persons(spark, sf_dir)
    return fr.set_difference(rows.where("c % 5 <> 0"), rows.where("c % 3 <> 0"), ["frame_index", "track_id"])


@query(f"WITH {P} SELECT frame_index FROM p WHERE track_id <= 3 AND c % 9 <> 0 GROUP BY frame_index HAVING count(DISTINCT track_id) = 3")
def q_common_targets(spark, sf_dir):
    return fr.common_targets(persons(spark, sf_dir).where("track_id <= 3 and c % 9 <> 0"), ["frame_index"], "track_id")


@query(f"""WITH {P}, i AS (SELECT DISTINCT frame_index, segment_id FROM p), b AS (SELECT frame_index, count(*) AS n FROM p WHERE c % 4 = 0 GROUP BY 1)
SELECT segment_id, count(*) AS images, coalesce(sum(n), 0)::BIGINT AS boxes, count(*) FILTER (n IS NULL) AS negatives FROM i LEFT JOIN b USING (frame_index) GROUP BY ROLLUP (segment_id)""")
def q_dataset_statistics(spark, sf_dir):
    rows = persons(spark, sf_dir)
    return fr.dataset_statistics(rows.select("frame_index", "segment_id").distinct(), rows.where("c % 4 = 0").select("frame_index"), "frame_index", "segment_id")


@query(f"WITH {P}, s AS (SELECT phase, first, last FROM (SELECT team AS phase, segment_id, min(frame_index) AS first, max(frame_index) AS last FROM p WHERE c % 7 = 0 GROUP BY team, segment_id)), "
       "x AS (SELECT DISTINCT phase, unnest(range(first, last + 1, 30)) AS frame_index FROM s) SELECT frame_index, string_agg(phase, ',' ORDER BY phase) AS phases FROM x GROUP BY 1")  # fmt: skip
def q_annotation_plan(spark, sf_dir):
    spans = persons(spark, sf_dir).where("c % 7 = 0").groupBy(F.col("team").alias("phase"), "segment_id").agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))
    return fr.annotation_plan(spans, 30).select("frame_index", F.array_join("phases", ",").alias("phases"))


@query(f"WITH {P}, c AS (SELECT segment_id, max(frame_index) AS cut FROM p WHERE scene_cut GROUP BY 1) SELECT k FROM p JOIN c USING (segment_id) WHERE frame_index < cut")
def q_resume_prefix(spark, sf_dir):
    return fr.prefix_before_cut(persons(spark, sf_dir), ["segment_id"]).select("k")


@query(f"""WITH {P}, v AS (SELECT segment_id, track_id, number, count(*) AS n FROM p GROUP BY ALL)
SELECT segment_id, track_id, string_agg(number || '=' || n, ',' ORDER BY number) AS counts, sum(n)::BIGINT AS votes, round(max(n) / sum(n), 6) AS share FROM v GROUP BY ALL""")
def q_vote_histogram(spark, sf_dir):
    found = identity.histogram(persons(spark, sf_dir), ["segment_id", "track_id"], "number")
    return found.select("segment_id", "track_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"), "votes", r6("share"))


@query(f"""WITH {P} SELECT segment_id, track_id, CASE WHEN count(DISTINCT number) = 1 THEN min(number) END AS number, CASE WHEN count(DISTINCT number) > 1 THEN string_agg(DISTINCT number, ',' ORDER BY number) END AS conflicts FROM p GROUP BY ALL""")
def q_observed_number(spark, sf_dir):
    found = identity.observed_numbers(persons(spark, sf_dir), ["segment_id", "track_id"], "number")
    return found.select("segment_id", "track_id", "number", F.array_join("conflicts", ",").alias("conflicts"))


COLORS = "o AS (SELECT frame_index // 10 AS episode, track_id, frame_index, CASE WHEN c % 13 = 0 THEN 'red' WHEN c % 5 < 2 THEN 'blue' WHEN c % 5 = 2 THEN NULL ELSE 'blue' END AS color FROM p)"


@query(f"""WITH {P}, {COLORS}, n AS (SELECT episode, track_id, color, count(*) AS n, min(frame_index) AS a, max(frame_index) AS z FROM o WHERE color IS NOT NULL GROUP BY ALL),
b AS (SELECT *, sum(n) OVER w AS samples, row_number() OVER (PARTITION BY episode, track_id ORDER BY n DESC, a) AS k FROM n WINDOW w AS (PARTITION BY episode, track_id))
SELECT episode, track_id, CASE WHEN samples >= 3 AND n / samples >= 0.9 AND z - a >= 4 THEN color END AS consensus, samples::BIGINT AS samples FROM b WHERE k = 1""")
def q_color_consensus(spark, sf_dir):
    c = F.col("c")
    color = F.when(c % 13 == 0, "red").when(c % 5 == 2, None).otherwise("blue")
    return identity.color_consensus(persons(spark, sf_dir).select(F.floor(F.col("frame_index") / 10).alias("episode"), "track_id", "frame_index", color.alias("color")), ["episode", "track_id"], "color", "frame_index")


@query(f"""WITH {P}, v AS (SELECT track_id, frame_index, number FROM p WHERE c % 6 = 0), l AS (SELECT k, track_id, frame_index FROM p WHERE c % 10 = 1),
m AS (SELECT l.k, v.number, row_number() OVER (PARTITION BY l.k ORDER BY abs(v.frame_index - l.frame_index), v.frame_index) AS i FROM l JOIN v ON v.track_id = l.track_id AND abs(v.frame_index - l.frame_index) <= 8)
SELECT l.k, m.number AS nearest FROM l LEFT JOIN m ON m.k = l.k AND i = 1""")
def q_nearest_vote(spark, sf_dir):
    rows = persons(spark, sf_dir)
    return identity.nearest_in_frames(rows.where("c % 10 = 1").select("k", "track_id", "frame_index"), rows.where("c % 6 = 0").select("track_id", "frame_index", "number"), ["track_id"], "frame_index", "number").select("k", "nearest")


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey % 40 AS who, epoch_us(o_orderdate) / 86400000000.0 AS a, epoch_us(o_orderdate) / 86400000000.0 + o_totalprice / 400000 AS b FROM orders)
SELECT k FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.who = s.who AND t.k <> s.k AND t.a <= s.b AND t.b >= s.a)""")
def q_without_overlaps(spark, sf_dir):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000.0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).alias("who"), day.alias("a"), (day + F.col("o_totalprice") / 400000).alias("b"))
    return identity.without_overlaps(rows, ["who"], "a", "b").select("k")


BOXES = f"""{P}, bx AS (SELECT k, frame_index, role, team, CASE WHEN c % 3 = 0 THEN 'referee' ELSE 'player' END AS kind, (c % 100) / 100.0 AS confidence, (c % 50)::DOUBLE AS x1, (c % 20)::DOUBLE AS y1, (c % 50 + 30 + c % 7)::DOUBLE AS x2, (c % 20 + 60 + c % 5)::DOUBLE AS y2 FROM p)"""
IOU = """greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * greatest(0, least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1))"""
OVER = f"""({IOU}) / (({{0}}.x2 - {{0}}.x1) * ({{0}}.y2 - {{0}}.y1) + ({{1}}.x2 - {{1}}.x1) * ({{1}}.y2 - {{1}}.y1) - {IOU})"""


def boxes(spark, sf_dir):
    c = F.col("c")
    box = F.array((c % 50).cast("double"), (c % 20).cast("double"), (c % 50 + 30 + c % 7).cast("double"), (c % 20 + 60 + c % 5).cast("double"))
    return persons(spark, sf_dir).select("k", "frame_index", F.when(c % 3 == 0, "referee").otherwise("player").alias("role"), ((c % 100) / 100).alias("confidence"), box.alias("box"), "team")


@query(f"WITH {BOXES} SELECT a.k FROM bx a WHERE a.kind = 'player' AND NOT EXISTS (SELECT 1 FROM bx r WHERE r.kind = 'referee' AND r.frame_index = a.frame_index AND {OVER.format('a', 'r')} >= 0.6)")
def q_roles_apart(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return identity.referees_kept_apart(rows.where("role = 'player'"), rows.where("role = 'referee'"), "frame_index").select("k")


@query(f"""WITH {BOXES} SELECT a.k, CASE WHEN a.kind = 'player' AND {' AND '.join(f"EXISTS (SELECT 1 FROM bx r WHERE r.kind = 'referee' AND r.confidence >= 0.6 AND r.frame_index = a.frame_index {s} 1 AND {OVER.format('a', 'r')} >= 0.6)" for s in '+-')}
THEN 'referee' ELSE a.kind END AS smooth_role FROM bx a""")
def q_smooth_roles(spark, sf_dir):
    return identity.smoothed_roles(boxes(spark, sf_dir), "frame_index").select("k", "smooth_role")


@query(f"""WITH {P}, k AS (SELECT frame_index, team, array_agg(DISTINCT number ORDER BY number) AS numbers FROM p WHERE c % 4 <> 0 GROUP BY ALL),
l(team, players) AS (VALUES ('a', ['0', '1', '2']), ('a', ['1', '2', '3']), ('b', ['0', '1', '2', '3'])),
m AS (SELECT frame_index, k.team, list_filter(players, lambda q: NOT list_contains(numbers, q)) AS rest FROM k JOIN l ON k.team = l.team AND len(list_filter(numbers, lambda q: NOT list_contains(players, q))) = 0)
SELECT frame_index, team, any_value(rest)[1] AS number FROM m GROUP BY frame_index, team HAVING count(*) = 1 AND len(any_value(rest)) = 1""")
def q_lineup_completion(spark, sf_dir):
    known = persons(spark, sf_dir).where("c % 4 <> 0").groupBy("frame_index", "team").agg(F.collect_set("number").alias("numbers"))
    lineups = spark.createDataFrame([("a", ["0", "1", "2"]), ("a", ["1", "2", "3"]), ("b", ["0", "1", "2", "3"])], "team string, players array<string>")
    return identity.completed_lineups(known, lineups, ["frame_index"])


HALVES = f"""SELECT frame_index, CASE WHEN na >= 2 AND nb >= 2 AND ma <= 0.35 AND mb <= 0.35 AND l >= 0.8 THEN -1 WHEN na >= 2 AND nb >= 2 AND ma >= 0.65 AND mb >= 0.65 AND r >= 0.8 THEN 1 END AS half FROM h"""


@query(f"""WITH {P}, g AS (SELECT frame_index, team, CASE WHEN (frame_index // 20) % 3 = 0 THEN x / 3 WHEN (frame_index // 20) % 3 = 1 THEN 32 - x / 3 ELSE x END / 32 AS v FROM p WHERE role = 'player' AND x IS NOT NULL),
h AS (SELECT frame_index, median(v) FILTER (team = 'a') AS ma, median(v) FILTER (team = 'b') AS mb, count(*) FILTER (team = 'a') AS na, count(*) FILTER (team = 'b') AS nb, avg((v < 0.45)::INT) AS l, avg((v > 0.55)::INT) AS r FROM g GROUP BY 1)
{HALVES}""")
def q_occupied_half(spark, sf_dir):
    turn = F.floor(F.col("frame_index") / 20) % 3
    rows = persons(spark, sf_dir).withColumn("x", F.when(turn == 0, F.col("x") / 3).when(turn == 1, 32 - F.col("x") / 3).otherwise(F.col("x")))
    return play.occupied_halves(rows, ["a", "b"], 32.0)


EVIDENCE = f"""{FRAMES}, ev AS (SELECT run_id, frame_index, timestamp_s AS time_s, plan, included, frame_index // 400 AS period, CASE WHEN frame_index % 11 < 5 THEN 'a' WHEN frame_index % 11 < 7 THEN NULL WHEN frame_index % 11 = 7 THEN 'a' ELSE 'b' END AS team,
  CASE WHEN frame_index % 31 = 9 THEN 'contested_contact' ELSE 'direct_contact' END AS reason, CASE WHEN frame_index % 7 = 0 THEN -1 WHEN frame_index % 7 < 4 THEN 1 END AS direction FROM plans),
b0 AS (SELECT *, coalesce(lag(included) OVER w AND plan = lag(plan) OVER w AND period = lag(period) OVER w AND frame_index = lag(frame_index) OVER w + 1 AND time_s - lag(time_s) OVER w <= 0.2 + 1e-9, false) AS joined FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY frame_index)),
b1 AS (SELECT *, sum((NOT joined AND included)::INT) OVER (PARTITION BY run_id ORDER BY frame_index) - 1 AS block, lag(time_s) OVER (PARTITION BY run_id ORDER BY frame_index) AS pt FROM b0),
bk AS (SELECT *, CASE WHEN joined THEN pt END AS start FROM b1 WHERE included)"""
OWNED = f"""WITH {EVIDENCE}, sp AS (SELECT *, (start + time_s) / 2 AS mid FROM bk WHERE start IS NOT NULL),
vt AS (SELECT s.run_id, s.frame_index, o.team, sum(least(o.time_s, mid + 0.4) - greatest(o.start, mid - 0.4)) AS w, count(*) AS n FROM sp s JOIN bk o ON o.run_id = s.run_id AND o.block = s.block AND o.start IS NOT NULL AND o.team IS NOT NULL
  AND least(o.time_s, mid + 0.4) - greatest(o.start, mid - 0.4) > 0 GROUP BY s.run_id, s.frame_index, o.team),
bt AS (SELECT run_id, frame_index, arg_max(team, w) AS wt, max(w) AS w, arg_max(n, w) AS n, sum(w) AS al FROM vt GROUP BY 1, 2),
ow AS (SELECT sp.*, CASE WHEN reason = 'direct_contact' AND w >= 0.16 - 1e-9 AND n >= 2 AND w / al >= 0.8 AND (team IS NULL OR team = wt) THEN wt END AS owner FROM sp LEFT JOIN bt USING (run_id, frame_index))
"""


def evidence_pairs(spark, sf_dir):
    """Frames with contacts, cut into blocks; the first of a block has no ``start``."""
    f = F.col("frame_index")
    rows = heatmaps.plans(frame_table(spark, sf_dir)).withColumnRenamed("timestamp_s", "time_s").withColumn("period", F.floor(f / 400))
    team = F.when(f % 11 < 5, "a").when(f % 11 < 7, None).when(f % 11 == 7, "a").otherwise("b")
    rows = rows.withColumn("team", team).withColumn("reason", F.when(f % 31 == 9, "contested_contact").otherwise("direct_contact")).withColumn("direction", F.when(f % 7 == 0, -1).when(f % 7 < 4, 1))
    return play.pairs(rows, ["run_id"])


def evidence(spark, sf_dir):
    return play.window_owner(evidence_pairs(spark, sf_dir), ["run_id"], ["a", "b"])


@query(OWNED + "SELECT run_id, frame_index, round(start, 6) AS start, block::BIGINT AS block, owner FROM ow")
def q_contact_owner(spark, sf_dir):
    return evidence(spark, sf_dir).select("run_id", "frame_index", r6("start"), "block", "owner")


@query(OWNED + """, vs AS (SELECT run_id, period, plan, start, time_s - start AS s, CASE WHEN owner = team AND direction IS NOT NULL THEN CASE WHEN owner = 'a' THEN direction ELSE -direction END END AS v FROM ow),
sm AS (SELECT run_id, period, plan, coalesce(sum(s) FILTER (v = -1), 0) AS l, coalesce(sum(s) FILTER (v = 1), 0) AS r, min(start) FILTER (v IS NOT NULL) AS f FROM vs GROUP BY ALL),
lc AS (SELECT *, l + r AS tt, CASE WHEN l + r >= 0.25 AND greatest(l, r) / (l + r) >= 0.8 THEN CASE WHEN r >= l THEN 1 ELSE -1 END END AS d FROM sm),
lk AS (SELECT run_id, period, arg_min(d, f) AS lock FROM lc WHERE tt >= 0.75 AND d IS NOT NULL GROUP BY 1, 2),
jn AS (SELECT lc.*, lock, CASE WHEN lock = 1 THEN l ELSE r END AS opp, CASE WHEN lock = 1 THEN r ELSE l END AS same FROM lc LEFT JOIN lk USING (run_id, period)),
sr AS (SELECT *, CASE WHEN lock IS NULL THEN 'camera_plan' WHEN tt >= 0.75 AND opp / tt >= 0.9 THEN 'reversed_view' WHEN tt >= 0.75 AND same / tt < 0.8 THEN 'conflicting_view' ELSE 'quarter_lock' END AS source FROM jn)
SELECT run_id, period, plan, source, CASE source WHEN 'camera_plan' THEN d WHEN 'reversed_view' THEN -lock WHEN 'quarter_lock' THEN lock END AS direction, round(l, 6) AS left_s, round(r, 6) AS right_s FROM sr""")
def q_view_directions(spark, sf_dir):
    return play.directions(evidence(spark, sf_dir), ["run_id"], "a").select("run_id", "period", "plan", "source", "direction", r6("left_s"), r6("right_s"))


@query(OWNED + """, en AS (SELECT *, time_s AS e FROM ow WHERE owner IS NOT NULL), nw AS (SELECT *, (coalesce(abs(start - lag(e) OVER w) < 1e-6 AND plan = lag(plan) OVER w AND period = lag(period) OVER w AND owner = lag(owner) OVER w, false))::INT AS j FROM en WINDOW w AS (PARTITION BY run_id ORDER BY start)),
ep AS (SELECT *, sum(1 - j) OVER (PARTITION BY run_id ORDER BY start) - 1 AS episode FROM nw) SELECT run_id, episode::BIGINT AS episode, plan, period, owner, round(min(start), 6) AS start, round(max(e), 6) AS "end", round(sum(e - start), 6) AS classified FROM ep GROUP BY ALL""")
def q_episodes(spark, sf_dir):
    spans = evidence(spark, sf_dir).withColumn("end", F.col("time_s"))
    return play.episodes(spans, ["run_id"]).select("run_id", "episode", "plan", "period", "owner", r6("start"), r6("end"), r6("classified"))


@query(OWNED + """SELECT run_id, round(sum(greatest(0, least(time_s, 1e7) - greatest(start, 12.3))) FILTER (owner = 'a'), 6) AS offense, round(coalesce(sum(greatest(0, least(time_s, 1e7) - greatest(start, 12.3))) FILTER (owner = 'b'), 0), 6) AS defense,
round(1e7 - 12.3 - sum(greatest(0, least(time_s, 1e7) - greatest(start, 12.3))) FILTER (owner IS NOT NULL), 6) AS unknown FROM ow GROUP BY run_id""")
def q_phase_shares(spark, sf_dir):
    spans = evidence(spark, sf_dir).withColumn("end", F.col("time_s")).withColumn("method", F.lit("hands"))
    return heatmaps.phase_durations(spans, F.lit("a"), 12.3, 1e7, ["run_id"]).select("run_id", r6("offense"), r6("defense"), r6("unknown"))


@query(OWNED.rstrip() + INTERVALS[INTERVALS.index(", q AS (SELECT p.*") :].replace(", q AS", ", hq AS").replace("FROM q)", "FROM hq)") + """
SELECT j.run_id, CASE WHEN owner = 'a' THEN 'offense' WHEN owner IS NULL THEN 'unknown' ELSE 'defense' END AS phase, round(sum(j."end" - j.start), 5) AS seconds, count(*) AS n
FROM j LEFT JOIN ow ON ow.run_id = j.run_id AND ow.plan = j.plan AND ow.frame_index = j.frame_index WHERE j.team = 'a' GROUP BY ALL""")
def q_heat_phases(spark, sf_dir):
    """Presence of team a by phase: intervals joined to the owner of their frame."""
    spans = evidence(spark, sf_dir).withColumn("direction", F.lit(1)).withColumn("episode", F.lit(0)).select("run_id", "plan", "frame_index", "owner", "direction", "episode")
    found = heatmaps.with_phases(heat_intervals(spark, sf_dir).where("team = 'a'"), spans)
    parts = [heatmaps.of_phase(found, "a", phase).withColumn("phase", F.lit(phase)) for phase in ("offense", "defense", "unknown")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("run_id", "phase").agg(F.round(F.sum(F.col("end") - F.col("start")), 5).alias("seconds"), F.count(F.lit(1)).alias("n"))


SHOTS = """sh AS (SELECT o_orderkey AS shot_id, o_orderkey // 8000 AS run_id, (o_orderkey // 800) AS segment_id, (o_orderkey // 8)::DOUBLE / 10 + 0.03 AS time_s, o_orderkey % 8 + 1 AS track_id, CASE WHEN o_orderkey % 8 < 4 THEN 'a' ELSE 'b' END AS team,
  CASE WHEN o_custkey % 3 = 0 THEN 'candidate' ELSE 'probable' END AS status, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN -1 ELSE 1 END AS court_direction FROM orders WHERE o_orderkey % 13 = 5 AND o_custkey % 29 <> 7)"""


def shot_rows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").where("o_orderkey % 13 = 5 and o_custkey % 29 <> 7").select(
        k.alias("shot_id"), F.floor(k / 8000).alias("run_id"), F.floor(k / 800).alias("segment_id"), (F.floor(k / 8).cast("double") / 10 + 0.03).alias("time_s"), (k % 8 + 1).alias("track_id"), F.when(k % 8 < 4, "a").otherwise("b").alias("team"),
        F.when(c % 3 == 0, "candidate").otherwise("probable").alias("status"), F.when(c % 4 == 0, None).when(c % 4 == 1, -1).otherwise(1).alias("court_direction"),
    )


ORIGINS = f"""WITH {P}, {SHOTS}, ps AS (SELECT segment_id, timestamp_s, track_id, team, x, y, ground_point_method FROM p WHERE x IS NOT NULL),
m AS (SELECT shot_id, median(x) AS mx, median(y) AS my, count(*) AS n, count(DISTINCT ground_point_method) AS ms, list(struct_pack(x := x, y := y)) AS pts FROM sh JOIN ps ON ps.segment_id = sh.segment_id AND ps.track_id = sh.track_id AND ps.team = sh.team
  AND ps.timestamp_s <= sh.time_s AND sh.time_s - ps.timestamp_s <= 0.25 GROUP BY shot_id),
o AS (SELECT sh.*, n, mx, my, CASE WHEN coalesce(n, 0) < 2 THEN 'ground_position_unavailable' WHEN ms > 1 OR list_max(list_transform(pts, lambda q: sqrt((q.x - mx) ** 2 + (q.y - my) ** 2))) > 1.25 THEN 'unstable_ground_position' END AS why FROM sh LEFT JOIN m USING (shot_id))
"""


def shots_with_origins(spark, sf_dir):
    at = persons(spark, sf_dir).where("x is not null").select("segment_id", F.col("timestamp_s").alias("time_s"), "run_id", "track_id", "team", "x", "y", "ground_point_method", F.lit(-1.0).alias("unbroken_since"))
    return shots.origins(shot_rows(spark, sf_dir), at, ["run_id", "segment_id"])


@query(ORIGINS + "SELECT shot_id, coalesce(n, 0) AS support, why AS origin_reason, CASE WHEN why IS NULL THEN round(mx, 6) END AS origin_x, CASE WHEN why IS NULL THEN round(my, 6) END AS origin_y FROM o")
def q_shot_origin(spark, sf_dir):
    return shots_with_origins(spark, sf_dir).select("shot_id", "support", "origin_reason", r6("origin_x"), r6("origin_y"))


ATTRIBUTED = ORIGINS + """  , att AS (SELECT *, CASE WHEN why IS NULL THEN CASE court_direction WHEN -1 THEN 32 - mx WHEN 1 THEN mx END END AS ax, floor(time_s / 6) AS ph FROM o),
vr AS (SELECT *, CASE WHEN ax < 15.5 THEN 'defensive_half' WHEN time_s < ph * 6 + 4 AND CASE WHEN ph % 2 = 0 THEN 'a' ELSE 'b' END <> team THEN 'opposing_settled_attack' END AS unassigned FROM att)
"""


def attributed_shots(spark, sf_dir):
    rows = shots_with_origins(spark, sf_dir).withColumn("plan", F.lit(0))
    phases = rows.select("run_id", F.floor(F.col("time_s") / 6).alias("_p")).distinct().select("run_id", F.lit(0).alias("plan"), (F.col("_p") * 6.0).alias("start_s"), (F.col("_p") * 6.0 + 4).alias("end_s"), F.lit("settled").alias("method"), F.when(F.col("_p") % 2 == 0, "a").otherwise("b").alias("owner"))
    return shots.attributed(rows, phases, 32.0)


@query(ATTRIBUTED + "SELECT shot_id, unassigned, CASE WHEN unassigned IS NULL THEN team END AS team FROM vr")
def q_shot_attribution(spark, sf_dir):
    return attributed_shots(spark, sf_dir).select("shot_id", "unassigned", "team")


@query(ATTRIBUTED + """, lo AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN court_direction IS NULL THEN 'direction_unavailable' WHEN ax NOT BETWEEN 16 AND 32 THEN 'outside_attacking_half' END AS un FROM vr WHERE unassigned IS NULL)
SELECT team, count(*) AS detected, count(*) FILTER (status = 'probable') AS probable, count(*) FILTER (un IS NULL) AS located, count(*) FILTER (un IS NOT NULL) AS unlocated FROM lo GROUP BY team""")
def q_shot_maps(spark, sf_dir):
    teams = spark.createDataFrame([("a",), ("b",)], "team string")
    return shots.team_maps(shots.located(attributed_shots(spark, sf_dir).where("team is not null"), 32.0, 16.0), teams).select("team", "detected", "probable", "located", "unlocated")
