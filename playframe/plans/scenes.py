"""Queries of composed scenes on the test tables: cameras, uniforms, lineups, colour groups, settled play, flights, tracks, handoffs and the recogniser."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.operators import cameras, evidence, flights, handoffs, lineup, motion, play, uniforms
from playframe.plans import tracking
from playframe.plans.bindings import query, r6, table
from playframe.plans.tracking import P, persons
from playframe.streaming import recogniser

IMAGE, COURT = (1280.0, 720.0), (28.65, 15.24)

# A camera per order: focal length, height and place from its columns, looking down at the court by a small angle.
CAMERA = """cam AS (SELECT o_orderkey AS k, 900.0 + o_custkey % 500 AS f, 0.30 + (o_orderkey % 20) / 100.0 AS tilt, (o_custkey % 60) / 2.0 AS x0, 22.0 + o_orderkey % 9 AS back, 8.0 + o_custkey % 5 AS up, CASE WHEN o_orderkey % 7 = 0 THEN 3.0 ELSE 1.0 END AS stretch FROM orders),
mat AS (SELECT k, f * stretch AS m0, 640 * cos(tilt) AS m1, -f * stretch * x0 + 640 * (back * cos(tilt) + up * sin(tilt)) AS m2, 0.0::DOUBLE AS m3, -f * sin(tilt) + 360 * cos(tilt) AS m4,
  f * (up * cos(tilt) - back * sin(tilt)) + 360 * (back * cos(tilt) + up * sin(tilt)) AS m5, 0.0::DOUBLE AS m6, cos(tilt) AS m7, back * cos(tilt) + up * sin(tilt) AS m8, f AS true_f FROM cam)"""


def camera_rows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), (900.0 + c % 500).alias("f"), (0.30 + (k % 20) / 100.0).alias("tilt"), ((c % 60) / 2.0).alias("x0"), (22.0 + k % 9).alias("back"), (8.0 + c % 5).alias("up"), F.when(k % 7 == 0, 3.0).otherwise(1.0).alias("stretch"),
    )
    f, cos, sin, back, up = F.col("f"), F.cos("tilt"), F.sin("tilt"), F.col("back"), F.col("up")
    depth = back * cos + up * sin
    matrix = [f * F.col("stretch"), 640 * cos, -f * F.col("stretch") * F.col("x0") + 640 * depth, F.lit(0.0), -f * sin + 360 * cos, f * (up * cos - back * sin) + 360 * depth, F.lit(0.0), cos, depth]
    return rows.select("k", F.array(*matrix).alias("matrix"))


@query(f"""WITH {CAMERA}, v AS (SELECT *, m0 AS a0, m3 AS a1, m6 AS a2, m1 - 640 * m7 AS b0, m4 - 360 * m7 AS b1, m7 AS b2 FROM (SELECT * REPLACE (m0 - 640 * m6 AS m0, m3 - 360 * m6 AS m3), m0 AS h0, m3 AS h3 FROM mat)),
q AS (SELECT *, a0 * b0 + a1 * b1 AS p1, a0 * a0 + a1 * a1 - b0 * b0 - b1 * b1 AS p2, a2 * b2 AS q1, a2 * a2 - b2 * b2 AS q2 FROM v),
fo AS (SELECT *, CASE WHEN -(p1 * q1 + p2 * q2) / (p1 * p1 + p2 * p2) > 0 THEN 1 / sqrt(-(p1 * q1 + p2 * q2) / (p1 * p1 + p2 * p2)) END AS g FROM q),
ax AS (SELECT *, a0 / g AS u0, a1 / g AS u1, a2 AS u2, b0 / g AS v0, b1 / g AS v1, b2 AS v2 FROM fo WHERE g BETWEEN 512 AND 10240),
no AS (SELECT *, sqrt(u0 * u0 + u1 * u1 + u2 * u2) AS nu, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nv, u0 * v0 + u1 * v1 + u2 * v2 AS uv FROM ax),
w AS (SELECT *, (u1 * v2 - u2 * v1) * 2 / (nu + nv) AS w0, (u2 * v0 - u0 * v2) * 2 / (nu + nv) AS w1, (u0 * v1 - u1 * v0) * 2 / (nu + nv) AS w2 FROM no WHERE greatest(nu, nv) <= 1.3 * least(nu, nv) AND abs(uv) <= 0.2 * nu * nv),
h AS (SELECT *, g * w0 + 640 * w2 AS z0, g * w1 + 360 * w2 AS z1, w2 AS z2 FROM w),
s AS (SELECT k, g, side, h0 * x + m1 * 7.62 + m2 AS c0, h3 * x + m4 * 7.62 + m5 AS c1, m6 * x + m7 * 7.62 + m8 AS c2, z0, z1, z2 FROM h, (VALUES (0, 1.6002), (1, 28.65 - 1.6002)) t(side, x)),
e AS (SELECT k, g, side, c2, c0 + d * 3.048 * z0 AS p0, c1 + d * 3.048 * z1 AS p1, c2 + d * 3.048 * z2 AS p2 FROM s, (VALUES (-1.0), (1.0)) t(d)),
b AS (SELECT k, side, min(p1 / p2) AS y, arg_min(p0 / p2, p1 / p2) AS x FROM e WHERE p2 * c2 > 0 AND abs(p2) > 1e-9 GROUP BY k, side),
r AS (SELECT * FROM b WHERE x BETWEEN -128 AND 1408 AND y BETWEEN 0 AND 720)
SELECT mat.k, round(any_value(h.g), 3) AS focal, count(r.side) AS n_rims, round(min(r.x), 3) AS first_x, round(max(r.y), 3) AS lowest_y FROM mat LEFT JOIN h USING (k) LEFT JOIN r USING (k) GROUP BY mat.k""")
def q_rim_anchors(spark, sf_dir):
    found = cameras.rim_anchors(camera_rows(spark, sf_dir), "matrix", F.lit(IMAGE[0]), F.lit(IMAGE[1]), *COURT)
    return found.select("k", F.round("focal", 3).alias("focal"), F.size("rims").cast("long").alias("n_rims"), F.round(F.array_min(F.transform("rims", lambda r: r[0])), 3).alias("first_x"), F.round(F.array_max(F.transform("rims", lambda r: r[1])), 3).alias("lowest_y"))


UNIFORMS = """s AS (SELECT vec_id, vec_id // 4 AS grp, CASE WHEN vec_id % 3 = 0 THEN 'a' WHEN vec_id % 3 = 1 THEN 'b' END AS label, unnest([0, 1]) AS region, embedding FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT vec_id, grp, label, region, ch, least(255, greatest(0, floor(96 + 60 * embedding[3 * region + ch + 1]::DOUBLE) + CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 3 = 1 THEN 90 ELSE vec_id % 90 END)) AS v FROM s, unnest([0, 1, 2]) AS t(ch)),
ce AS (SELECT label, region, ch, quantile_disc(v, 0.5) AS center FROM c WHERE label IS NOT NULL AND grp % 5 <> 0 GROUP BY ALL),
md AS (SELECT label, region, ch, center, least(55, greatest(8, 1.4826 * quantile_disc(abs(v - center), 0.5))) AS scale FROM c JOIN ce USING (label, region, ch) WHERE grp % 5 <> 0 GROUP BY ALL)"""
DISTANCES = f"""WITH {UNIFORMS}, d AS (SELECT vec_id, grp, c.label, region, md.label AS team, avg(((v - center) / scale) ** 2) AS d FROM c JOIN md USING (region, ch) GROUP BY ALL),
n AS (SELECT vec_id, grp, label, region, arg_min(team, d) AS winner, min(d) AS nearest, max(d) - min(d) AS separation FROM (SELECT * FROM d ORDER BY team) GROUP BY ALL),
g AS (SELECT vec_id, any_value(grp) AS grp, any_value(label) AS label, min(winner) AS team, min(winner) = max(winner) AS one, max(nearest) AS nearest, min(separation) AS separation FROM n GROUP BY vec_id)"""


def uniform_samples(spark, sf_dir):
    v = F.col("vec_id")
    shift = F.when(v % 3 == 0, F.lit(0)).when(v % 3 == 1, 90).otherwise(v % 90)
    value = lambda i: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(96 + 60 * F.col("embedding")[i].cast("double")) + shift))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select("vec_id", F.floor(v / 4).alias("group"), F.when(v % 3 == 0, "a").when(v % 3 == 1, "b").alias("label"), F.array(*[F.array(*[value(3 * r + c) for c in range(3)]) for r in range(2)]).alias("features"))


@query(f"WITH {UNIFORMS} SELECT label, region::INT AS region, ch::INT AS channel, center::DOUBLE AS center, round(scale, 6) AS scale FROM md")
def q_uniform_prototypes(spark, sf_dir):
    model = uniforms.prototypes(uniform_samples(spark, sf_dir))
    regions = model.select("label", F.posexplode(F.arrays_zip("centers", "scales")).alias("region", "r"))
    return regions.select("label", "region", F.posexplode(F.arrays_zip("r.centers", "r.scales")).alias("channel", "c")).select("label", "region", "channel", F.col("c.centers").alias("center"), r6("c.scales", "scale"))


@query(DISTANCES + """SELECT margin, "limit", team AS predicted, count(*) AS accepted, count(*) FILTER (team = label) AS correct
FROM g, (VALUES (1.0), (2.0), (3.0), (4.0), (6.0)) m(margin), (VALUES (4.0), (6.0), (9.0)) l("limit") WHERE label IS NOT NULL AND grp % 5 = 0 AND one AND nearest <= "limit" AND separation >= margin GROUP BY ALL""")
def q_uniform_grid(spark, sf_dir):
    samples = uniform_samples(spark, sf_dir)
    return uniforms.threshold_grid(samples, uniforms.prototypes(samples))


@query(DISTANCES + """SELECT vec_id, CASE WHEN one AND nearest <= 6 AND separation >= 1 THEN team END AS team, round(separation, 4) AS separation FROM g""")
def q_uniform_teams(spark, sf_dir):
    samples = uniform_samples(spark, sf_dir)
    return uniforms.classified(samples, uniforms.prototypes(samples), 1.0, 6.0).select("vec_id", "team", F.round("separation", 4).alias("separation"))


@query(f"""WITH {P}, n AS (SELECT run_id, segment_id, team, track_id, number::INT AS player, count(*)::DOUBLE AS n FROM p WHERE role = 'player' AND c % 2 = 0 GROUP BY ALL),
t AS (SELECT run_id, segment_id, team, track_id, coalesce(max(n) FILTER (player = 0), 0) AS n0, coalesce(max(n) FILTER (player = 1), 0) AS n1, coalesce(max(n) FILTER (player = 2), 0) AS n2, coalesce(max(n) FILTER (player = 3), 0) AS n3 FROM n GROUP BY ALL),
f AS (SELECT run_id, segment_id, team, list(track_id ORDER BY track_id) AS ks, list([n0, n1, n2, n3] ORDER BY track_id) AS m FROM t GROUP BY ALL),
g AS (SELECT *, len(ks) AS n FROM f),
pm AS (SELECT [a, b, c, d] AS o FROM range(4) t1(a), range(4) t2(b), range(4) t3(c), range(4) t4(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
s AS (SELECT DISTINCT run_id, segment_id, team, ks, n, o[1:n] AS o, -list_sum(list_transform(range(1, n + 1), lambda i: m[i][o[i] + 1])) AS cost, m FROM g, pm),
b AS (SELECT *, min(cost) OVER (PARTITION BY run_id, segment_id, team) AS best FROM s),
w AS (SELECT run_id, segment_id, team, ks, m, arg_min(o, cost) AS o, any_value(best) AS best FROM b GROUP BY ALL),
e AS (SELECT w.run_id, w.segment_id, w.team, w.ks[i] AS track_id, w.o[i] AS player, w.m[i][w.o[i] + 1] AS own, (SELECT min(b.cost) FROM b WHERE b.run_id = w.run_id AND b.segment_id = w.segment_id AND b.team = w.team AND b.o[i] <> w.o[i]) - best AS margin FROM w, unnest(range(1, len(w.ks) + 1)) AS u(i))
SELECT run_id, segment_id, team, track_id, player::INT AS player, -own AS cost, margin FROM e WHERE margin >= 1""")
def q_lineup_seeds(spark, sf_dir):
    rows = persons(spark, sf_dir).where("role = 'player' and c % 2 = 0")
    key = ["run_id", "segment_id", "team"]
    seen = rows.groupBy(*key, "track_id", F.col("number").cast("int").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    # Every track may be every player; one that was never read as it has no evidence.
    able = seen.select(*key, "track_id").distinct().withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(3))))
    costs = able.join(seen, [*key, "track_id", "player"], "left").select(*key, "track_id", "player", (-F.coalesce("n", F.lit(0))).cast("double").alias("cost"))
    return lineup.seeded(costs, key).where("clear").drop("clear")


@query(f"""WITH {P}, sa AS (SELECT run_id, timestamp_s AS t, track_id, CASE WHEN c % 41 = 0 THEN 'black' ELSE 'hue' END AS kind, CASE WHEN c % 41 <> 0 THEN ((CASE WHEN team = 'a' THEN 10 WHEN c % 17 = 0 THEN 15 ELSE 100 END) + c % 9)::DOUBLE END AS hue FROM p WHERE frame_index % 4 = 0 AND c % 31 <> 3),
l AS (SELECT *, lag(t, 2) OVER w AS t3, lag(kind) OVER w AS k2, lag(hue) OVER w AS h2, lag(kind, 2) OVER w AS k3, lag(hue, 2) OVER w AS h3 FROM sa WINDOW w AS (PARTITION BY run_id, track_id ORDER BY t)),
e AS (SELECT *, coalesce(t - t3 <= 12, false) AS enough, CASE WHEN k3 <> k2 THEN 180 WHEN k3 = 'hue' THEN least(abs(h3 - h2), 180 - abs(h3 - h2)) ELSE 0 END AS d2, CASE WHEN k3 <> kind THEN 180 WHEN k3 = 'hue' THEN least(abs(h3 - hue), 180 - abs(h3 - hue)) ELSE 0 END AS d1 FROM l),
s AS (SELECT *, enough AND d1 <= 10 AND d2 <= 10 AS steady FROM e),
f1 AS (SELECT run_id, min(struct_pack(t := t, k := track_id, kind := kind, hue := hue)) AS one FROM s WHERE steady GROUP BY run_id),
j1 AS (SELECT s.*, one, CASE WHEN one.kind <> s.kind THEN 180 WHEN s.kind = 'hue' THEN least(abs(one.hue - s.hue), 180 - abs(one.hue - s.hue)) ELSE 0 END AS a1 FROM s LEFT JOIN f1 USING (run_id)),
f2 AS (SELECT run_id, min(struct_pack(t := t, k := track_id, kind := kind, hue := hue)) AS two FROM j1 WHERE steady AND a1 >= 20 GROUP BY run_id),
j2 AS (SELECT j1.*, two, CASE WHEN (two.t, two.k) <= (j1.t, j1.track_id) THEN CASE WHEN two.kind <> j1.kind THEN 180 WHEN j1.kind = 'hue' THEN least(abs(two.hue - j1.hue), 180 - abs(two.hue - j1.hue)) ELSE 0 END END AS a2 FROM j1 LEFT JOIN f2 USING (run_id)),
g AS (SELECT *, CASE WHEN steady THEN CASE WHEN a1 <= 10 AND (one.t, one.k) <= (t, track_id) AND (a2 IS NULL OR a1 <= a2) THEN 1 WHEN a2 <= 10 THEN 2 END END AS gr FROM j2),
h AS (SELECT *, last_value(CASE WHEN enough THEN coalesce(gr, 0) END IGNORE NULLS) OVER (PARTITION BY run_id, track_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS now FROM g),
k AS (SELECT *, first_value(nullif(now, 0) IGNORE NULLS) OVER (PARTITION BY run_id, track_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS first FROM h),
x AS (SELECT *, count(*) FILTER (nullif(now, 0) <> first) OVER (PARTITION BY run_id, track_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS broken, count(*) FILTER (nullif(now, 0) <> first) OVER (PARTITION BY run_id, track_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT run_id, track_id, t AS time_s, CASE WHEN broken = 0 AND now > 0 THEN 'team_' || now END AS team_group, broken > 0 AS conflict FROM x WHERE before = 0""")
def q_color_groups(spark, sf_dir):
    c = F.col("c")
    rows = persons(spark, sf_dir).where("frame_index % 4 = 0 and c % 31 <> 3")
    hue = (F.when(F.col("team") == "a", 10).when(c % 17 == 0, 15).otherwise(100) + c % 9).cast("double")
    kind = F.when(c % 41 == 0, "black").otherwise("hue")
    return evidence.group_colors(rows.select("run_id", F.col("timestamp_s").alias("time_s"), "track_id", kind.alias("kind"), F.when(c % 41 != 0, hue).alias("hue"), F.lit(0.0).alias("overlap")), ["run_id"])


@query()
def q_settled_play(spark, sf_dir):
    f = F.col("frame_index")
    half = F.when(F.floor(f / 35) % 3 == 0, -1).when(F.floor(f / 35) % 3 == 1, 1)
    where = F.when(f % 5 < 3, F.when(F.floor(f / 35) % 3 == 0, 6.0).otherwise(24.0))
    rows = tracking.evidence(spark, sf_dir).drop("owner", "direction").unionByName(_block_starts(spark, sf_dir))
    rows = rows.withColumns({"half": half, "holder_x": where, "court_ok": f % 53 != 7, "view": F.when(F.floor(f / 300) % 2 == 0, 1).otherwise(-1), "scored": f % 211 == 100})
    return play.settled(rows, ["run_id"], ("a", "b"), 30.0)


def _block_starts(spark, sf_dir):
    """The first frames of blocks, which the pairs of ``evidence`` leave out."""
    return tracking.evidence_pairs(spark, sf_dir).where("start is null").drop("direction")


@query()
def q_flights(spark, sf_dir):
    """A throw from every hundredth frame on, one in three short of the rim, with the table's noise on the ball."""
    f = F.col("frame_index") % 100
    rows = persons(spark, sf_dir).groupBy("run_id", "segment_id", "frame_index").agg(F.min("c").alias("c"), F.max("scene_cut").alias("scene_cut"))
    t = F.greatest(F.lit(0.0), (f - 4) / 30.0)
    held = (f < 5) | (f > 60)
    own = lambda v: F.when(held, F.lit(v))
    noise = (F.col("c") % 5) / 4.0
    rows = rows.select(
        "run_id", "segment_id", "frame_index", (F.col("frame_index") / 30.0).alias("time_s"), "scene_cut", F.when(F.col("c") % 23 != 1, F.when(held, 400.0).otherwise(400 + 360 * t) + noise).alias("x"),
        F.when(F.col("c") % 23 != 1, F.when(held, 300.0).otherwise(300 - 500 * t + 600 * t * t) + noise).alias("y"), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("court"),
        F.when(F.col("segment_id") % 3 > 0, F.array(F.array(F.lit(724.0), F.lit(336.0)))).alias("rims"), own(7).cast("long").alias("track"), own("player").alias("role"), own("a").alias("team"), own("roster:a:7").alias("subject"),
        own(0.1).alias("distance"), own(100.0).alias("height"), own(True).alias("raised"), own(False).alias("ambiguous"), own(True).alias("unique"),
    )
    found = flights.flights(rows)
    return found.select("run_id", "segment_id", "frame_index", "status", "ending", r6("end_s"), r6("rise"), r6("fall"), r6("free"), "arc", "rim", F.size("frames").alias("n_frames"))


@query()
def q_box_tracks(spark, sf_dir):
    c, k = F.col("c"), F.col("track_id")
    x, y = k * 120.0 + (F.col("frame_index") % 100) * 2.0 + (c % 7), k * 10.0 + (c % 5)
    rows = persons(spark, sf_dir).select("run_id", "segment_id", "frame_index", F.col("k").alias("id"), (0.1 + (c % 90) / 100.0).alias("score"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 100).alias("y2"), F.col("scene_cut").alias("reset"))
    return motion.tracked(rows, ["run_id", "segment_id"])


def handoff_scene(spark, sf_dir):
    """Bodies whose track number changes every twenty frames; names are known on every other piece."""
    c, f, slot = F.col("c"), F.col("frame_index"), F.col("track_id")
    x = slot * 100.0 + (c % 5)
    piece = F.floor(f / 20) % 5
    rows = persons(spark, sf_dir).select(
        "run_id", "segment_id", (slot + 10 * piece).alias("track_id"), "frame_index", (f / 30.0).alias("timestamp_s"), "included", F.lit("player").alias("role"), F.array(x - 10, F.lit(0.0), x + 10, F.lit(100.0)).alias("box"),
        F.when(c % 13 == 0, None).otherwise(F.col("team")).alias("color"), "team", slot.cast("string").alias("number"), "c", "scene_cut",
    )
    direct = rows.where((piece % 2 == 0) & (F.col("c") % 3 > 0)).select("run_id", "segment_id", "track_id", "frame_index", "team", "number")
    reads = rows.where("c % 97 = 0").select("run_id", "segment_id", "track_id", "frame_index", F.lit("99").alias("number"), F.lit(0.9).alias("confidence"))
    return rows.drop("team", "number"), direct, rows.where("scene_cut").select("run_id", "segment_id", "frame_index").distinct(), reads


@query()
def q_handoffs(spark, sf_dir):
    bodies, direct, cuts, reads = handoff_scene(spark, sf_dir)
    return handoffs.links(bodies, direct, cuts, reads)


@query()
def q_recognised_numbers(spark, sf_dir):
    c = F.col("c")
    rows = persons(spark, sf_dir).select(
        "run_id", "segment_id", "frame_index", F.timestamp_micros((F.col("timestamp_s") * 1_000_000).cast("long")).alias("ts"), "track_id", ((c % 100) / 100.0).alias("confidence"),
        F.when(c % 6 > 0, (c % 50 + 1) / 50.0).alias("quality"), F.when(c % 9 > 0, F.col("number")).alias("number"), (0.8 + (c % 20) / 100.0).alias("read_confidence"),
    )
    return recogniser.recognised(rows, "run_id")


READS = f"""WITH RECURSIVE {P}, rr AS (SELECT run_id, track_id, segment_id, frame_index, timestamp_s * 3 AS t, CASE WHEN c % 7 = 0 THEN NULL WHEN (frame_index // 30) % 2 = 0 AND c % 5 > 0 THEN 'a' ELSE 'b' END AS color, c % 8 > 0 AS crop, CASE WHEN c % 4 > 0 THEN number END AS number, 0.7 + (c % 30) / 100.0 AS conf FROM p),
i AS (SELECT *, sum((frame_index IS DISTINCT FROM pf + 1)::INT) OVER (PARTITION BY run_id, segment_id, track_id ORDER BY frame_index) AS island, (frame_index IS DISTINCT FROM pf + 1) AS new FROM (SELECT *, lag(frame_index) OVER (PARTITION BY run_id, segment_id, track_id ORDER BY frame_index) AS pf FROM rr)),
s AS (SELECT *, sum((color IS NOT NULL AND color IS DISTINCT FROM pc)::INT) OVER (PARTITION BY run_id, segment_id, track_id, island ORDER BY frame_index) AS streak
  FROM (SELECT *, last_value(color IGNORE NULLS) OVER (PARTITION BY run_id, segment_id, track_id, island ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM i)),
u AS (SELECT *, CASE WHEN count(color) OVER (PARTITION BY run_id, segment_id, track_id, island, streak ORDER BY frame_index) >= 3 THEN color END AS sure, first_value(color) OVER (PARTITION BY run_id, segment_id, track_id, island ORDER BY frame_index) AS first FROM s),
v AS (SELECT *, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY run_id, segment_id, track_id, island ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS now FROM u),
g AS (SELECT *, sum((new OR (sure IS NOT NULL AND sure IS DISTINCT FROM now))::INT) OVER (PARTITION BY run_id, segment_id, track_id ORDER BY frame_index) - 1 AS run FROM v),
a AS (SELECT *, (number IS NOT NULL AND conf >= 0.8)::INT AS vote FROM (SELECT *, min(frame_index) OVER (PARTITION BY run_id, segment_id, track_id, run) AS run_start FROM g) WHERE crop AND (frame_index - run_start) % 2 = 0),
b AS (SELECT *, sum(vote) OVER (PARTITION BY run_id, segment_id, track_id, run, number ORDER BY frame_index) AS own, sum(vote) OVER (PARTITION BY run_id, segment_id, track_id, run ORDER BY frame_index) AS al FROM a),
k AS (SELECT *, min(frame_index) FILTER (vote = 1 AND own >= 3 AND 2 * own > al AND own >= 0.6 * al) OVER (PARTITION BY run_id, segment_id, track_id, run) AS won_at FROM b),
x AS (SELECT run_id, segment_id, track_id, run, frame_index, t FROM k WHERE frame_index = won_at
  UNION ALL (SELECT run_id, segment_id, track_id, run, frame_index, t FROM (SELECT k.run_id, k.segment_id, k.track_id, k.run, k.frame_index, k.t, row_number() OVER (PARTITION BY k.run_id, k.segment_id, k.track_id, k.run ORDER BY k.frame_index) AS z
    FROM x JOIN k ON k.run_id = x.run_id AND k.segment_id = x.segment_id AND k.track_id = x.track_id AND k.run = x.run AND k.t - x.t >= 3 AND k.frame_index > x.frame_index) WHERE z = 1)),
y AS (SELECT k.* FROM k WHERE won_at IS NULL OR frame_index <= won_at UNION ALL SELECT k.* FROM k JOIN x USING (run_id, segment_id, track_id, run, frame_index) WHERE k.frame_index > won_at)
SELECT run_id, segment_id, track_id, frame_index, run::BIGINT AS run, (sum(vote) OVER (PARTITION BY run_id, segment_id, track_id, run, number ORDER BY frame_index))::BIGINT AS votes, coalesce(frame_index >= won_at, false) AS confirmed FROM y"""


@query(READS)
def q_planned_reads(spark, sf_dir):
    c, f = F.col("c"), F.col("frame_index")
    color = F.when(c % 7 == 0, None).when((F.floor(f / 30) % 2 == 0) & (c % 5 > 0), "a").otherwise("b")
    rows = persons(spark, sf_dir).select(
        "run_id", "segment_id", "track_id", "frame_index", (F.col("timestamp_s") * 3).alias("time_s"), color.alias("color"), (c % 8 > 0).alias("crop"),
        F.when(c % 4 > 0, F.col("number")).alias("number"), (0.7 + (c % 30) / 100.0).alias("confidence"),
    )
    return evidence.planned_reads(rows, ["run_id", "segment_id", "track_id"]).select("run_id", "segment_id", "track_id", "frame_index", "run", "votes", "confirmed")


@query(f"""WITH {P}, pt AS (SELECT DISTINCT run_id, frame_index, (c % 23)::DOUBLE AS x, ((c // 7 + k) % 19)::DOUBLE AS y FROM p), n AS (SELECT run_id, frame_index, count(*) AS n FROM pt GROUP BY ALL),
ed AS (SELECT a.run_id, a.frame_index, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM pt a JOIN pt b ON a.run_id = b.run_id AND a.frame_index = b.frame_index AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.run_id = a.run_id AND c.frame_index = a.frame_index AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))
SELECT run_id, frame_index, count(*) AS corners, round(sum(ax * byy - bx * ay) / 2, 4) AS area FROM ed JOIN n USING (run_id, frame_index) WHERE n >= 3 GROUP BY ALL HAVING count(*) >= 3""")
def q_hull(spark, sf_dir):
    from playframe.functions import geometry as geo

    rows = persons(spark, sf_dir).groupBy("run_id", "frame_index").agg(F.collect_list(F.array((F.col("c") % 23).cast("double"), ((F.floor(F.col("c") / 7) + F.col("k")) % 19).cast("double"))).alias("points")).withColumn("hull", geo.convex_hull(F.col("points"))).where("size(hull) >= 3")
    return rows.select("run_id", "frame_index", F.size("hull").cast("long").alias("corners"), F.round(geo.polygon_area(F.col("hull")), 4).alias("area"))


@query("""WITH m AS (SELECT o_orderkey AS k, 5 + o_custkey % 9 AS w, 4 + o_orderkey % 6 AS h, o_custkey % 13 AS a, o_orderkey % 17 + 1 AS b, o_custkey % 4 AS g FROM orders),
s AS (SELECT *, unnest(range(w * h)) AS q FROM m), c AS (SELECT * FROM s WHERE (q >= a AND q < a + b) OR (q >= a + b + g AND q < a + b + g + 3)),
i AS (SELECT k, w, h, (q // w - 1) * (w - 2) + q % w - 2 AS q FROM c WHERE q // w >= 1 AND q // w < h - 1 AND q % w >= 2),
d AS (SELECT *, q - row_number() OVER (PARTITION BY k ORDER BY q) AS grp FROM i), r AS (SELECT k, w, h, min(q) AS a, max(q) + 1 AS z FROM d GROUP BY k, w, h, grp),
t AS (SELECT *, a - coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS gap FROM r), x AS (SELECT k, string_agg(gap || ',' || (z - a), ',' ORDER BY a) AS runs, max(z) AS z FROM t GROUP BY k)
SELECT k, coalesce(runs || ',', '') || ((w - 2) * (h - 2) - coalesce(z, 0)) AS runs FROM m LEFT JOIN x USING (k)""")
def q_mask_crop(spark, sf_dir):
    from playframe.functions import geometry as geo

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h, a, b, g = 5 + c % 9, 4 + k % 6, c % 13, k % 17 + 1, c % 4
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), w.alias("w"), h.alias("h"), a.alias("a"), b.alias("b"), g.alias("g"))
    zero, area = F.lit(0).cast("long"), F.col("w") * F.col("h")
    clip = lambda v: F.least(v, area)
    edges = [zero, clip(F.col("a")), clip(F.col("a") + F.col("b")), clip(F.col("a") + F.col("b") + F.col("g")), clip(F.col("a") + F.col("b") + F.col("g") + 3), area]
    rows = rows.select("k", F.array(zero, zero, F.col("w"), F.col("h")).alias("roi"), F.array(*[q - p for p, q in zip(edges, edges[1:], strict=False)]).alias("counts"), F.array(F.lit(2).cast("long"), F.lit(1).cast("long"), F.col("w"), F.col("h") - 1).alias("inner"))
    return rows.select("k", F.array_join(F.transform(geo.mask_crop(F.col("roi"), F.col("counts"), F.col("inner")), lambda v: v.cast("string")), ",").alias("runs"))


@query(f"""WITH {P}, b AS (SELECT DISTINCT run_id, segment_id, track_id, frame_index FROM p), na AS (SELECT DISTINCT run_id, segment_id, track_id FROM p WHERE segment_id % 4 = 1 AND track_id < 4),
u AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY frame_index) - 1 AS i FROM b ANTI JOIN na USING (run_id, segment_id, track_id) WINDOW w AS (PARTITION BY run_id, segment_id, track_id)),
nr AS (SELECT DISTINCT run_id, segment_id, track_id, frame_index + d AS frame_index FROM p, unnest([0, 2, -2, 4, -4, 8, -8, 16, -16]) AS t(d) WHERE c % 37 = 0)
SELECT u.run_id, u.segment_id, u.track_id, u.frame_index, nr.frame_index IS NOT NULL AS anchored FROM u LEFT JOIN nr USING (run_id, segment_id, track_id, frame_index)
WHERE n >= 15 AND (nr.frame_index IS NOT NULL OR i IN (SELECT round_even(k * (n - 1) / 11, 0) FROM range(12) t(k)))""")
def q_wanted_frames(spark, sf_dir):
    from playframe.operators import recovery

    rows = persons(spark, sf_dir)
    reads = rows.where("c % 37 = 0").select("run_id", "segment_id", "track_id", "frame_index", "number", F.lit(0.9).alias("confidence"))
    return recovery.wanted_frames(rows, rows.where("segment_id % 4 = 1 and track_id < 4"), reads)


@query(f"""WITH {P}, pr AS (SELECT run_id, segment_id, track_id, frame_index, CASE WHEN c % 5 = 0 THEN 'old' ELSE 'new' END AS decoder, number, 0.5 + (c % 50) / 100.0 AS confidence FROM p WHERE c % 3 > 0),
re AS (SELECT run_id, segment_id, track_id, frame_index, 'new' AS decoder, (c % 60 + d)::VARCHAR AS number, 0.4 + (c * (d + 3) % 60) / 100.0 AS confidence FROM p, unnest([0, 1, 2]) AS t(d) WHERE c % 4 = 0),
be AS (SELECT * FROM re QUALIFY row_number() OVER (PARTITION BY run_id, segment_id, track_id, frame_index ORDER BY confidence DESC, number::DOUBLE) = 1)
SELECT * FROM pr WHERE decoder = 'old' UNION ALL SELECT run_id, segment_id, track_id, frame_index, 'new', CASE WHEN o.confidence IS NULL OR n.confidence > o.confidence THEN n.number ELSE o.number END, CASE WHEN o.confidence IS NULL OR n.confidence > o.confidence THEN n.confidence ELSE o.confidence END
FROM (SELECT * FROM pr WHERE decoder = 'new') o FULL JOIN be n USING (run_id, segment_id, track_id, frame_index)""")
def q_merged_reads(spark, sf_dir):
    from playframe.operators import recovery

    c, key = F.col("c"), ["run_id", "segment_id", "track_id", "frame_index"]
    rows = persons(spark, sf_dir)
    previous = rows.where("c % 3 > 0").select(*key, F.when(c % 5 == 0, "old").otherwise("new").alias("decoder"), "number", (0.5 + (c % 50) / 100.0).alias("confidence"))
    crops = rows.where("c % 4 = 0").withColumn("d", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    recovered = crops.select(*key, F.lit("new").alias("decoder"), (c % 60 + F.col("d")).cast("string").alias("number"), (0.4 + (c * (F.col("d") + 3) % 60) / 100.0).alias("confidence"))
    return recovery.merged_reads(previous, recovered, "new")
