"""Queries of the column functions: identities, colours, geometry, texts and decoders, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.functions import geometry as geo
from playframe.functions import text, tracking
from playframe.operators import evaluation, frames, identity
from playframe.plans.bindings import query, r6, table

LEN, WID = 28.6512, 15.24


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def columns():
    """Order key, customer key and price."""
    return F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")


@query("""SELECT o_orderkey AS k, (t < 40 OR t >= 50) AND NOT (t >= 60 AND t < 75 OR t >= 90 AND t < 95) AS included, coalesce(exists(SELECT 1 FROM (VALUES (20.5), (50.0)) b(v) WHERE before < v AND v <= t), false) AS crossed
FROM (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS t, CASE WHEN o_orderkey % 100 > 0 THEN (o_orderkey % 100)::DOUBLE - 1 END AS before FROM orders)""")
def q_included(spark, sf_dir):
    K, _, _ = columns()
    t = (K % 100).cast("double")
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s])
    rows = orders(spark, sf_dir)
    return rows.select(K.alias("k"), tracking.included(t, spans((0.0, 40.0), (50.0, 200.0)), spans((60.0, 75.0), (90.0, 95.0))).alias("included"), tracking.crosses(F.when(K % 100 > 0, t - 1), t, F.array(F.lit(20.5), F.lit(50.0))).alias("crossed"))


PERSON = """q AS (SELECT o_orderkey AS k, o_custkey % 13 = 0 AS suppressed, CASE WHEN o_custkey % 4 = 0 THEN 'r' || o_custkey % 2 END AS rt, CASE WHEN o_custkey % 5 <> 1 THEN (o_custkey % 9)::VARCHAR END AS rn, o_custkey % 6 = 0 AS hm, CASE WHEN o_custkey % 12 = 0 THEN '77' END AS mn,
CASE WHEN o_custkey % 7 < 4 THEN 'confirmed' ELSE 'tentative' END AS js, CASE WHEN o_custkey % 3 = 0 THEN 'ambiguous' ELSE 'unique_number' END AS ji, 'j' || o_custkey % 2 AS jt, (o_custkey % 30)::VARCHAR AS jn, o_custkey % 17 = 1 AS conflict, o_custkey % 8 = 3 AS hg, CASE WHEN o_custkey % 16 = 3 THEN 'g' END AS gt FROM orders)"""


def person(spark, sf_dir):
    K, C, _ = columns()
    return orders(spark, sf_dir).select(
        K.alias("k"), (C % 13 == 0).alias("suppressed"), F.when(C % 4 == 0, F.concat(F.lit("r"), (C % 2).cast("string"))).alias("rt"), F.when(C % 5 != 1, (C % 9).cast("string")).alias("rn"), (C % 6 == 0).alias("hm"), F.when(C % 12 == 0, "77").alias("mn"),
        F.when(C % 7 < 4, "confirmed").otherwise("tentative").alias("js"), F.when(C % 3 == 0, "ambiguous").otherwise("unique_number").alias("ji"), F.concat(F.lit("j"), (C % 2).cast("string")).alias("jt"), (C % 30).cast("string").alias("jn"),
        (C % 17 == 1).alias("conflict"), (C % 8 == 3).alias("hg"), F.when(C % 16 == 3, "g").alias("gt"),
    )


@query(f"""WITH {PERSON} SELECT k, CASE WHEN suppressed THEN 'anonymous-s1-t' || k WHEN rt IS NOT NULL AND rn IS NOT NULL THEN 'roster:' || rt || ':' || rn WHEN NOT hm AND ji = 'unique_number' AND js = 'confirmed' THEN 'roster:' || jt || ':' || jn ELSE 'anonymous-s1-t' || k END AS subject,
CASE WHEN conflict THEN NULL WHEN rt IS NOT NULL THEN rt WHEN hg THEN gt WHEN hm THEN NULL WHEN js = 'confirmed' THEN jt END AS team, CASE WHEN suppressed THEN NULL WHEN rn IS NOT NULL THEN rn WHEN hm THEN mn WHEN js = 'confirmed' THEN jn ELSE '5' END AS number FROM q""")
def q_identity_rules(spark, sf_dir):
    c = F.col
    named = tracking.identity(c("suppressed"), c("rt"), c("rn"), c("hm"), c("js"), c("ji"), c("jt"), c("jn"))
    return person(spark, sf_dir).select(
        "k", tracking.subject(named, F.lit(1), c("k")).alias("subject"), tracking.team(c("conflict"), c("rt"), c("hg"), c("gt"), c("hm"), c("js"), c("jt")).alias("team"),
        tracking.shown_number(c("suppressed"), c("rn"), c("hm"), c("mn"), c("js"), c("jn"), F.lit("5")).alias("number"),
    )


@query(f"""SELECT o_orderkey AS k, coalesce(o_custkey % 5 < 2 AND o_custkey % 7 <> 0 AND x <= {LEN} AND y <= {WID}, false) AS on_court, o_custkey % 6 <> 0 AND o_custkey % 9 <> 0 AND (o_custkey % 100) / 100.0 >= 0.35 AND x * 10 <= 300 AND y * 10 <= 180 AS ball
FROM (SELECT *, o_totalprice / 15000 AS x, o_totalprice / 25000 AS y FROM orders)""")
def q_valid_points(spark, sf_dir):
    K, C, V = columns()
    x, y = V / 15000, V / 25000
    status = F.when(C % 5 == 0, "fit").when(C % 5 == 1, "propagated").otherwise("unavailable")
    return orders(spark, sf_dir).select(K.alias("k"), tracking.on_court(x, y, F.lit(LEN), F.lit(WID), status, C % 7 != 0).alias("on_court"), tracking.ball_usable(C % 6 != 0, F.when(C % 9 != 0, "ok").otherwise("lost"), x * 10, y * 10, (C % 100) / 100, F.lit(300), F.lit(180)).alias("ball"))


HEX = "printf('#%02X%02X%02X', o_custkey % 256, o_orderkey % 256, (o_custkey + o_orderkey) % 256)"
HEX2 = "printf('#%02X%02X%02X', o_orderkey % 200, o_custkey % 200, o_orderkey % 97)"


@query(f"""WITH c AS (SELECT o_orderkey AS k, {HEX} AS a, {HEX2} AS b, sqrt((o_custkey % 256 - o_orderkey % 200) ** 2 + (o_orderkey % 256 - o_custkey % 200) ** 2 + ((o_custkey + o_orderkey) % 256 - o_orderkey % 97) ** 2) AS d FROM orders)
SELECT k, a, round(d, 6) AS d, CASE WHEN d >= 120 THEN a ELSE '#45C7F5' END AS shown FROM c""")
def q_team_colors(spark, sf_dir):
    K, C, _ = columns()
    a, b = F.format_string("#%02X%02X%02X", C % 256, K % 256, (C + K) % 256), F.format_string("#%02X%02X%02X", K % 200, C % 200, K % 97)
    rows = orders(spark, sf_dir).select(K.alias("k"), a.alias("a"), b.alias("b"))
    return rows.select("k", "a", F.round(tracking.color_distance(F.col("a"), F.col("b")), 6).alias("d"), tracking.team_colors(F.col("a"), F.col("b"), "#45C7F5", "#F279C8")[0].alias("shown"))


@query("""WITH h AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN 'dark' ELSE 'hue' END AS ka, (o_custkey % 180)::DOUBLE AS a, CASE WHEN o_custkey % 7 = 0 THEN 'dark' ELSE 'hue' END AS kb, (o_orderkey % 180)::DOUBLE AS b FROM orders)
SELECT k, CASE WHEN ka <> kb THEN 180.0 WHEN ka = 'dark' THEN 0.0 ELSE least(abs(a - b), 180 - abs(a - b)) END AS d FROM h""")
def q_hue_distance(spark, sf_dir):
    K, C, _ = columns()
    kinds = [F.when(C % n == 0, "dark").otherwise("hue") for n in (5, 7)]
    return orders(spark, sf_dir).select(K.alias("k"), tracking.hue_distance(kinds[0], (C % 180).cast("double"), kinds[1], (K % 180).cast("double")).alias("d"))


@query("""WITH d AS (SELECT o_orderkey AS k, (200 + o_custkey % 1800)::INT AS w, (100 + o_orderkey % 900)::INT AS h FROM orders), s AS (SELECT *, least(640 / w, 384 / h) AS s FROM d),
c AS (SELECT *, greatest(1, least(640, round_even(w * s, 0)::INT)) AS cw, greatest(1, least(384, round_even(h * s, 0)::INT)) AS ch FROM s)
SELECT k, round(cw / w, 6) AS scale_x, (640 - cw) // 2 AS left, (384 - ch) // 2 AS top, round(10 * (cw / w) + (640 - cw) // 2, 6) AS x1, round(((20 * (ch / h) + (384 - ch) // 2) - (384 - ch) // 2) / (ch / h), 6) AS back FROM c""".replace("AS left", 'AS "left"'))
def q_letterbox(spark, sf_dir):
    K, C, _ = columns()
    rows = orders(spark, sf_dir).select(K.alias("k"), (200 + C % 1800).cast("int").alias("w"), (100 + K % 900).cast("int").alias("h"))
    fit = geo.letterbox(F.col("w"), F.col("h"), 640, 384)
    box = geo.place([F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0)], fit)
    return rows.select("k", F.round(fit["scale_x"], 6).alias("scale_x"), fit["left"].alias("left"), fit["top"].alias("top"), F.round(box[0], 6).alias("x1"), F.round(geo.unplace(box, fit)[1], 6).alias("back"))


@query("""WITH b AS (SELECT o_orderkey AS k, (o_custkey % 50)::DOUBLE AS x1, (o_orderkey % 40)::DOUBLE AS y1, (o_custkey % 50 + 37)::DOUBLE AS x2, (o_orderkey % 40 + 91)::DOUBLE AS y2, o_custkey % 3 <> 0 AS ok FROM orders),
t AS (SELECT *, CASE WHEN ok THEN x1 + 5 ELSE x1 END AS l, CASE WHEN ok THEN x2 - 5 ELSE x2 END AS r, CASE WHEN ok THEN y1 + 20 ELSE y1 END AS u, CASE WHEN ok THEN y2 - 30 ELSE y2 END AS v FROM b)
SELECT k, CASE WHEN ok THEN round_even(l + 0.10 * (r - l), 0) ELSE round_even(l + 0.22 * (r - l), 0) END::INT AS x1, CASE WHEN ok THEN round_even(v - 0.08 * (v - u), 0) ELSE round_even(u + 0.56 * (v - u), 0) END::INT AS y2 FROM t""")
def q_torso(spark, sf_dir):
    K, C, _ = columns()
    x1, y1 = (C % 50).cast("double"), (K % 40).cast("double")
    x2, y2 = x1 + 37, y1 + 91
    rows = orders(spark, sf_dir).select(K.alias("k"), F.array(x1, y1, x2, y2).alias("box"), (C % 3 != 0).alias("ok"))
    b = F.col("box")
    left, right, up, low = b[0] + 5, b[2] - 5, b[1] + 20, b[3] - 30
    points = F.array(*[F.array({5: left, 11: left}.get(i, right), {5: up, 6: up}.get(i, low)) for i in range(13)])
    t = geo.torso(b, points, F.array(*[F.col("ok")] * 13))
    return rows.select("k", t[0].alias("x1"), t[3].alias("y2"))


MATRIX = "q AS (SELECT o_orderkey AS k, 1 + (o_custkey % 5) / 10 AS a, (o_custkey % 7) / 50 AS b, 2.0 AS c, (o_orderkey % 3) / 20 AS d, 1.5 AS e, (o_custkey % 11)::DOUBLE AS f, 0.001 AS g, (o_orderkey % 4) / 1000 AS h, 1.0 AS i FROM orders)"


def matrices(spark, sf_dir):
    K, C, _ = columns()
    m = F.array(F.array(1 + (C % 5) / 10, (C % 7) / 50, F.lit(2.0)), F.array((K % 3) / 20, F.lit(1.5), (C % 11).cast("double")), F.array(F.lit(0.001), (K % 4) / 1000, F.lit(1.0)))
    return orders(spark, sf_dir).select(K.alias("k"), m.alias("m"))


@query(f"""WITH {MATRIX}, t AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM q)
SELECT k, round((a * 3 + b * 4 + c) / (g * 3 + h * 4 + i), 6) AS x, round((d * 3 + e * 4 + f) / (g * 3 + h * 4 + i), 6) AS y, round((e * i - f * h) / det, 6) AS i00, round((c * h - b * i) / det, 6) AS i01, round((d * h - e * g) / det, 6) AS i20 FROM t""")
def q_frame_homography(spark, sf_dir):
    m = F.col("m")
    x, y = geo.project(m, F.lit(3.0), F.lit(4.0))
    inv = geo.inverse(m)
    return matrices(spark, sf_dir).select("k", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(inv[0][0], 6).alias("i00"), F.round(inv[0][1], 6).alias("i01"), F.round(inv[2][0], 6).alias("i20"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey % 100 AS x, o_orderkey % 60 AS y, 20 + o_custkey % 30 AS h, 20 + o_orderkey % 50 AS g FROM orders) SELECT k, round(sqrt((x + 5 - y - 7) ** 2 + (x + h - y - g) ** 2) / greatest(h, g), 6) AS d FROM b""")
def q_foot_distance(spark, sf_dir):
    K, C, _ = columns()
    x, y, h, g = (v.cast("double") for v in (C % 100, K % 60, 20 + C % 30, 20 + K % 50))
    return orders(spark, sf_dir).select(K.alias("k"), F.round(geo.foot_distance([x, x, x + 10, x + h], [y, y, y + 14, y + g]), 6).alias("d"))


@query("""WITH q AS (SELECT o_orderkey AS k, 10 + o_custkey % 9 AS s, (o_orderkey % 23)::DOUBLE AS x, (o_custkey % 17)::DOUBLE AS y FROM orders)
SELECT k, round(s * s / 2.0, 6) AS area, round(CASE WHEN x > 0 AND y > 0 AND x + y < s THEN least(x, y, (s - x - y) / sqrt(2)) ELSE 0 END, 6) AS inside FROM q""")
def q_polygon(spark, sf_dir):
    K, C, _ = columns()
    s = (10 + C % 9).cast("double")
    zero = F.lit(0.0)
    rows = orders(spark, sf_dir).select(K.alias("k"), F.array(F.array(zero, zero), F.array(s, zero), F.array(zero, s)).alias("p"), (K % 23).cast("double").alias("x"), (C % 17).cast("double").alias("y"))
    return rows.select("k", F.round(geo.polygon_area(F.col("p")), 6).alias("area"), F.round(F.greatest(zero, geo.polygon_distance(F.col("p"), F.col("x"), F.col("y"))), 6).alias("inside"))


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey % 7 AS a, 5 + o_custkey % 9 AS b FROM orders), o AS (SELECT k, b AS pa, 12 AS pb, greatest(0, least(a + b, 20) - greatest(a, 8)) AS ovl FROM m)
SELECT k, pa, ovl AS overlap, round(ovl / (pa + pb - ovl), 6) AS iou, round(2 * ovl / (pa + pb), 6) AS dice FROM o WHERE ovl > 0""")
def q_mask_agreement(spark, sf_dir):
    K, C, _ = columns()
    roi = F.array(*map(F.lit, (3, 5, 13, 9)))
    first, second = F.array((C % 7).cast("int"), (5 + C % 9).cast("int"), (40 - C % 7 - 5 - C % 9).cast("int")), F.array(*map(F.lit, (8, 12, 20)))
    side = lambda counts: orders(spark, sf_dir).where(geo.mask_valid(F.lit("roi_rle_c"), roi, counts, F.lit(20), F.lit(20))).select(K.alias("k"), geo.mask_runs(roi, counts).alias("runs"), geo.mask_area(counts).alias("n"))
    a, b = side(first), side(second)
    rows = evaluation.mask_overlaps(a, b, "k").where("overlap > 0").join(a.select("k", F.col("n").alias("pa")), "k")
    got = evaluation.mask_agreement(F.col("overlap"), F.col("pa"), F.lit(12))
    return rows.select("k", "pa", "overlap", F.round(got["iou"], 6).alias("iou"), F.round(got["dice"], 6).alias("dice"))


@query("""WITH q AS (SELECT o_orderkey AS k, (o_custkey % 10)::VARCHAR AS a, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE (o_orderkey % 10)::VARCHAR END AS b, CASE WHEN o_custkey % 5 <> 0 THEN '' ELSE '3' END AS c, 0.9 AS p, (o_custkey % 10) / 10 AS r FROM orders),
t AS (SELECT k, CASE WHEN b = '' THEN a WHEN c = '' THEN a || b ELSE a || b || c END AS text, b = '' OR c = '' AS ended, CASE WHEN b = '' THEN p * r ELSE p * r * 0.5 END AS sure FROM q)
SELECT k, text, CASE WHEN ended AND regexp_full_match(text, '[0-9]{1,2}') THEN text END AS number, round(sure, 6) AS confidence FROM t""")
def q_digits(spark, sf_dir):
    K, C, _ = columns()
    symbols = F.array((C % 10).cast("string"), F.when(C % 4 == 0, "").when(C % 4 == 1, "x").otherwise((K % 10).cast("string")), F.when(C % 5 != 0, "").otherwise("3"))
    got = orders(spark, sf_dir).select(K.alias("k"), geo.digits_of(symbols, F.array(F.lit(0.9), (C % 10) / 10, F.lit(0.5))).alias("d"))
    return got.select("k", "d.text", "d.number", F.round("d.confidence", 6).alias("confidence"))


@query("""WITH q AS (SELECT o_orderkey AS k, o_custkey % 4 AS i, o_orderkey % 3 AS j FROM orders) SELECT k, i / 2.0 AS x, j / 2.0 AS y, round((0.5 + o.c) / 2, 6) AS score FROM q, (SELECT 0.3 AS c) o""")
def q_pose_decode(spark, sf_dir):
    K, C, _ = columns()
    one = lambda at, n, top: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == at, top).otherwise(0.0))
    x, y, score = geo.simcc(one(C % 4, 4, 0.5), one(K % 3, 3, 0.3))
    return orders(spark, sf_dir).select(K.alias("k"), x.alias("x"), y.alias("y"), F.round(score, 6).alias("score"))


@query("""WITH q AS (SELECT o_orderkey AS k, greatest(0, least(11, round_even(o_totalprice / 40000, 0)::INT)) AS cx, greatest(0, least(7, round_even(o_totalprice / 60000, 0)::INT)) AS cy FROM orders)
SELECT k, count(*) FILTER ((i % 12 - cx) ** 2 + (i // 12 - cy) ** 2 <= 2 * 0.7 * ln(255) AND abs(i % 12 - cx) <= 2 AND abs(i // 12 - cy) <= 2) AS set FROM q, range(96) t(i) GROUP BY k""".replace("AS set", 'AS "set"'))
def q_target_map(spark, sf_dir):
    K, _, V = columns()
    got = geo.target_map(V / 40000, V / 60000, 12, 8, 2, 0.7)
    return orders(spark, sf_dir).select(K.alias("k"), F.size(F.filter(got, lambda v: v == 255)).cast("long").alias("set"))


@query("""SELECT o_orderkey AS k, o_orderkey // 9 AS segment, o_custkey AS track, 'run:' || o_orderkey || ':' || o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'home' END AS team FROM orders""")
def q_keys(spark, sf_dir):
    K, C, _ = columns()
    segment, track = text.track_key(F.concat_ws(":", F.floor(K / 9).cast("string"), C.cast("string")))
    who = F.when(C % 3 == 0, F.concat(F.lit("roster:home:"), (C % 10).cast("string"))).otherwise(F.concat(F.lit("anonymous-s0-t"), C.cast("string")))
    return orders(spark, sf_dir).select(K.alias("k"), segment.alias("segment"), track.alias("track"), text.observation_id(F.lit("run"), K, C).alias("id"), text.roster_subject(who)[0].alias("team"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_totalprice / 37 AS t, (1 + o_custkey % 7)::INT AS p FROM orders) SELECT k, lpad(floor(t / 60)::INT::VARCHAR, 2, '0') || ':' || lpad(printf('%.2f', t - floor(t / 60) * 60), 5, '0') AS video,
CASE WHEN p <= 4 THEN 'Q' || p ELSE 'OT' || (p - 4) END AS period, floor(k / 60)::INT || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS clock FROM s""")
def q_labels(spark, sf_dir):
    K, C, V = columns()
    return orders(spark, sf_dir).select(K.alias("k"), text.minutes_label(V / 37).alias("video"), text.period_label((1 + C % 7).cast("int")).alias("period"), text.game_clock_label(K.cast("double")).alias("clock"))


@query("""SELECT o_orderkey AS k, 'clip' || o_custkey AS stem, '.mp4' AS suffix, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' END AS split, 'data/' || CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'misc' END || '/m1' AS nearest FROM orders""")
def q_paths(spark, sf_dir):
    K, C, _ = columns()
    folder = F.when(C % 3 == 0, "train").when(C % 3 == 1, "val").otherwise("misc")
    path = F.concat_ws("/", F.lit("data"), folder, F.lit("m1"), F.concat(F.lit("clip"), C.cast("string"), F.lit(".MP4")))
    return orders(spark, sf_dir).select(K.alias("k"), text.path_stem(path).alias("stem"), text.path_suffix(path).alias("suffix"), text.split_of(path, ["train", "val"]).alias("split"), text.ancestors(path)[0].alias("nearest"))


@query("""SELECT o_orderkey AS k, round(o_totalprice / 1e6, 6) AS recall, CAST(NULL AS DOUBLE) AS missing, o_orderstatus AS status, 'x' AS deep, 2 AS kept FROM orders""")
def q_documents(spark, sf_dir):
    K, _, V = columns()
    doc = F.to_json(F.struct(F.struct(F.struct((V / 1e6).alias("recall"), F.lit(True).alias("flag")).alias("global")).alias("metrics"), F.col("o_orderstatus").alias("status"), F.struct(F.struct(F.lit("x").alias("b")).alias("a")).alias("p")))
    rows = orders(spark, sf_dir).select(K.alias("k"), doc.alias("doc"))
    flat = text.flattened(F.col("doc"))
    kept = text.without_private(text.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("_b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(2), F.lit("c"), F.lit(3))))
    return rows.select("k", F.round(text.metric_at(F.col("doc"), ["metrics", "global", "recall"]), 6).alias("recall"), text.metric_at(F.col("doc"), ["metrics", "global", "flag"]).alias("missing"), flat["status"].alias("status"), flat["p.a.b"].alias("deep"), F.size(kept).alias("kept"))


@query("""WITH s AS (SELECT o_custkey % 50 AS game, o_orderkey AS at, 'p' || o_orderkey % 9 AS a, 'p' || o_orderkey % 7 AS b FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 9 <> o_orderkey % 7)
SELECT game, "at", a AS incoming, b AS outgoing FROM s""".replace("AS at,", 'AS "at",'))
def q_substitutions(spark, sf_dir):
    K, C, _ = columns()
    a, b = (F.concat(F.lit("p"), (K % n).cast("string")) for n in (9, 7))
    line = F.when(C % 3 == 0, F.concat_ws(" enters the game for ", a, b)).otherwise("made a shot")
    plays = orders(spark, sf_dir).where(K % 9 != K % 7).select((C % 50).alias("game"), K.alias("at"), line.alias("text"))
    return identity.lineup_changes(plays, ["game"], "at", "text")


@query("""WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 100)::DOUBLE END AS cx, (o_orderkey % 60)::DOUBLE AS cy, 4.0 AS r, o_custkey % 3 = 0 AS occluded, o_custkey % 11 = 0 AS excluded FROM orders)
SELECT k, CASE WHEN cx IS NULL THEN 'unknown_position' WHEN occluded THEN 'occluded_with_position' ELSE 'visible' END AS status, CASE WHEN cx IS NOT NULL AND NOT excluded THEN cx * 2 END AS target_x, CASE WHEN cx IS NOT NULL AND NOT excluded THEN greatest(0, cx - r) * 2 END AS x1,
CASE WHEN cx IS NOT NULL AND NOT excluded THEN least(60, cy + r) * 2 + 20 END AS y2 FROM q""")
def q_ball_records(spark, sf_dir):
    K, C, _ = columns()
    rows = orders(spark, sf_dir).select(K.alias("k"), F.when(C % 5 != 0, (C % 100).cast("double")).alias("cx"), (K % 60).cast("double").alias("cy"), F.lit(4.0).alias("radius"), (C % 3 == 0).alias("occluded"), (C % 11 == 0).alias("excluded"), F.lit(100).alias("width"), F.lit(60).alias("height"))
    got = frames.ball_record(rows, geo.letterbox(F.col("width"), F.col("height"), 200, 160))
    return got.select("k", "status", "target_x", F.col("box")[0].alias("x1"), F.col("box")[3].alias("y2"))
