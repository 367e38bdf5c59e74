"""Queries of the evaluation, scoreboard and contract operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.operators import contracts, evaluation, scoreboard
from playframe.plans.bindings import query, r6, table
from playframe.plans.tracking import P, persons
from playframe.sources import exports, runs

RATIO = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"

OUTCOMES = """o AS (SELECT l_orderkey // 4 AS frame, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS venue, l_linestatus AS kind, CASE WHEN l_quantity < 30 THEN 'tp' WHEN l_quantity < 42 THEN 'fp' ELSE 'fn' END AS outcome,
  CASE WHEN l_quantity < 42 THEN l_extendedprice END AS score FROM lineitem)"""


def outcomes(spark, sf_dir):
    q = F.col("l_quantity")
    outcome = F.when(q < 30, "tp").when(q < 42, "fp").otherwise("fn")
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_id"), F.col("l_returnflag").alias("venue"), F.col("l_linestatus").alias("kind"), outcome.alias("outcome"), F.when(q < 42, F.col("l_extendedprice")).alias("score"))
    return rows.withColumn("iou_threshold", F.lit(0.5))


@query(f"""WITH {OUTCOMES}, c AS (SELECT venue, outcome, count(*) FILTER (outcome = 'tp') OVER w AS tp, row_number() OVER w AS seen FROM o WHERE outcome <> 'fn' WINDOW w AS (PARTITION BY venue ORDER BY score DESC, frame, id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT venue, count(*) AS support FROM o WHERE outcome <> 'fp' GROUP BY 1), r AS (SELECT venue, support, tp::DOUBLE / support AS recall, tp / seen AS precision FROM c JOIN s USING (venue)),
g AS (SELECT venue, support, i, coalesce((SELECT max(precision) FROM r WHERE r.venue = s.venue AND r.recall >= i / 100.0 - 1e-12), 0) AS p FROM s, range(101) t(i))
SELECT venue, support, round(avg(p), 6) AS ap FROM g GROUP BY ALL""")
def q_average_precision(spark, sf_dir):
    found = evaluation.average_precision(outcomes(spark, sf_dir), ["venue"], "frame")
    return found.select("venue", "support", r6("ap"))


@query(f"""WITH {OUTCOMES}, u AS (SELECT 'all' AS cohort, 'all' AS value, outcome FROM o UNION ALL SELECT 'venue', venue, outcome FROM o UNION ALL SELECT 'kind', kind, outcome FROM o UNION ALL SELECT 'tags', 'low', outcome FROM o WHERE frame % 2 = 0 UNION ALL SELECT 'tags', 'dark', outcome FROM o WHERE frame % 3 = 0),
c AS (SELECT cohort, value, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM u GROUP BY ALL) SELECT *, {RATIO} FROM c""")
def q_cohort_report(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    f = F.col("frame")
    tags = rows.select("frame").distinct().withColumn("tags", F.array_compact(F.array(F.when(f % 2 == 0, "low"), F.when(f % 3 == 0, "dark"))))
    found = evaluation.cohort_report(rows, tags, "frame", ["venue", "kind"], "tags")
    return found.select("cohort", "value", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(f"""WITH {OUTCOMES}, n AS (SELECT count(*) FILTER (outcome <> 'fp') AS n FROM o), c AS (SELECT t::DOUBLE * 2000 AS threshold, count(*) FILTER (outcome = 'tp' AND score >= t * 2000) AS tp, count(*) FILTER (outcome = 'fp' AND score >= t * 2000) AS fp FROM o, range(52) x(t) GROUP BY 1),
d AS (SELECT threshold, tp, fp, n - tp AS fn FROM c, n) SELECT *, {RATIO} FROM d""")
def q_score_sweep(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    found = evaluation.score_sweep(rows.where("outcome <> 'fn'"), rows.where("outcome <> 'fp'").count(), [t * 2000.0 for t in range(52)])
    return found.select("threshold", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, tied FROM (SELECT o_custkey, o_orderkey, round(o_totalprice / 50000) AS m, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 50000) DESC, o_orderkey) AS k,
count(*) OVER (PARTITION BY o_custkey, round(o_totalprice / 50000)) > 1 AS tied FROM orders) WHERE k = 1""")
def q_best_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("m", F.round(F.col("o_totalprice") / 50000))
    return evaluation.best_checkpoint(rows, "o_custkey", "m", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "tied")


@query("""WITH a AS (SELECT l_returnflag AS cohort, l_linestatus AS role, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag AS cohort, l_linestatus AS role, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT cohort, role, n AS n_a, q AS q_b FROM a JOIN b USING (cohort, role)""")
def q_paired_reports(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "cohort", "l_linestatus": "role"})
    keys = ["cohort", "role"]
    return evaluation.paired(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), rows.groupBy(*keys).agg(F.max("l_quantity").alias("q")), keys)


@query("""WITH r AS (SELECT o_custkey AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS policy, max(CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 7)::VARCHAR END) AS number FROM orders GROUP BY ALL),
p AS (SELECT x.number AS a, y.number AS b FROM r x JOIN r y ON x.sample = y.sample AND x.policy = 'x' AND y.policy = 'y') SELECT count(*) AS eligible, count(a) AS accepted_a, count(b) AS accepted_b, count(a || b) AS both, count(*) FILTER (a <> b) AS changed FROM p""")
def q_ocr_policies(spark, sf_dir):
    k = F.col("o_orderkey")
    reads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.when(k % 2 == 0, "x").otherwise("y").alias("policy"), F.when(k % 5 != 0, (k % 7).cast("string")).alias("number"))
    return evaluation.paired_policies(reads, "sample", "policy", "number", "x", "y")


BALL = """b AS (SELECT o_orderkey AS k, o_orderstatus AS clip, o_custkey % 4 AS windows, CASE WHEN o_custkey % 7 = 0 THEN 'unknown_position' WHEN o_custkey % 7 = 1 THEN 'occluded_with_position' ELSE 'visible' END AS status, o_custkey % 31 = 4 AS excluded,
  CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 100)::DOUBLE END AS tx, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 60)::DOUBLE END AS ty, CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 100 + o_orderkey % 23)::DOUBLE END AS px, CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 60 + o_orderkey % 5)::DOUBLE END AS py FROM orders)"""


def judged(limit, source="b"):
    return f"""SELECT *, CASE WHEN tx IS NOT NULL AND px IS NOT NULL THEN sqrt((px - tx) ** 2 + (py - ty) ** 2) END AS error, CASE WHEN windows = 0 THEN 'uncovered' WHEN excluded OR status = 'unknown_position' THEN 'ignored' WHEN tx IS NULL THEN CASE WHEN px IS NULL THEN 'tn' ELSE 'fp' END
  WHEN px IS NULL THEN 'fn' WHEN sqrt((px - tx) ** 2 + (py - ty) ** 2) <= {limit} THEN 'tp' ELSE 'displaced' END AS outcome FROM {source}"""


SUMMARY = """count(*) AS frames, count(*) FILTER (outcome = 'uncovered') AS uncovered, count(*) FILTER (outcome = 'ignored') AS ignored, count(tx) AS known, count(tx) FILTER (outcome <> 'uncovered') AS known_covered, count(*) FILTER (outcome = 'tp') AS tp,
count(*) FILTER (outcome IN ('fp', 'displaced')) AS fp, count(*) FILTER (outcome IN ('fn', 'displaced')) AS fn, round(avg(error) FILTER (outcome IN ('tp', 'displaced')), 6) AS error_mean, round(quantile_cont(error, 0.5) FILTER (outcome IN ('tp', 'displaced')), 6) AS error_median, round(quantile_cont(error, 0.95) FILTER (outcome IN ('tp', 'displaced')), 6) AS error_p95"""
SHOWN = ["frames", "uncovered", "ignored", "known", "known_covered", "tp", "fp", "fn"]


def ball(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(c % 7 == 0, "unknown_position").when(c % 7 == 1, "occluded_with_position").otherwise("visible")
    there, seen = c % 7 != 0, k % 9 != 0
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_orderstatus").alias("clip"), (c % 4).alias("windows"), status.alias("status"), (c % 31 == 4).alias("excluded"), F.when(there, (c % 100).cast("double")).alias("tx"), F.when(there, (c % 60).cast("double")).alias("ty"),
        F.when(seen, (c % 100 + k % 23).cast("double")).alias("px"), F.when(seen, (c % 60 + k % 5).cast("double")).alias("py"),
    )


@query(f"WITH {BALL}, j AS ({judged(15)}) SELECT k, outcome, round(error, 6) AS error FROM j")
def q_ball_outcomes(spark, sf_dir):
    return evaluation.ball_outcomes(ball(spark, sf_dir)).select("k", "outcome", r6("error"))


@query(f"""WITH {BALL}, j AS ({judged(15)}), u AS (SELECT 'all' AS cohort, 'all' AS value, * FROM j UNION ALL SELECT 'clip', clip, * FROM j UNION ALL SELECT 'status', status, * FROM j) SELECT cohort, value, {SUMMARY} FROM u GROUP BY ALL
UNION ALL SELECT 'status', 'absent', 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL""")
def q_ball_report(spark, sf_dir):
    found = evaluation.ball_report(evaluation.ball_outcomes(ball(spark, sf_dir)), ["clip"], ["visible", "occluded_with_position", "unknown_position", "absent"])
    return found.select("cohort", "value", *SHOWN, r6("error_mean"), r6("error_median"), r6("error_p95"))


@query(f"WITH {BALL}, s AS (SELECT b.*, t::DOUBLE AS tolerance FROM b, (VALUES (5), (10), (15), (20)) x(t)), j AS ({judged('tolerance', 's')}) SELECT tolerance, {SUMMARY} FROM j GROUP BY tolerance")
def q_ball_tolerances(spark, sf_dir):
    found = evaluation.tolerance_sensitivity(ball(spark, sf_dir), [5, 10, 15, 20])
    return found.select("tolerance", *SHOWN, r6("error_mean"), r6("error_median"), r6("error_p95"))


@query("""WITH w AS (SELECT l_orderkey // 3 AS frame, [(l_quantity % 7)::DOUBLE, l_discount * 50, (l_linenumber)::DOUBLE] AS cells FROM lineitem), c AS (SELECT frame, i - 1 AS cell, avg(cells[i]) AS v, count(*) AS n FROM w, range(1, 4) t(i) GROUP BY ALL)
SELECT frame, arg_max(cell, (round(v, 9), -cell)) AS cell, round(max(v), 6) AS value, max(n) AS windows FROM c GROUP BY frame""")
def q_averaged_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 3).alias("frame"), F.array((F.col("l_quantity") % 7).cast("double"), F.col("l_discount") * 50, F.col("l_linenumber").cast("double")).alias("cells"))
    return evaluation.averaged_maps(rows, ["frame"]).select("frame", "cell", r6("value"), "windows")


@query(f"""WITH {P}, t AS (SELECT segment_id, frame_index, track_id::VARCHAR AS person_id, CASE WHEN c % 5 <> 0 THEN (track_id * 10 + CASE WHEN frame_index % 40 < 20 THEN 0 ELSE c % 2 END)::VARCHAR END AS track FROM p),
s AS (SELECT *, coalesce(lag(frame_index) OVER w = frame_index - 1, false) AS cons, last_value(track IGNORE NULLS) OVER (PARTITION BY segment_id, person_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(track) OVER w AS pt FROM t WINDOW w AS (PARTITION BY segment_id, person_id ORDER BY frame_index))
SELECT person_id, count(*) FILTER (track IS NOT NULL AND cons AND last <> track) AS id_switches, count(*) FILTER (track IS NOT NULL AND cons AND last IS NOT NULL AND pt IS NULL) AS fragmentations FROM s GROUP BY 1""")
def q_track_states(spark, sf_dir):
    rows = persons(spark, sf_dir).withColumn("person_id", F.col("track_id").cast("string"))
    turn = F.when(F.col("frame_index") % 40 < 20, 0).otherwise(F.col("c") % 2)
    matched = rows.where("c % 5 <> 0").select("frame_index", "person_id", (F.col("track_id") * 10 + turn).cast("string").alias("track"))
    states = evaluation.track_states(rows.select("segment_id", "frame_index", "person_id"), matched)
    n = lambda c: F.sum(F.col(c).cast("long"))
    return states.groupBy("person_id").agg(n("switched").alias("id_switches"), n("fragmented").alias("fragmentations"))


@query(f"""WITH {P}, a AS (SELECT team, c % 13 <> 0 AS truth, known AND c % 13 <> 0 AS known, c % 3 = 0 AS accepted, c % 3 = 0 AND c % 2 = 0 AS correct, c % 7 <> 0 AS matched FROM p),
n AS (SELECT team, count(*) FILTER (truth AND known) AS known_truths, count(*) FILTER (accepted AND (NOT truth OR known)) AS evaluable, count(*) FILTER (truth AND known AND accepted AND correct) AS correct_identities, count(*) FILTER (truth AND known AND accepted) AS accepted_known FROM a GROUP BY team)
SELECT team, known_truths, evaluable, correct_identities, round(correct_identities / evaluable, 6) AS precision, round(correct_identities / known_truths, 6) AS correct_coverage, round(accepted_known / known_truths, 6) AS accepted_coverage FROM n""")
def q_identity_acceptance(spark, sf_dir):
    c = F.col("c")
    rows = persons(spark, sf_dir).select("team", (c % 13 != 0).alias("truth"), (F.col("known") & (c % 13 != 0)).alias("known"), (c % 3 == 0).alias("accepted"), (c % 6 == 0).alias("correct"), (c % 7 != 0).alias("matched"))
    found = evaluation.acceptance(rows, ["team"])
    return found.select("team", "known_truths", "evaluable", "correct_identities", r6("precision"), r6("correct_coverage"), r6("accepted_coverage"))


BOARD = """s AS (SELECT o_orderkey // 50 AS game, (o_orderkey % 50)::DOUBLE / 2 AS time_s, CASE WHEN o_custkey % 9 <> 0 THEN (1 + (o_orderkey % 50) // 20)::INT END AS period, CASE WHEN o_custkey % 9 <> 0 AND o_custkey % 4 <> 0 THEN ((o_orderkey % 50) // 7 * 2)::INT END AS a FROM orders)"""


def board(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = k % 50
    score = F.when((c % 9 != 0) & (c % 4 != 0), F.create_map(F.lit("a"), (F.floor(at / 7) * 2).cast("int"), F.lit("b"), F.lit(0)))
    return table(spark, sf_dir, "orders").select(F.floor(k / 50).alias("game"), (at.cast("double") / 2).alias("time_s"), F.when(c % 9 != 0, (1 + F.floor(at / 20)).cast("int")).alias("period"), score.alias("scores"), F.when(c % 9 != 0, (700 - at.cast("double") / 2)).alias("clock_s"))


@query(f"WITH {BOARD}, k AS (SELECT *, lag((period, a)) OVER (PARTITION BY game ORDER BY time_s) AS p FROM s WHERE a IS NOT NULL) SELECT game, time_s, a FROM k WHERE (period, a) IS DISTINCT FROM p")
def q_score_changes(spark, sf_dir):
    return scoreboard.changes(board(spark, sf_dir), ["game"]).select("game", "time_s", F.col("scores")["a"].alias("a"))


@query(f"""WITH {BOARD}, u AS (SELECT game, period, time_s AS a0, least(time_s + 0.755, coalesce(lead(time_s) OVER (PARTITION BY game ORDER BY time_s), 'infinity'::DOUBLE)) AS z FROM s), v AS (SELECT * FROM u WHERE period IS NOT NULL),
n AS (SELECT *, (coalesce(abs(a0 - lag(z) OVER w) <= 1e-6 AND period = lag(period) OVER w, false))::INT AS j FROM v WINDOW w AS (PARTITION BY game ORDER BY a0)), i AS (SELECT *, sum(1 - j) OVER (PARTITION BY game ORDER BY a0) AS g FROM n)
SELECT game, period, round(min(a0), 6) AS start_s, round(max(z), 6) AS end_s FROM i GROUP BY game, period, g""")
def q_period_spans(spark, sf_dir):
    return scoreboard.period_spans(board(spark, sf_dir), ["game"], 0.5).select("game", "period", r6("start_s"), r6("end_s"))


@query("""WITH w AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 5 END AS v FROM orders), r AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 7 <> 0 THEN CASE WHEN o_custkey % 11 = 0 THEN 9 ELSE o_custkey % 5 END END AS v FROM orders WHERE o_orderkey % 10 <> 3)
SELECT count(*) FILTER (w.v = r.v) AS agree, count(*) FILTER (r.v IS NOT NULL AND w.v IS DISTINCT FROM r.v) AS wrong, count(*) FILTER (w.v IS NOT NULL AND r.v IS NULL) AS unavailable, count(*) FILTER (w.v IS NULL AND r.v IS NULL) AS expected_missing FROM w LEFT JOIN r ON r.k = w.k""")
def q_scoreboard_audit(spark, sf_dir):
    k, c = F.col("o_orderkey").alias("k"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders")
    return scoreboard.audit(rows.select(k, F.when(c % 6 != 0, c % 5).alias("v")), rows.where("o_orderkey % 10 <> 3").select(k, F.when(c % 7 != 0, F.when(c % 11 == 0, 9).otherwise(c % 5)).alias("v")), "k", "v")


@query(f"""WITH {P}, u AS (SELECT frame_index, 'repeated_identity' AS rule FROM p WHERE known GROUP BY frame_index, team, number HAVING count(*) > 1 UNION ALL SELECT frame_index, 'suppressed_identity' FROM p WHERE c % 17 = 0 AND known
UNION ALL SELECT frame_index, 'observation_id' FROM p WHERE c % 41 = 0) SELECT frame_index, rule, count(*) AS n FROM u GROUP BY ALL""")
def q_sequence_rules(spark, sf_dir):
    name = F.concat_ws(":", F.lit("r"), F.col("frame_index").cast("string"), F.when(F.col("c") % 41 == 0, "x").otherwise(F.col("track_id").cast("string")))
    rows = persons(spark, sf_dir).withColumn("suppressed", F.col("c") % 17 == 0).withColumn("n", F.col("track_id")).withColumn("observation_id", name)
    return contracts.sequence_violations(rows, "r").groupBy("frame_index", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_orderkey AS frame_index, o_totalprice AS timestamp_s FROM orders WHERE o_custkey % 50 <> 1), b AS (SELECT o_orderkey AS frame_index, CASE WHEN o_custkey % 40 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS expected_s FROM orders WHERE o_custkey % 60 <> 5)
SELECT coalesce(a.frame_index, b.frame_index) AS frame_index, timestamp_s, expected_s FROM a FULL JOIN b ON a.frame_index = b.frame_index WHERE timestamp_s IS DISTINCT FROM expected_s""")
def q_time_mismatches(spark, sf_dir):
    k, c, v = F.col("o_orderkey").alias("frame_index"), F.col("o_custkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders")
    return contracts.time_mismatches(rows.where("o_custkey % 50 <> 1").select(k, v.alias("timestamp_s")), rows.where("o_custkey % 60 <> 5").select(k, F.when(c % 40 == 2, v + 1).otherwise(v).alias("timestamp_s")))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 40 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS v, o_orderstatus AS s FROM orders WHERE o_custkey % 60 <> 5)
SELECT a.k FROM a LEFT JOIN b USING (k) WHERE b.v IS DISTINCT FROM a.v OR b.s IS DISTINCT FROM a.s""")
def q_changed_rows(spark, sf_dir):
    k, c, v, s = F.col("o_orderkey").alias("k"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus").alias("s")
    rows = table(spark, sf_dir, "orders")
    after = rows.where("o_custkey % 60 <> 5").select(k, F.when(c % 40 == 2, v + 1).otherwise(v).alias("v"), s)
    return contracts.changed_rows(rows.select(k, v.alias("v"), s), after, ["k"], ["v", "s"])


@query("""WITH r AS (SELECT n_regionkey AS region, c_nationkey::VARCHAR AS team, (c_custkey % 45)::VARCHAR AS number, c_acctbal > 0 AS eligible FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2, 3)),
t AS (SELECT team, count(*) AS n, count(DISTINCT number) AS d, sum(eligible::INT) AS e FROM r GROUP BY team)
SELECT team, 'two_teams' AS rule FROM t WHERE (SELECT count(*) FROM t) <> 2 UNION ALL SELECT team, 'unique_numbers' FROM t WHERE n <> d UNION ALL SELECT team, 'eligible' FROM t WHERE e < 1""")
def q_roster_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_nationkey in (1, 2, 3)")
    return contracts.roster_violations(rows.select(F.col("c_nationkey").cast("string").alias("team"), (F.col("c_custkey") % 45).cast("string").alias("number"), (F.col("c_acctbal") > 0).alias("eligible")))


@query("""WITH s AS (SELECT o_orderkey::VARCHAR AS subject, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS distance, (o_custkey % 9)::DOUBLE AS measured, 6.0::DOUBLE AS tracked, CASE WHEN o_custkey % 7 = 0 THEN 'unavailable' ELSE 'ok' END AS status FROM orders)
SELECT subject, 'measured_within_tracked' AS rule FROM s WHERE measured > 6 UNION ALL SELECT subject, 'distance_needs_measured' FROM s WHERE distance IS NOT NULL AND measured <= 0 UNION ALL SELECT subject, 'unavailable_is_null' FROM s WHERE (distance IS NULL) <> (status = 'unavailable')""")
def q_statistics_rules(spark, sf_dir):
    c = F.col("o_custkey")
    return contracts.statistics_violations(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("subject"), F.when(c % 5 != 0, F.col("o_totalprice")).alias("distance"), (c % 9).cast("double").alias("measured"), F.lit(6.0).alias("tracked"), F.when(c % 7 == 0, "unavailable").otherwise("ok").alias("status")))


LABELS = "b AS (SELECT l_orderkey // 2 AS image, round(l_extendedprice * 100)::BIGINT * 10 + l_linenumber AS n, (l_quantity % 2)::INT AS class_id, l_quantity * 2 AS x1, l_quantity AS y1, l_quantity * 2 + 64 AS x2, l_quantity + 128 AS y2, l_orderkey % 3 = 0 AS odd FROM lineitem WHERE l_orderkey % 5 = 0)"


def label_boxes(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0").select(F.floor(F.col("l_orderkey") / 2).alias("image"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 10 + F.col("l_linenumber")).alias("n"), (q % 2).cast("int").alias("class_id"), (q * 2).alias("x1"), q.alias("y1"), (q * 2 + 64).alias("x2"), (q + 128).alias("y2"), F.lit(512).alias("width"), F.lit(256).alias("height"))


@query(f"""WITH {LABELS}, l AS (SELECT image, n, printf('%d %.8f %.8f %.8f %.8f', class_id, (x1 + x2) / 2 / 512, (y1 + y2) / 2 / 256, (x2 - x1) / 512, (y2 - y1) / 256) AS line FROM b) SELECT image, string_agg(line, chr(10) ORDER BY n, line) AS text FROM l GROUP BY image""")
def q_label_lines(spark, sf_dir):
    return exports.label_lines(label_boxes(spark, sf_dir), "image", 8)


@query(f"""WITH {LABELS}, i AS (SELECT DISTINCT image, CASE WHEN image % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM b), d AS (SELECT image, split, row_number() OVER (PARTITION BY split ORDER BY image) AS id FROM i),
a AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY image, n) AS id, d.id AS image_id, class_id + 1 AS category_id, x1, (x2 - x1) * (y2 - y1) AS area FROM b JOIN d USING (image))
SELECT split, id, image_id, category_id, x1, area FROM a""")
def q_coco_annotations(spark, sf_dir):
    rows = label_boxes(spark, sf_dir)
    images = rows.select("image", "width", "height").distinct().withColumn("split", F.when(F.col("image") % 4 == 0, "val").otherwise("train"))
    found = exports.coco(images, rows, "image", "split").where("kind = 'annotation'")
    of = F.from_json("record", "id long, image_id long, category_id int, bbox array<double>, area double").alias("r")
    return found.select("split", of).select("split", "r.id", "r.image_id", "r.category_id", F.col("r.bbox")[0].alias("x1"), "r.area")


@query("""WITH f AS (SELECT o_custkey % 20 AS clip, o_orderkey AS frame_index, o_orderkey AS image, o_totalprice AS target FROM orders WHERE o_orderkey % 6 <> 5), w AS (SELECT clip, frame_index, lag(image, 2) OVER w AS image1, lag(image) OVER w AS image2, image AS image3, target, lag(frame_index, 2) OVER w AS f0 FROM (SELECT *, 0 AS z FROM f) WINDOW w AS (PARTITION BY z ORDER BY frame_index))
SELECT frame_index, image1, image2, image3, target FROM w WHERE f0 = frame_index - 2""")
def q_triplets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 5").select(F.lit(0).alias("z"), F.col("o_orderkey").alias("frame_index"), F.col("o_orderkey").alias("image"), F.col("o_totalprice").alias("target"))
    return exports.triplets(rows, ["z"], "image", "target").drop("z")


@query("""WITH f AS (SELECT o_orderkey AS i, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g, o_custkey % 4 <> 0 AS v, o_totalprice AS x FROM orders WHERE o_orderkey % 50 <> 7)
SELECT (i - min(i) OVER (PARTITION BY g)) AS "Frame", v::INT AS "Visibility", CASE WHEN v THEN x ELSE 0 END AS "X" FROM f""")
def q_rallies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 7").select(F.lit(0).alias("z"), F.col("o_orderkey").alias("frame_index"), "o_custkey", "o_totalprice")
    return exports.rallies(rows, ["z"], F.col("o_custkey") % 4 != 0, "o_totalprice", "o_totalprice").select("Frame", "Visibility", "X")


@query("""WITH s AS (SELECT o_orderkey % 3 AS split, o_custkey % 400 AS match, o_totalprice::INT % 700 AS venue FROM orders WHERE o_custkey % 5 = 0), u AS (SELECT 'match' AS by, match::VARCHAR AS value, split FROM s UNION ALL SELECT 'venue', venue::VARCHAR, split FROM s)
SELECT by, value, count(DISTINCT split) AS splits, count(*) AS rows FROM u GROUP BY ALL HAVING count(DISTINCT split) > 1""".replace(" by,", ' "by",').replace("AS by", 'AS "by"'))
def q_split_leaks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select((F.col("o_orderkey") % 3).alias("split"), (F.col("o_custkey") % 400).alias("match"), (F.bround("o_totalprice", 0).cast("int") % 700).alias("venue"))
    return exports.split_leaks(rows, "split", ["match", "venue"])


@query("""SELECT o_orderkey AS k, 'missing' AS side FROM orders WHERE o_custkey % 90 = 3 UNION ALL SELECT o_orderkey + 1000000, 'extra' FROM orders WHERE o_custkey % 80 = 6""")
def q_export_differences(spark, sf_dir):
    # The records an export has too many of come from another source: at any size none is one of the table's.
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("source"), "o_custkey")
    exported = rows.where("o_custkey % 90 <> 3").select("k", "source").unionByName(rows.where("o_custkey % 80 = 6").select((F.col("k") + 1000000).alias("k"), F.lit("other").alias("source")))
    return exports.export_differences(rows.select("k", "source"), exported).drop("source")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_custkey % 10)::BIGINT AS s FROM orders GROUP BY 1")
def q_batched_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey")
    part = runs.in_batches(rows, 512, lambda b: b.assign(n=1, s=b["o_custkey"] % 10).groupby("o_orderstatus", as_index=False)[["n", "s"]].sum(), "o_orderstatus string, n long, s long")
    return part.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


READS = "r AS (SELECT o_custkey AS track, o_orderkey AS frame_index, o_orderkey::DOUBLE / 40 AS time_s, (o_orderkey % 7 // 3)::VARCHAR AS number, (1 + o_orderkey % 5) / 4 AS weight, 0.9 + (o_orderkey % 4) / 20 AS confidence FROM orders)"


def number_reads(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), k.alias("frame_index"), (k.cast("double") / 40).alias("time_s"), F.floor(k % 7 / 3).cast("string").alias("number"), ((1 + k % 5) / 4).alias("weight"), (0.9 + (k % 4) / 20).alias("confidence"))


@query(f"""WITH {READS}, i AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY time_s) AS i FROM r), v AS (SELECT a.track, a.frame_index, b.number, b.weight, b.i, a.i AS now FROM i a JOIN i b ON b.track = a.track AND b.i BETWEEN a.i - 7 AND a.i AND a.time_s - b.time_s <= 12),
s AS (SELECT track, frame_index, number, sum(weight) AS w, count(*) AS c FROM v GROUP BY ALL), t AS (SELECT track, frame_index, arg_max(number, (round(w, 9), number)) AS best, arg_max(c, (round(w, 9), number)) AS votes, max(w) / sum(w) AS agreement FROM s GROUP BY ALL),
l AS (SELECT track, frame_index, count(*) AS n, count(*) FILTER (i > now - 2) AS recent FROM v GROUP BY ALL), m AS (SELECT v.track, v.frame_index, bool_and(v.number = t.best) AS same FROM v JOIN t USING (track, frame_index) WHERE v.i > v.now - 2 GROUP BY ALL)
SELECT frame_index, votes, round(agreement, 6) AS agreement, CASE WHEN votes >= 2 AND n >= 2 AND same AND agreement >= 0.75 THEN best END AS decided FROM t JOIN l USING (track, frame_index) JOIN m USING (track, frame_index)""")
def q_causal_agreement(spark, sf_dir):
    from playframe.operators import evidence

    return evidence.causal_agreement(number_reads(spark, sf_dir), ["track"]).select("frame_index", F.col("votes").cast("long").alias("votes"), r6("agreement"), "decided")


@query(f"""WITH {READS}, s AS (SELECT frame_index // 1000 AS run, frame_index, time_s / 100 AS time_s, number, row_number() OVER (PARTITION BY frame_index // 1000 ORDER BY frame_index) AS i FROM (SELECT frame_index, time_s, (frame_index // 40 % 3)::VARCHAR AS number, confidence FROM r) WHERE confidence >= 0.95),
c AS (SELECT a.run, a.i, count(*) AS n, list_sort(list(b.time_s))[3] - a.time_s AS third FROM s a JOIN s b ON a.run = b.run AND b.i BETWEEN a.i AND a.i + 4 AND b.number = a.number GROUP BY a.run, a.i, a.time_s),
k AS (SELECT s.*, CASE WHEN n >= 3 AND third <= 2 THEN number END AS now FROM s JOIN c USING (run, i)),
b AS (SELECT *, last_value(now IGNORE NULLS) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) SELECT run, frame_index, sum(coalesce(now <> before, false)::INT) OVER (PARTITION BY run ORDER BY i)::BIGINT AS episode FROM b""")
def q_number_episodes(spark, sf_dir):
    from playframe.operators import evidence

    rows = number_reads(spark, sf_dir).withColumn("number", (F.floor(F.col("frame_index") / 40) % 3).cast("string")).withColumn("time_s", F.col("time_s") / 100).withColumn("run", F.floor(F.col("frame_index") / 1000))
    return evidence.number_episodes(rows, ["run"]).select("run", "frame_index", "episode")


@query(f"""WITH {P}, f AS (SELECT frame_index, any_value(timestamp_s) AS t, any_value(segment_id) AS segment_id, any_value(scene_cut) AS scene_cut, frame_index % 9 = 0 AS fitted FROM p GROUP BY frame_index),
g AS (SELECT *, sum(scene_cut::INT) OVER (PARTITION BY segment_id ORDER BY frame_index) AS shot FROM f), l AS (SELECT *, last_value(CASE WHEN fitted THEN t END IGNORE NULLS) OVER (PARTITION BY segment_id, shot ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS at_fit FROM g)
SELECT frame_index, CASE WHEN fitted THEN 'fit' WHEN t - at_fit <= 0.55 THEN 'propagated' ELSE 'unavailable' END AS court_status, CASE WHEN t - at_fit <= 0.55 THEN round(t - at_fit, 6) END AS fit_age FROM l""")
def q_calibration_states(spark, sf_dir):
    from playframe.operators import evidence

    rows = persons(spark, sf_dir).select("frame_index", "timestamp_s", "segment_id", "scene_cut").distinct().withColumn("fitted", F.col("frame_index") % 9 == 0)
    return evidence.calibration_states(rows, ["segment_id"], 0.55).select("frame_index", "court_status", r6("fit_age"))


@query(f"""WITH {P}, f AS (SELECT run_id, frame_index, any_value(included) AS included, any_value(scene_cut) AS cut, frame_index % 9 < 5 AS court, frame_index % 4 > 0 AS ball FROM p GROUP BY ALL),
a AS (SELECT run_id, count(*) AS frames, count(*) FILTER (included) AS included_frames, count(*) FILTER (court) AS court_frames, count(*) FILTER (ball) AS ball_frames, count(*) FILTER (cut) AS cuts FROM f GROUP BY run_id),
b AS (SELECT run_id, count(*) FILTER (role = 'player') AS players, count(*) FILTER (role = 'player' AND x IS NOT NULL) AS placed, count(*) FILTER (role = 'player' AND known) AS named, count(DISTINCT (segment_id, track_id)) FILTER (role = 'player') AS fragments FROM p GROUP BY run_id)
SELECT *, round(court_frames / frames, 6) AS court_share, round(placed / players, 6) AS placed_share, round(named / players, 6) AS named_share FROM a JOIN b USING (run_id)""")
def q_run_health(spark, sf_dir):
    from playframe.operators import evidence

    rows = persons(spark, sf_dir)
    f = F.col("frame_index")
    found = evidence.health(rows.select("run_id", "frame_index", "included", "scene_cut").distinct().withColumn("court_ok", f % 9 < 5).withColumn("ball_ok", f % 4 > 0), rows)
    return found.select("run_id", "frames", "included_frames", "court_frames", "ball_frames", "cuts", "players", "placed", "named", "fragments", r6("court_share"), r6("placed_share"), r6("named_share"))
