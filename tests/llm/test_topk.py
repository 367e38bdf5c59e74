import math
import random

import numpy as np
from pyspark.sql import functions as F

from playframe.llm import topk


def test_large_components_and_ties(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(4, 7) for _ in range(6)]) for i in range(40)]
    rows += [(301, [0.0, 0.0, 0.0, 0.0, 2.0**26 + 0.25, -0.0]), (310, [20_000.0] * 6), (320, [0.0] * 5 + [3.5e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_inner_products(df, F.col("vec_id") % 10 == 0, top=5, block=50, group=7).collect()
    vectors = {i: [math.floor(64 * x) for x in v] + [0] * (6 - len(v)) for i, v in rows}
    want = []
    for q in vectors:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(vectors[q], w)), i) for i, w in vectors.items() if i != q)[:5]
            want += [(q, k, i, -x) for k, (x, i) in enumerate(best, 1)]
    assert max(abs(w[3]) for w in want) < 2**63 and max(max(map(abs, v)) for v in vectors.values()) > 2**31
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_many_terms_with_ties():
    scores = np.array([[2**61, 2**61, 5, 2**61, -(2**61)]])
    ((_, _, ids, best),) = topk._best(scores, np.array([[9, 9]]), np.arange(5), np.arange(5), 2)
    assert ids.tolist() == [0, 1] and best.tolist() == [2**61] * 2


def test_rows_count_not_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_inner_products(df, F.col("vec_id") == 20, top=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(20, 1, 3, 8192), (20, 2, 3, 8192), (20, 3, 20, 4096)] * 2)
