import random
from collections import Counter

from playframe.llm import mixing


def test_whole_documents(spark):
    rng = random.Random(4)
    rows = [(i, "  \n".join(f"w{i}" for _ in range(rng.randint(1, 30))) + "\t", rng.choice("aaabbc")) for i in range(200)]
    rows += [(500, "long " * 4000, "a"), (501, "long\n" * 4000, "b"), (502, "long  " * 4000, "c")]
    rows += [(600 + i, text, source) for i, (text, source) in enumerate((t, s) for t in (None, "", " \n") for s in "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    got = [(r.doc_id, r.text, r.source) for r in mixing.materialise_mix(df, whole=True).collect()]
    assert set(got) <= set(rows)
    times = Counter(i for i, _, _ in got)
    for source in "abc":
        own = [r for r in rows if r[2] == source]
        sized = [i for i, _, _ in own if plan[i]["size"]]
        wholes = min(plan[i].taken // plan[i]["size"] for i in sized)
        cut = [i for i in sized if plan[i].taken % plan[i]["size"]]
        assert len(cut) <= 1
        for i in sized:
            n, rest = divmod(plan[i].taken, plan[i]["size"])
            assert times[i] == n + (2 * rest >= plan[i]["size"])
        words = sum(times[i] * plan[i]["size"] for i in sized)
        assert abs(words - plan[sized[0]].target) <= max((plan[i]["size"] for i in cut), default=0) / 2 + 1
        for i in (r[0] for r in own if not plan[r[0]]["size"]):
            assert wholes <= times[i] <= wholes + 1
    cut_mode = Counter(r.doc_id for r in mixing.materialise_mix(df).collect())
    assert all(cut_mode[i] == times[i] for i in range(600, 609)) and sum(cut_mode[i] for i in range(600, 609)) > 0


def test_rows_of_one_id_are_shared_whole(spark):
    rows = [(1, " ".join([f"t{i}"] * 10), "a" if i % 8 else "b") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {r.source_size: r.target for r in mixing.mix(df).collect()}
    for source in "ab":
        own = [r for r in mixing.materialise_mix(df, whole=True).collect() if r.source == source]
        size = sum(10 for _, _, s in rows if s == source)
        assert all(len(r.text.split()) == 10 for r in own)
        assert abs(10 * len(own) - target[size]) < 0.1 * size
