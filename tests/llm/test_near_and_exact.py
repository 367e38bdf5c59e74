import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.llm import components, exact_dedup, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    return sorted((rows[i][0], len(sets[i]), min(rows[j][0] for j in own)) for own in members.values() for i in own)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            own = list(b)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own).title() if rng.random() < 0.2 else " ".join(own))
    rows += [rows[0]] * 30 + ["", None, "  \n", "one", "ONE", "two words", "a b c d e", "x " * 9]
    return list(enumerate(rows, 10))


def test_near_duplicates_equal_brute_force(spark, corpus):
    found = minhash.near_duplicates(frame(spark, corpus)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_bucket_is_cut_into_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    found = minhash.near_duplicates(frame(spark, corpus)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(corpus)


def test_one_document_of_each_group_stays(spark, corpus):
    stay = {r.doc_id for r in minhash.drop_near_duplicates(frame(spark, corpus)).collect()}
    assert stay == {c for _, _, c in brute(corpus)}


def test_near_duplicates_edge_cases(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "q r s"), (3, None)]
    found = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id", "first").collect()), key=str)
    assert [(d, c) for d, c, _ in found] == [(2, 2), (3, 3), (5, 5), (5, 5), (None, 5)]
    assert sum(f for d, c, f in found if c == 5) == 1
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("text_", "node", "bucket", "_row", "uid")})
    assert minhash.drop_near_duplicates(clash).columns == clash.columns
    assert minhash.drop_near_duplicates(clash).count() == 3


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 1)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    for _ in range(400):
        for a, b in links:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(spark):
    rows = [(9, "a  b"), (4, "a\nb"), (7, "a b"), (1, None), (2, ""), (3, " "), (8, "x" * 70 + "1"), (6, "x" * 70 + "2"), (5, "alone"), (5, "alone")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert found >= {(9, 4, 3, False), (4, 4, 3, True), (7, 4, 3, False), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (8, 8, 1, True), (6, 6, 1, True)}
    assert {(5, 5, 2, True), (5, 5, 2, False)} <= found
    stay = sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect())
    assert stay == [1, 3, 4, 5, 6, 8]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_planted_pairs_at_the_threshold_share_a_bucket_and_pass_the_filter():
    """Pairs of sets whose similarity is exactly 0.75 or just above: of 3,000 all but the expected few in a million meet."""
    rng = np.random.default_rng(9)
    missed = 0
    for _ in range(3000):
        union = 4 * int(rng.integers(1, 300))
        every = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64))
        own = int(rng.integers(0, len(every) // 4 + 1))
        pair = [np.sort(every[: len(every) - (len(every) // 4 - own)]), np.sort(every[own:])]
        if not minhash.linked(*pair):
            continue
        a, b = minhash.signatures(pair)
        keys = minhash.band_keys(np.stack([a, b]))
        agreeing = int(np.count_nonzero(a.astype(np.uint8) == b.astype(np.uint8)))
        missed += not (keys[0] == keys[1]).any() or agreeing < minhash.LEAST_AGREEING
    assert missed <= 1


def test_only_members_that_may_be_linked_pass_with_their_full_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(40)]
    sets[30] = np.union1d(sets[2][:-6], sets[35][:6])  # linked to 2, which is of the block
    sets[31] = sets[35][:100]  # a third of 35's size
    signature = minhash.signatures(sets)
    keys = minhash.band_keys(signature)
    keys[:, 0] = 7  # all in one bucket
    rows = [(7, 0, 0, 0 if n < 20 else -1, n, n if n < 20 else 99, len(s), signature[n].astype(np.uint8).tobytes(), keys[n].tobytes(), s.tobytes()) for n, s in enumerate(sets)]
    assert sorted(r[4] for r in minhash._block_members(iter(rows))) == [2, 30]
    assert minhash._block_links(iter(rows)) == [(30, 2)]
    assert minhash._block_members(iter([r[:5] + (99,) + r[6:] for r in rows])) == []  # connected already


def test_whole_rows_that_stay_are_not_shuffled(spark):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(5)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.drop_near_duplicates(frame(spark, rows))
        assert sorted(r.doc_id for r in out.collect()) == list(range(300))
        stay, rest = out._jdf.queryExecution().optimizedPlan().children().head(), out._jdf.queryExecution().optimizedPlan().children().last()
        joins = lambda plan: [w for w in ("LeftSemi", "LeftAnti") if w in plan.toString()]
        assert not joins(stay) and joins(rest) == ["LeftAnti"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
