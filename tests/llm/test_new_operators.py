"""Spelling variants, SimHash and importance resampling against plain Python on small fixtures, and their edges."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import hashlib
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from playframe.llm import importance, simhash, spelling

LONG = "many words make a long text " * 20_000
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "x y"), (4, LONG), (5, "A b c d E f"), (6, " \t\n"), (7, "Ünïcode ÀÉ " * 30)]
CLASHES = ("a.b", "_id", "_row", "_text", "id", "word", "n", "n.x", "fp", "uid", "_uid", "f", "h", "at", "run", "bucket", "node", "label", "score", "rank", "weight", "_at", "doc", "fingerprint", "component_id")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASHES}).repartition(3)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- spelling variants


def plain_counts(rows, noise=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, own in near.items():
        top = min(own, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzàéßÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    rows = []
    for doc in range(400):
        own = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 3)])
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            own.append(w.title() if rng.random() < 0.2 else w)
        rows.append((doc, rng.choice([" ", "-", "Ā "]).join(own)))
    return [*rows, (None, "abababab abababa"), (9, None)]


def test_spelling_equals_brute_force(spark, misspelt):
    counts = spelling.word_counts(frame(spark, misspelt))
    want = plain_counts(misspelt)
    assert {r.word: r.n for r in counts.collect()} == want and len(want) > 100
    got = sorted(map(tuple, spelling.variants(counts).collect()))
    assert got == plain_variants(want)
    assert any(f for _, f, *_ in got)


def test_forms_of_forms_are_followed(spark):
    counts = {"letters": 5000, "lettres": 40, "letterss": 500, "letterrss": 50, "lettterrss": 5, "letterrsz": 5, "lettersx": 500, "unrelated": 9}
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()))
    assert got == plain_variants(counts) and ("lettterrss", "letterrss", "letters", 5, 1, 50) in got


def test_deletion_keys_are_those_of_the_shorter_words():
    words = ["aab", "ab", "abb", "é", "xyzxyz", "a" * 50]
    of, key, own = spelling.deletion_keys(words)
    keys = defaultdict(list)
    for i, k, o in zip(of.tolist(), key.tolist(), own.tolist(), strict=True):
        keys[i].append((o, k))
    for i, w in enumerate(words):
        cuts = {w[:j] + w[j + 1 :] for j in range(len(w))}
        assert sum(not o for o, _ in keys[i]) == len(cuts)
        for cut in cuts - {""}:
            assert spelling.deletion_keys([cut])[1][0] in [k for o, k in keys[i] if not o]


def test_a_very_long_word_costs_its_length(spark):
    word = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    rows = [(1, word), (2, word), (3, word[:777] + word[778:]), (4, word[:777] + word[778:])]
    got = {r.word: r.n_near for r in spelling.variants(spelling.word_counts(frame(spark, rows), noise=None)).collect()}
    assert got == {word: 1, word[:777] + word[778:]: 1}


def test_spelling_edges(spark):
    assert spelling.variants(spelling.word_counts(frame(spark, []))).count() == 0
    got = spelling.variants(spelling.word_counts(frame(spark, ROWS), noise=None)).collect()
    assert [(r.word, r.form, r.root, r.n_near) for r in got] == [("Ünïcode", None, "Ünïcode", 0)]
    odd = spark.createDataFrame([(None, 5), ("straßen", 2), ("strassen", 30), ("strassem", 3)], "word string, n long")
    assert {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(odd).collect()} == {"straßen": (None, "straßen", 0), "strassen": (None, "strassen", 1), "strassem": ("strassen", "strassen", 1)}


# --- SimHash


def plain_fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(text))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def planted(rng, n):
    """Fingerprints in chains and clusters at distances 0 to 6, some alike in many bits."""
    fps = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(fps) < n:
        fp = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            fp ^= 1 << bit
        fps.append(fp)
    return fps


def test_fingerprint_equals_plain(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, " \n", "one", "A b", "a b c", "a b c d", "Ünï ÀÉ ÿ x y z", *(" \t".join(rng.choices(["x", "yy", "Zz", "é", "longer"], k=rng.randint(1, 60))) for _ in range(100))]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert [simhash.fingerprint(t) for t in texts] == want


def test_hash_is_the_one_spark_has(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a bé c d"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a bé c d".encode(), 42)


@pytest.mark.parametrize("at_once", [1, 1 << 16])
@pytest.mark.parametrize("radius", range(8))
def test_close_pairs_equal_brute_force(radius, at_once, monkeypatch):
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", at_once)
    rng = random.Random(radius)
    fps = planted(rng, 300)
    a = np.array(fps, np.uint64)
    low = np.array([rng.randint(0, 300) for _ in fps])
    high = np.array([rng.randint(0, 300) for _ in fps])
    got = {(i, k) for x, y in simhash.close_pairs(simhash.bit_planes(a), a, low, high, radius) for i, k in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(i, k) for i in range(300) for k in range(low[i], high[i]) if (fps[i] ^ fps[k]).bit_count() <= radius}


@pytest.mark.parametrize("fingerprints", [10, 10**8, 10**11, 10**14])
def test_close_fingerprints_share_a_bucket(fingerprints):
    rng, choices = random.Random(8), simhash.masks(fingerprints)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in choices)
    assert fingerprints >> min(m.bit_count() for m in choices) <= 2 * simhash.TARGET


@pytest.mark.parametrize("block", [16_384, 7])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = sorted(set(planted(random.Random(block), 600)) | {1 << b for b in range(64)} | {0})
    want = plain_components(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    label = list(range(len(fps)))
    place = {f - (1 << 64) if f >> 63 else f: i for i, f in enumerate(fps)}
    found = simhash.links(rows).collect()
    simhash.join_labels(arr := np.array(label), np.array([place[r.a] for r in found], int), np.array([place[r.b] for r in found], int))
    assert arr.tolist() == want and len(found) < 5 * len(fps)


def test_simhash_near_duplicates(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(20):
        base = rng.choices(words, k=rng.randint(40, 400))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows = list(enumerate([*rows, *rows[:3], None, "", " "], 100))
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    want = sorted((d, f"{fp:016x}", rows[r][0]) for (d, _), fp, r in zip(rows, fps, label, strict=True))
    assert sorted(tuple(r)[:3] for r in simhash.near_duplicates(frame(spark, rows)).collect()) == want
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == {c for *_, c in want}


def test_simhash_edges(spark):
    df = frame(spark, ROWS)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (5, 1), (2, 2), (3, 2), (6, 2), (None, None), (4, 4), (7, 7)}
    assert sum(r.first for r in simhash.near_duplicates(df).collect()) == 5
    assert simhash.drop_near_duplicates(df).columns == df.columns and simhash.drop_near_duplicates(df).count() == 5
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def plain_resample(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out, able = [], []
    for doc, text in rows:
        words, own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if len(words) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_plain(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "γάμμα", "x1", "7", "it's", "a-b", "ÉTÉ"]
    rows = [(i, " ".join(rng.choices(words[: rng.randint(1, 8)], k=rng.randint(0, 60)))) for i in range(300)] + [(1, "dup " * 30)] * 3 + [(None, "beta " * 40)] * 2 + [(5, None), (6, " ")]
    target = ["beta beta x1", "γάμμα beta", None, ""]
    got = importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target)
    drawn = importance.draw(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert drawn.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in drawn.collect()), key=str) == sorted((r[0] for r in plain_resample(rows, target) if r[4]), key=str)


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "text string")
    got = importance.resample(frame(spark, ROWS), none)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(ROWS, [])
    assert importance.resample(frame(spark, []), none).count() == 0
    assert importance.draw(frame(spark, ROWS).limit(0), none).count() == 0


def test_scoring_moves_no_row(spark):
    rows = importance.bucketed(frame(spark, ROWS).select("doc_id", "text").withColumnRenamed("doc_id", "doc"), carry=("doc",))
    plan = importance.weighed(rows, [0] * 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("regexp_extract_all") == 1
