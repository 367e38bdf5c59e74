import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from playframe.llm.common import written

STAGES = dict(corpus_pipeline.STAGES)


def planted():
    """Clean documents of three sources; among them toxic ones, exact copies and near copies."""
    rng = random.Random(11)
    plain, foul = [f"word{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    texts, toxic = {}, set()
    for i in range(400):
        words = [rng.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            at = rng.randrange(60)
            words[at : at + 10] = [rng.choice(foul) for _ in range(10)]
            toxic.add(i)
        texts[i] = " ".join(words)
    for k, i in enumerate(range(1, 200, 4)):
        texts[1000 + k] = texts[i]
        texts[2000 + k] = texts[i + 1] + f" ending{k}"
        texts[-1 - k] = texts[i + 2] if k < 10 else f"start{k} " + texts[i + 2]
    source = {i: "abc"[i % 7 % 3] for i in texts}
    labels = [(i, int(i in toxic)) for i in range(400)]
    return texts, source, toxic, labels


def kept_near(texts):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in texts if root(i) == i}


def repetitions(texts, source):
    sizes = {s: sum(len(texts[i].split()) for i in texts if source[i] == s) for s in sorted({source[i] for i in texts})}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    times = {}
    for s, size in sizes.items():
        words = 3 * size if s in capped else math.floor(level * weights[s] + 0.5)
        whole, rest = divmod(words, size)
        for i in sorted((i for i in texts if source[i] == s), key=lambda i: (hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i)):
            n = len(texts[i].split())
            times[i] = whole + (2 * min(rest, n) >= n)
            rest -= min(rest, n)
    return {i: n for i, n in times.items() if n}


def test_each_stage_against_plain_python(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts, source, toxic, labels = planted()
    docs = spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def run(name, given):
        out = written(STAGES[name](spark, given, str(tmp_path)))
        rows = [(r.doc_id, r.text, r.source, r.n_chars) for r in out.collect()]
        assert out.columns == docs.columns and set(rows) <= {(i, t, source[i], len(t)) for i, t in texts.items()}
        return out, Counter(r[0] for r in rows)

    left, got = run("toxicity", docs)
    texts = {i: t for i, t in texts.items() if i not in toxic}
    assert got == Counter(texts.keys())

    left, got = run("exact dedup", left)
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    texts = {i: t for t, i in first.items()}
    assert got == Counter(texts.keys()) and len(texts) < 400

    left, got = run("near dedup", left)
    stay = kept_near(texts)
    assert got == Counter(stay) and len(stay) < len(texts)

    texts_left = {i: texts[i] for i in stay}
    left, got = run("mixing", left)
    assert got == repetitions(texts_left, source) and max(got.values()) > 1

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length, used = Counter(), Counter()
    for p in STAGES["packing"](spark, left, str(tmp_path)).collect():
        length[p.doc_id] += p.length
        used[p.sequence_id] += p.length
    assert length == {i: n * (len(tokens.encode(texts_left[i], add_special_tokens=False).ids) + 1) for i, n in got.items()}
    assert max(used.values()) <= 2048
