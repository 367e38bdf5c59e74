import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playframe.llm import licences, mixing, packing, pii, sharding, topk, toxicity, warc

KEY = b"test key"


def test_permutation_is_a_bijection_with_an_inverse():
    for domain in (1, 2, 3, 10, 97, 1000, 4096):
        image = [pii.permute(v, domain, KEY, "t") for v in range(domain)]
        assert sorted(image) == list(range(domain))
        assert [pii.permute(v, domain, KEY, "t", back=True) for v in image] == list(range(domain))


def test_pseudonyms_keep_format_and_links(spark):
    text = "Ann ann.b9@x.org, 4111 1111-1111 1111 on 2020-02-29, +1 (017) 555-7713 from 10.0.0.1, SSN 123-45-6789, DE89 3704 0044 0532 0130 00."
    rows = spark.createDataFrame([(1, text), (2, "again 4111111111111111"), (3, None), (4, ""), (5, "4111111111111112 999.1.1.1 2021-02-30 123456 v1.2.3")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.pseudonymise(rows, key=KEY).collect()}
    assert [x.kind for x in found[1].pii_found] == ["email", "card", "date", "phone", "ipv4", "ssn", "iban"]
    for x in found[1].pii_found:
        assert text[x.first_char : x.end_char] not in found[1].text
    card = "".join(c for c in found[1].text.split(", ")[1].split(" on ")[0] if c.isdigit())
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert found[2].text == f"again {card}"
    assert found[3].text is None and found[4].text == ""
    assert found[5].text == rows.collect()[4].text and not found[5].pii_found
    assert pii.pseudonymise(rows.limit(0), KEY).count() == 0


def test_valid_values_stay_valid():
    rng = random.Random(1)
    seen = set()
    for _ in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        new = pii.pseudonym("card", body + pii.luhn_digit(body), KEY)
        assert pii.luhn_digit(new[:-1]) == new[-1]
        seen.add((body, new))
    assert len({n for _, n in seen}) == len({b for b, _ in seen})


def slow_dice(a, b):
    from collections import Counter

    x, y = (Counter(zip(w, w[1:])) for w in (licences.WORD.findall(a.lower()), licences.WORD.findall(b.lower())))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_licences_equal_brute_force(spark):
    rng = random.Random(2)
    lines = [t for _, t in licences.TEMPLATES]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(lines).split() if rng.random() < 0.6 else ["plain", "prose", "of", "the", "license"] * 3
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "zzz"
            own.append(" ".join(words))
        texts.append("\n".join(own))
    rows = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string")
    found = {(r.doc_id, r.first_char): r for r in licences.scan(rows).where("level = 'line'").collect()}
    n = 0
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            best = max(slow_dice(line, x) for x in lines)
            assert ((d, at) in found) == (best >= licences.THRESHOLD)
            if (d, at) in found:
                n += 1
                assert math.isclose(found[d, at].dice, best)
            at += len(line) + 1
    assert n > 20


def test_whole_licence_over_several_lines():
    words = licences.TEMPLATES[2][1].split()
    text = "Intro.\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n\nEnd."
    assert [(m[0], m[1]) for m in licences.Scanner(licences.TEMPLATES, 0.8).matches(text)] == [("MIT", "paragraph"), ("MIT", "text")]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.1, 8), 1)]) for i in range(90)]
    rows += [(200, None), (201, [float("nan")] * 8), (202, [None] + [0.1] * 7), (203, [0.5]), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_inner_products(df, F.col("vec_id") % 20 == 0, top=5, block=16, group=2).collect()
    vectors = {i: [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in vectors:
        if q % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(vectors[q], w)), i) for i, w in vectors.items() if i != q))[:5]
            want += [(q, k, i, -x) for k, (x, i) in enumerate(s, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_inner_products(df.limit(0), F.lit(True)).count() == 0


def test_sparse_terms():
    rng = np.random.default_rng(1)
    q, c = (rng.integers(-5, 6, (7, 40)) * (rng.random((7, 40)) < 0.1) for _ in range(2))
    assert (topk.accumulate(q, c) == q @ c.T).all()


def test_maximal_segments_equal_brute_force():
    rng = random.Random(4)

    def slow(x):  # the best segment, then left and right of it
        best = max(((sum(x[i:j]), i - j, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return slow(x[:i]) + [(i, j - 1, sum(x[i:j]))] + [(a + j, b + j, s) for a, b, s in slow(x[j:])]

    for _ in range(100):
        x = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 8 for _ in range(rng.randint(0, 14))]
        got = sorted(toxicity.maximal_segments(list(enumerate(x)), drift=0.0))
        want = sorted(slow(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(9)
    plain, foul = [f"word{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(60)
            words[at : at + 6] = [rng.choice(foul) for _ in range(6)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([*labels, (1000, None)], "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(d.withColumn("score", F.lit("clash")), model).collect()}
    held = [(rows[i].score >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.95
    assert rows[1000].score < 0.5 and rows[1001].score < 0.5
    assert toxicity.clean_documents(d, model).count() < 340
    assert toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).lexicon == {}


def test_differencing_is_near_equal_and_fits():
    rng = random.Random(6)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(80)]
        windows = packing.windows_of(sizes, 128)
        assert sorted(i for w in windows for i in w) == list(range(80))
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) <= 128 and max(loads) - min(loads) <= 60


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n\tcdé  xyz") for _ in range(rng.randint(0, 9000))) for _ in range(30)] + [None, "", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = packing.pack(rows, path).collect()
    t = Tokenizer.from_file(path)
    seen, used = {}, {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(seen[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def by_heap(sizes, shards):
    """Longest processing time first, one item at a time; the shard of each item, equal loads by number."""
    heap, out = [(0, k) for k in range(shards)], []
    for size in sizes:
        load, k = heapq.heappop(heap)
        out.append(k)
        heapq.heappush(heap, (load + size, k))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(8, 30), max_size=200), st.integers(1, 7))
def test_runs_are_scheduled_as_by_the_heap(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    placed = Counter(zip(sizes, by_heap(sizes, shards)))
    runs = sorted(Counter(sizes).items(), reverse=True)
    assert {(size, k): n for size, given_to in sharding.scheduled(runs, shards) for k, n in enumerate(given_to) if n} == dict(placed)


def test_shards(spark):
    data = [(i, "x" * (i * 37 % 400) + str(i % 150)) for i in range(900)] + [(5000, None), (5001, ""), (5001, ""), (None, "y"), (5002, "long " * 50_000)]
    data += [(6000 + i, "hot copy") for i in range(500)]
    rows = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shard", "2 as `size.of`").repartition(5)
    found = sharding.shard_by_bytes(rows).collect()
    assert len(found) == len(data)
    size_of = Counter()
    for _, text in data:
        size_of[text or ""] += len((text or "").encode()) + 8
    crc = {zlib.crc32(t.encode()): t for t in size_of}
    load, slots, by_text = Counter(), {}, {}
    for r in found:
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault(crc[r.text_crc32], set()).add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = sorted(size_of.values(), reverse=True)
    want = Counter()
    for size, k in zip(sizes, by_heap(sizes, 24)):
        want[k] += size
    assert sorted(load.values()) == sorted(want.values())
    assert sharding.shard_by_bytes(rows.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(900, None, "a"), (901, "x", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(df).collect()
    source = {i: s for i, _, s in rows}
    by = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        own = by.setdefault(source[r.doc_id], [0, r.target, r.source_size])
        own[0] += r.taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-9
    assert math.isclose(sum(t for _, t, _ in by.values()), sum(s for _, _, s in by.values()))
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in found}
    assert mixing.materialise_mix(df).agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(again.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 300
    rows = [(1, "http://a/ü?x=1", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in found.items()} == {
        1: ("revisit", 2, len(long.encode())), 2: ("response", None, len(long.encode())), 3: ("response", None, 5), 4: ("response", None, 5),
        5: ("response", None, 0), 6: ("response", None, 0), 7: ("response", None, len(long.encode()) + 1),
    }
    index = warc.write_archives(warc.planned(pages))
    some = warc.read_records(index.where("page_id in (2, 3)")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in some} == {(2, long), (3, "short")}
    assert warc.round_trip(pages.limit(0)).count() == 0
