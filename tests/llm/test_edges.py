"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, and columns whose names clash or hold dots."""

import pytest
from pyspark.sql import functions as F

from playframe.llm import exact_dedup, licences, minhash, mixing, packing, pii, sharding, topk, toxicity, warc

LONG = "many words make a long text " * 20_000
ROWS = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (3, "", "s"), (None, "x y", None), (4, LONG, "t"), (5, "a b c d e f", "t"), (6, " \t\n", "s"), (7, "Released under the MIT License.", "s")]
CLASHES = ("a.b", "_id", "_row", "_text", "_norm", "_source", "_size", "size", "shard", "slot", "score", "passages", "pii_found", "node", "bucket", "label", "keep_id", "component_id", "taken", "target", "start", "length", "offset", "licence", "dice", "_uid", "vector")


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


MODEL = toxicity.Model({"bad.": 2.0}, 1.0, 0.0, 1.0, -2.0)
#: The operator, and how many rows it gives for ROWS.
OPERATORS = {
    "near duplicates": (minhash.near_duplicates, 9),
    "drop near duplicates": (minhash.drop_near_duplicates, 7),
    "pseudonyms": (lambda df: pii.pseudonymise(df, b"key"), 9),
    "licences": (licences.scan, None),
    "scores": (lambda df: toxicity.score(df, MODEL), 9),
    "clean": (lambda df: toxicity.clean_documents(df, MODEL), 9),
    "shards": (sharding.shard_by_bytes, 9),
    "exact duplicates": (exact_dedup.exact_duplicates, 9),
    "drop exact duplicates": (exact_dedup.drop_exact_duplicates, 6),
    "pieces": (lambda df: packing.pack(df, tokenizer()), None),
    "mix": (mixing.mix, 9),
    "materialised mix": (lambda df: mixing.materialise_mix(df, whole=True), None),
}
SAME_COLUMNS = {"drop near duplicates", "clean", "drop exact duplicates", "materialised mix"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    operator, n = OPERATORS[name]
    df = documents(spark)
    out = operator(df)
    got = out.collect()
    assert len(got) == n if n is not None else got
    if name in SAME_COLUMNS:
        assert out.columns == df.columns
    assert operator(df.limit(0)).count() == 0


def test_what_the_edges_give(spark):
    df = documents(spark)
    near = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df).collect()}
    assert near[5, 2] == near[1, 2] == 1 and near[2, 0] == 2 and near[3, 0] == 3 and near[6, 0] == 6 and near[None, 1] is None
    exact = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    assert (2, 2, 2, True) in exact and (3, 2, 2, False) in exact and [r[3] for r in exact if r[0] == 1] in ([True, False], [False, True]) and (6, 6, 1, True) in exact
    pieces = packing.pack(df, tokenizer()).collect()
    assert sum(r.length for r in pieces if r.doc_id in (2, 3)) == 2 and sum(r.length for r in pieces if r.doc_id == 4) == next(r.doc_tokens for r in pieces if r.doc_id == 4)
    assert sum(r.start == 0 for r in pieces if r.doc_id == 1) == 2


def test_vectors_and_pages(spark):
    vectors = [(1, [1.0, None]), (2, None), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [1.0, 1.0]), (4, [float("inf"), 0.0]), (5, [0.25, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("a.b", "id", "uid", "vector", "asks", "group", "block")})
    got = topk.top_inner_products(df, F.col("vec_id").isNotNull(), top=5).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(3, 3), (3, 3), (3, 5), (3, 5), (5, 3), (5, 3)]
    big = "<p>" + "x" * 3_000_000
    pages = [(1, "http://a/é b", big), (2, None, big), (2, None, big), (3, "u", None), (None, "u", big), (4, "u", "<p>small"), (5, "v", "<p>small")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("a.b", "digest", "record_type", "refers_to", "_large", "_open", "archive")})
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    n = len(big)
    assert rows == sorted([(1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 0, "response", None), (None, n, "revisit", 2), (4, 8, "response", None), (5, 8, "response", None)], key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_fill_does_not_depend_on_the_number_of_partitions(spark):
    rows = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(1200)], "doc_id long, text string")

    def fill(n):
        pieces = packing.pack(rows.repartition(n, "doc_id"), tokenizer()).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.avg("n")).first()[0]
        return pieces / packing.CAPACITY

    assert fill(48) > fill(1) - 0.015
