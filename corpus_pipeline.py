"""From documents to packed training sequences: each stage's rows are written as Parquet and read by the next.

1. toxicity: documents that score 0.5 or more go;
2. exact dedup: of equal texts the one with the smallest id stays;
3. near dedup: one document of each group of near duplicates stays;
4. mixing: sources are repeated or thinned to their target weights, by whole documents;
5. packing: token sequences of at most 2,048 ids.

Stages 1 to 4 return the columns of ``documents``, the last one its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playframe.llm import exact_dedup, minhash, mixing, packing, toxicity
from playframe.llm.common import documents, drop, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among ``docs``; a null text has no evidence and stays."""
    model = toxicity.fit(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the smallest id stays; null and empty texts are equal, a null id comes last, of rows repeated whole one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates stays; documents without words are linked with nothing and all stay."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources come near their targets; a null source is a source, documents without words follow theirs."""
    return mixing.materialise_mix(docs, whole=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row, repetitions each for themselves; a null text is one piece of the end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, hashed signatures and token ids have no SQL; ``tests/llm/test_pipeline_stages.py`` holds each stage against plain Python on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on; the tables between them are written to the shared folder, and each goes when the next one is there. Empty documents give no pieces."""
    docs = documents(spark, sf_dir)
    before: list[DataFrame] = []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
