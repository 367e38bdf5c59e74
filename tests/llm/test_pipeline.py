import os

import corpus_pipeline
from playframe.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{os.getpid()}"
        out.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        counts.append(kept.count())
        if name == "near dedup":
            assert kept.select("doc_id").distinct().count() == kept.count()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.select("sequence_id", "offset").distinct().count() == pieces.count()


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_between_stages_go(spark):
    from playframe.llm import common

    before = set(common._WRITTEN)
    made = []
    original = corpus_pipeline.written
    corpus_pipeline.written = lambda df: made.append(original(df)) or made[-1]
    try:
        corpus_pipeline.run(spark, SF)
    finally:
        corpus_pipeline.written = original
    left = set(common._WRITTEN) - before
    assert len(made) == 4 and [t._playframe_path in left for t in made] == [False, False, False, True]
