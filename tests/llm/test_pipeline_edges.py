"""The pipeline's stages on nulls, empty texts, repeated rows, columns of clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm.shared import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ("part", "pos", "_row", "_kept", "component_id", "predicted", "score", "kept_text", "hit_spans", "id", "shard", "key")


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(29)
    path = tmp_path_factory.mktemp("edges")
    clean = [(i, words(rng, 80)) for i in range(1, 30)]
    toxic = [(100 + i, words(rng, 40) + " foul nasty") for i in range(60)]
    twin = words(rng, 60)
    odd = [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, twin), (204, twin), (205, twin), (None, words(rng, 50)), (None, None), (206, words(rng, 6000))]
    rows = [(i, t, None, None, None) for i, t in clean + toxic + odd]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.select("*", *[F.lit(7).alias(c) for c in CLASHING]).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, words(rng, 15)), (2, None), (None, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_odd_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = [(r.doc_id, r.text) for r in docs.collect() if not (r.doc_id and 100 <= r.doc_id < 200)]
    once = [r for i, r in enumerate(every) if r not in every[:i] and r[0] != 205]  # of equal texts the smallest doc_id, of repeated rows one
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (every, once, once, once), strict=True):
        docs = materialise(stage(spark, docs, folder))
        assert docs.columns == corpus_pipeline.COLUMNS
        found = [(r.doc_id, r.text) for r in docs.collect()]
        by = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted((i, t or "") for i, t in found if i is not None) == sorted((i, t or "") for i, t in want if i is not None), name
        assert len(sorted(found, key=by)) == len(want), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in once}
    assert sum(r.length == 1 for r in packed) == sum(not (t or "").strip() for _, t in once)


def test_empty_table(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
