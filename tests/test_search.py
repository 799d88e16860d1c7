"""Indexed search: the rows of the plain search, with only the folders of the query's trigrams read."""

import pytest

from foliospark.operators import relational, search


@pytest.mark.parametrize("query", ["loser", "  ÉTÉ ", "a b", "ab", "", "  ", "zzz", "été x", "x" * 40, "no\nline", "%_[", "end"])
def test_same_rows_as_plain_search(spark, tmp_path_factory, query):
    rows = [(i, t, c) for i, (t, c) in enumerate([("A loser here", "x"), ("l o s e r", None), (None, "été"), (None, None), ("", ""), ("été", "x tail"), ("a", "b end"), ("x" * 100, "no\nline"), ("100 %_[ signs", "LOSER"), ("ab", None), ("a loser", "loser")])]
    df = spark.createDataFrame([*rows, rows[0], (None, "a loser without a key", "e")], "k long, t string, c string")
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.write_index(df, folder, "k", "t", "c")
    order = lambda d: sorted(map(str, d.collect()))
    assert order(search.search_indexed(df, folder, "k", query, "t", "c")) == order(relational.search(df, query, "t", "c"))


def test_other_folders_are_not_read(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS k", "concat('row number ', id, ' of many words ', hex(id * 7919)) AS t")
    folder = f"file://{tmp_path}/i"
    search.write_index(df, folder, "k", "t")
    plan = search._lookup(spark, f"{folder}/lists", ["row", "7c9"])
    files = len(spark.read.parquet(f"{folder}/lists").inputFiles())
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in plan._jdf.queryExecution().toString()
    read = {r[0] for r in plan.selectExpr("input_file_name()").distinct().collect()}
    assert 0 < len(read) <= 32 < files
    assert [r.key for r in search.candidates(spark, folder, "number 123 of").collect()] == [123]
