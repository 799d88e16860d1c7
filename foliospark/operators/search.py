"""Containment search by an index of trigrams: the lists of a query's trigrams name the rows that may hold it, which are then looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.relational import search

#: Folders of the index; a query reads those of its trigrams.
BUCKETS = 64
#: Trigrams of a query that are looked up at most: its rarest ones, by the index's own counts.
LOOKED_UP = 8


def searched_text(*fields: str) -> Column:
    """What search() looks through: the fields joined by spaces, in lower case."""
    return F.lower(F.concat_ws(" ", *fields))


def _trigrams(text: Column) -> Column:
    """The distinct trigrams of characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def write_index(df: DataFrame, path: str, key: str, *fields: str) -> None:
    """Write the index of the rows' fields to a folder: trigram and key, in BUCKETS folders by the trigram's hash, and each trigram's
    number of rows. Rows of a key count together; null fields count as absent, as in search()."""
    pairs = df.select(F.col(key).alias("key"), F.explode(_trigrams(searched_text(*fields))).alias("trigram")).distinct()
    dealt = pairs.withColumn("bucket", _bucket(F.col("trigram"))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("bucket", "trigram")
    dealt.write.partitionBy("bucket").parquet(f"{path}/lists")  # a frequent trigram's list comes from up to 16 tasks
    spark = df.sparkSession
    spark.read.parquet(f"{path}/lists").groupBy("bucket", "trigram").agg(F.count("*").alias("n")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")


def query_trigrams(query: str) -> list[str]:
    q = query.strip().lower()
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def _lookup(spark: SparkSession, path: str, trigrams: list[str]) -> DataFrame:
    """The index's rows of these trigrams; the folders of other buckets aren't read."""
    buckets = spark.createDataFrame([(t,) for t in trigrams], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()
    return spark.read.parquet(path).where(F.col("bucket").isin([r.b for r in buckets]) & F.col("trigram").isin(trigrams))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """key of the rows that hold the query's rarest trigrams; None for a query of one or two characters, which the index can't narrow."""
    wanted = query_trigrams(query)
    if not wanted:
        return None
    counts = {r.trigram: r.n for r in _lookup(spark, f"{path}/counts", wanted).collect()}  # a row for each trigram of the query
    if len(counts) < len(wanted):
        return spark.read.parquet(f"{path}/lists").select("key").limit(0)
    rare = sorted(wanted, key=lambda t: (counts[t], t))[:LOOKED_UP]
    return _lookup(spark, f"{path}/lists", rare).groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rare)).select("key")


def search_indexed(df: DataFrame, path: str, key: str, query: str, *fields: str) -> DataFrame:
    """The rows of search(df, query, *fields), of which only those that the index at `path` names are looked at."""
    found = candidates(df.sparkSession, path, query) if query.strip() else None
    narrowed = df if found is None else df.join(found, F.col(key).eqNullSafe(F.col("key")) if key != "key" else "key", "left_semi")
    return search(narrowed, query, *fields)
