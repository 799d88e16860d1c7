"""Intermediate tables and files in the folder that driver and executors share, and numbering of whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder named by spark.checkpoint.dir. Where none is set, a local session (tests) gets a temporary folder; a
    cluster has none that all executors share, so it's an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _local[app]
    path = f"{base.rstrip('/')}/foliospark/{uuid.uuid4().hex}"
    for held in _scratch:
        held.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when the block ends: for results that are written, not only planned, inside it."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete_path(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(df: DataFrame, order: list) -> DataFrame:
    """df with _place (long), the 0-based place of each row in the order, nulls last.

    One shuffle: rows are dealt by ranges of the order and sorted inside; a row's id holds its range and its place there, to which the
    sizes of the ranges before are added (one row a range, as many as shuffle partitions, so they may be broadcast). Rows equal in the
    whole order share a range, so it should end in a key.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: (F.col(o) if isinstance(o, str) else o) for n, o in zip(names, order, strict=True)})
    by = [F.col(n).asc_nulls_last() for n in names]
    ranged = keyed.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by)
    ranged = materialise(ranged.drop(*names).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", before.alias("_before")))
    return ranged.join(starts, part == F.col("_range")).withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_range", "_before")


def number_all(df: DataFrame, order: list, out: str = "rn") -> DataFrame:
    """1-based numbers (long) over a whole table without bringing it into one task; see _placed."""
    return _placed(df, order).select(*df.columns, (F.col("_place") + 1).alias(out))


def number_groups(df: DataFrame, by: list[str], order: list, out: str = "rn") -> DataFrame:
    """1-based numbers (long) inside each group of `by`, of any size: the groups stand one after another in the order of a whole table,
    so that a row's number is its place less that of its group's first row. That place is one small row a group, combined before the
    shuffle; a group that holds most of the rows is dealt over many ranges and not gathered. Null counts as a group of its own."""
    if not by:
        return number_all(df, order, out)
    placed = materialise(_placed(df, [*by, *order]))
    key = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)])
    firsts = placed.groupBy(key.alias("_key")).agg(F.min("_place").alias("_first"))
    joined = placed.withColumn("_group", key).join(firsts, F.col("_group").eqNullSafe(F.col("_key")))
    return joined.select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(out))


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Each row's bytes as one file of a folder (a path, or the URI of any file system that pyarrow opens), which executors and readers
    share: all files or none, sub-folders in names kept, null contents left out. See sources.files."""
    from foliospark.sources.files import write_folder

    write_folder(rows, folder, name, content)
