"""Best-fit packing planned on the histogram of lengths; pieces then take planned places by their rank within their length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import mapped, materialise
from foliospark.llm.tokens import encoding, forget_words

CAPACITY = 4096
#: Blocks in which pieces of one length are ranked.
BLOCKS = 1024


def plan_places(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, sequences, first sequence, offset) runs, and the number of sequences.

    Pieces first rank .. first rank + sequences - 1 of a length go one each into as many consecutive sequences, all at one offset.
    Open sequences are kept as runs of equal free space, so the work and the plan follow the number of lengths, not of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: runs of sequences (first, count)
    spaces: list[int] = []
    runs, opened = [], 0

    def release(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, count))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        if length > capacity:
            raise ValueError("pieces must be cut to the capacity first")
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            deep = space // length  # a sequence is filled with equal pieces while they are its best fit
            full = min(count, left // deep)
            for k in range(deep if full else 0):
                runs.append((length, rank, full, first, capacity - space + k * length))
                rank += full
            left -= full * deep
            release(space - deep * length, first, full)
            first, count = first + full, count - full
            if left and count:  # fewer than `deep` pieces are left: they share one sequence
                for k in range(left):
                    runs.append((length, rank, 1, first, capacity - space + k * length))
                    rank += 1
                release(space - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            release(space, first, count)
    return runs, opened


def rank_within(df: DataFrame, group: str, tie: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Add _rank, from 0, within each value of `group` without bringing a value's rows into one task.

    Rows are dealt into blocks by a hash of `tie`, ranked inside (group, block) and moved by the counts of the blocks before.
    """
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*tie), F.lit(blocks)))
    counts = rows.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_in", F.row_number().over(W.partitionBy(group, "_block").orderBy(*tie)).cast("long"))
    joined = numbered.join(starts, (numbered[group] == starts["_g"]) & (numbered["_block"] == starts["_b"]))
    return joined.withColumn("_rank", F.col("_start") + F.col("_in") - 1).drop("_g", "_b", "_start", "_in", "_block")


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces: whole if they fit, else of `capacity` ids but for the last.

    Documents are encoded and cut in one pass, so that their ids don't leave the worker.
    """
    encode = encoding(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            keys, made = [], []
            for key, ids in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(ids.as_buffer())
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    keys.append(key.as_py())
                    made.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*made, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(mapped, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", forget_words)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (a table with doc_id, piece, length between 1 and capacity).

    The histogram (at most `capacity` rows) is planned on the driver; the plan, whose size depends on the capacity and not on the
    number of pieces, is shared with the tasks. Pieces find their place by rank within their length, ordered by a hash block and
    then doc_id and piece; ties and repeated rows just take one place each. An empty table has no places. Columns of the result's
    names are replaced; others are kept.
    """
    pieces = materialise(pieces.drop("sequence_id", "offset"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan_places(histogram, capacity)
    runs.sort()
    plan = np.array(runs, np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy().astype(np.int64) << 48) + rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(table[at, 4])], names=[*names, "sequence_id", "offset"])

    ranked = rank_within(pieces, "length", ["doc_id", "piece"])
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*pieces.columns, "_rank").transform(mapped, place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_documents(docs, path, capacity), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
