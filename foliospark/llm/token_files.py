"""Token files: documents' ids by shard, Re-Pair compressed, with random access by document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.shared import dealt, mapped, shared_dir, shuffle_partitions
from foliospark.llm.tokens import encoding, forget_words, id_kind

#: Ids in one block of a shard: a block has its own grammar, and reading a document opens its block alone.
BLOCK_IDS = 1 << 20
#: A pair is frequent, and becomes a nonterminal, while it occurs so often in a block without overlaps.
FREQUENT = 16
_CELL_BITS = 22

BLOCK_SCHEMA = "shard int, block int, first_doc bigint, ids_before bigint, n_null bigint, n_docs bigint, n_ids bigint, doc_ids binary, doc_ends binary, base bigint, rules binary, expansion_lengths binary, sequence binary"


def repair(ids: np.ndarray, frequent: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """(first nonterminal, rules (n, 2), sequence): pairs become nonterminals until none occurs `frequent` times without overlaps.

    In a round every pair is replaced wherever it is more frequent than the pairs that it overlaps, so that a round makes many rules.
    The sequence is linked: a round looks at the places alone whose pair may still be frequent, as a pair that isn't never becomes it.
    Counts by a hash of the pair, which are never too low, choose; counts of what was chosen decide. Of equal neighbours (aaaa) every
    second pair is replaced, from the left. A rule refers to ids and to nonterminals of earlier rounds only.
    """
    n, base = len(ids), int(ids.max()) + 1 if len(ids) else 0
    if n < 2:
        return base, np.zeros((0, 2), np.uint32), ids.astype(np.uint32)
    symbol = np.append(ids.astype(np.uint32), np.uint32(0))
    after = np.minimum(np.arange(1, n + 2), n)
    before = np.arange(-1, n)
    before[0] = n
    rank = np.zeros(n + 1, np.int64)
    alive, waiting = np.ones(n + 1, bool), np.ones(n + 1, bool)
    alive[n] = waiting[n - 1] = waiting[n] = False
    rules, made = [], 0

    def settle(places: np.ndarray) -> None:
        waiting[places] = False
        rank[places] = 0

    def pairs_at(places: np.ndarray) -> pa.DictionaryArray:
        return pa.array((_take(symbol, places).astype(np.uint64) << np.uint64(32)) | _take(symbol, _take(after, places))).dictionary_encode()

    def runs_of(at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places (in at) and lengths of runs of equal pairs that overlap."""
        first = np.ones(len(at), bool)
        first[1:] = kind[1:] != kind[:-1]
        same = np.flatnonzero(~first)
        first[same] = after[at[same - 1]] != at[same]
        if first.all():
            return np.arange(len(at)), np.ones(len(at), np.int64)
        starts = np.flatnonzero(first)
        return starts, np.diff(np.append(starts, len(at)))

    while len(at := np.flatnonzero(waiting)):
        bits = max(10, min(_CELL_BITS, int(2 * len(at) - 1).bit_length()))
        cell = ((_take(symbol, at) * np.uint32(0x9E3779B1) ^ _take(symbol, _take(after, at)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)
        counts = _take(np.bincount(cell, minlength=1 << bits), cell)
        many = counts >= frequent
        settle(_take(at, np.flatnonzero(~many)))
        many = np.flatnonzero(many)
        at, kind = _take(at, many), _take(counts, many) << _CELL_BITS | _take(cell, many)
        if not len(at):
            break
        rank[at] = kind
        starts, sizes = runs_of(at, kind)
        best = np.flatnonzero(_take(kind, starts) > _take(rank, _take(before, _take(at, starts))))
        starts, sizes = _take(starts, best), _take(sizes, best)
        best = np.flatnonzero(_take(kind, starts) > _take(rank, _take(after, _take(at, starts + sizes - 1))))
        chosen, more = _take(starts, best), (_take(sizes, best) - 1) // 2
        long = np.flatnonzero(more)
        if len(long):
            chosen = np.concatenate((chosen, chosen[np.repeat(long, more[long])] + 2 * _spread(np.ones(len(long), np.int64), more[long])))
        coded = pairs_at(_take(at, chosen))
        of, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        enough = np.bincount(of, minlength=len(pairs)) >= frequent
        if not enough.any():  # counts that were too high, or pairs that stand in each other's way: the most frequent one goes first
            coded = pairs_at(at)
            of, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            starts, sizes = runs_of(at, of)
            times = np.bincount(of[starts], weights=(sizes + 1) // 2, minlength=len(pairs))
            settle(at[times[of] < frequent])
            top = int(np.argmax(times))
            if times[top] < frequent:
                continue
            chosen = np.flatnonzero((of == top) & ((np.arange(len(at)) - np.repeat(starts, sizes)) % 2 == 0))
            of, pairs, enough = np.zeros(len(chosen), np.int64), pairs[top : top + 1], np.ones(1, bool)
        here, of = at[chosen[enough[of]]], (np.cumsum(enough) - 1)[of[enough[of]]]
        gone = after[here]
        then = after[gone]
        symbol[here] = base + made + of
        after[here] = then
        before[then] = here
        alive[gone] = False
        settle(gone)
        waiting[here] = waiting[before[here]] = True
        waiting[here[then == n]] = waiting[n] = False
        rules.append(pairs[enough])
        made += int(enough.sum())
    wide = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return base, np.stack((wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32), symbol[alive]


def _take(of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """of[at] for places that are sure to be in it, which numpy needn't check one by one."""
    return of.take(at, mode="clip")


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out = [1] * base
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[base:], np.int64)


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(firsts - ends + sizes, sizes)


class Block:
    """A stored block; ids(i, j) decodes ids i .. j - 1 of the block without expanding the rest."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, sequence: bytes):
        self.base = base
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.sequence = _unpack(sequence)
        lengths = np.concatenate((np.ones(base, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)))
        self.ends = np.cumsum(lengths.take(self.sequence)) if len(self.sequence) else np.zeros(0, np.int64)
        self.sizes, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.zeros(int(lengths.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        deep = [0] * base  # a nonterminal is written after those that it stands for
        for a, b in self.rules.tolist():
            deep.append(1 + max(deep[a], deep[b]))
        deep = np.array(deep[base:], np.int64)
        by_depth = np.argsort(deep, kind="stable")
        for of in np.split(by_depth, np.flatnonzero(np.diff(deep[by_depth])) + 1) if len(by_depth) else ():
            for at, child in ((self.starts[base + of], self.rules[of, 0]), (self.starts[base + of] + lengths[self.rules[of, 0]], self.rules[of, 1])):
                self.flat[_spread(at, lengths[child])] = self.flat[_spread(self.starts[child], lengths[child])]

    def ids(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, [first, last - 1], side="right")
        symbols = self.sequence[i : j + 1]
        out = _take(self.flat, _spread(self.starts.take(symbols), self.sizes.take(symbols)))
        skip = first - (int(self.ends[i - 1]) if i else 0)
        return out[skip : skip + last - first]


def _pack(sequence: np.ndarray) -> bytes:
    """A byte for the width, then the symbols."""
    small = not len(sequence) or int(sequence.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + sequence.astype("<u2" if small else "<u4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode documents and write blocks of ids, in ascending doc_id order, as Parquet files under path.

    Shards are ranges of doc_id between approximate quantiles (a narrow pass; as many as there are shuffle partitions), so no sampling
    encodes the texts a second time; null ids come first. A shard is cut into blocks of about block_ids ids, never inside a document.
    A block holds its grammar (rules and expansion lengths), the compressed sequence and the end of each document in ids. Null or
    empty texts hold the end id alone; repeated ids keep all their rows, side by side; an empty table writes no block; texts of any
    length are encoded whole, and one longer than a block is a block; other columns are not stored. doc_id must be an integer.
    """
    n = shuffle_partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)
    kind = id_kind(tokenizer)
    encode, width = encoding(tokenizer, doc_id, kind=kind), np.dtype(kind).itemsize

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            keys = batch.column(0).cast(pa.int64())
            shard = np.searchsorted(bounds, keys.fill_null(bounds[0] if len(bounds) else 0).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(shard.astype(np.int32))], names=["doc_id", "ids", "shard"])

    placed = docs.select(doc_id, text).transform(mapped, place, "doc_id bigint, ids binary, shard int", forget_words)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard, block, size, before = None, 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            base, rules, sequence = repair(ids)
            ends = np.cumsum([len(x) // width for _, x in held])
            keys = np.array([0 if k is None else k for k, _ in held], "<i8")
            row = {"shard": shard, "block": block, "first_doc": held[0][0], "ids_before": before, "n_null": sum(k is None for k, _ in held), "n_docs": len(held), "n_ids": len(ids), "doc_ids": keys.tobytes(), "doc_ends": ends.astype("<i8").tobytes(), "base": base, "rules": rules.astype("<u4").tobytes(), "expansion_lengths": expansion_lengths(base, rules).astype("<u4").tobytes(), "sequence": _pack(sequence)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("ids_before", pa.int64()), ("n_null", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_ends", pa.binary()), ("base", pa.int64()), ("rules", pa.binary()), ("expansion_lengths", pa.binary()), ("sequence", pa.binary())])
        for batch in batches:
            for key, ids, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = ids.as_py()
                if held and (at != shard or size + len(ids) > width * block_ids):
                    yield flush()
                    block, before = (block + 1, before + size // width) if at == shard else (0, 0)
                    held, size = [], 0
                shard = at
                held.append((key, ids))
                size += len(ids)
        if held:
            yield flush()
        held = []

    rows = placed.transform(dealt, n, "shard", "doc_id", "ids")
    rows.transform(mapped, write, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of each document, read from the blocks without a shuffle.

    What is broadcast is one count for each shard, as many as there were shuffle partitions at writing.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = blocks.groupBy(F.col("shard").alias("_s")).agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("_s", F.coalesce(F.sum("_n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = blocks.join(F.broadcast(shards), F.col("shard") == F.col("_s")).withColumn("start", F.col("_before") + F.col("ids_before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):  # a block at a time
                block = Block(row["base"], row["rules"], row["expansion_lengths"], row["sequence"])
                keys, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_ends"], "<i8")
                begins = np.concatenate(([0], ends[:-1]))
                null = np.arange(len(keys)) < row["n_null"]  # nulls come first
                for i in range(0, len(keys), 1000):
                    part = slice(i, i + 1000)
                    first, last = int(begins[i]), int(ends[part][-1])
                    bounds = 4 * (np.append(begins[part], last) - first)
                    ids = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(block.ids(first, last).astype("<u4", copy=False))]).cast(pa.binary())
                    columns = [pa.array(keys[part], mask=null[part]), pa.array(row["start"] + begins[part]), pa.array((ends - begins)[part]), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return placed.select("base", "rules", "expansion_lengths", "sequence", "doc_ids", "doc_ends", "n_null", "start").transform(mapped, read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op2_repair_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark)
    write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    back = read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
