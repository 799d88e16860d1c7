"""N-gram Jaccard join, size-aware: fixed-size subsets of small sets, inverted lists of large sets, the boundary chosen by cost."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.components import Forest, as_longs, connected_components
from foliospark.llm.shared import ascii_lower, dealt, mapped, materialise, mix, pack_arrays, prefix_hash, shuffle_partitions, span_hash, text_chunks, unpack_arrays, word_spans

#: Shingles that a task gathers before it deals them out, and shingles of a part (there are as many parts as that takes).
GATHER = 1_000_000
PART_SHINGLES = 2_000_000
#: Shingles of one in HOT_SHARE of all, or more, are broadcast (at most HOT_SHARE numbers) instead of being dealt to a part.
HOT_SHARE = 1 << 16
#: Sets in one inverted list, and in one block of a component, that a task compares at once; and the bytes of such a block.
LIST_SETS = 2048
BLOCK_SETS = 2048
BLOCK_BYTES = 32 << 20
#: Sets of more shingles are always large.
MOST_LIGHT = 24
PIVOTS = 32

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5, 0x4CF5AD432745937F], np.uint64)


class Bound:
    """Similarity num / den and what follows from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_size(self, n: int) -> int:
        """Size that a partner of a set of n has at least; also the overlap that any link of it has at least."""
        return -(-self.num * n // self.den)

    def overlap(self, a, b):
        """Overlap at which sets of sizes a and b link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct k-word shingles: the whole sequence if it has fewer words, none without words."""
    places = np.resize(_PLACES, k) * (np.uint64(2) * (np.arange(k, dtype=np.uint64) // np.uint64(len(_PLACES))) + np.uint64(1))
    for first, last, data, offsets in text_chunks(column):
        data = ascii_lower(data)
        starts, ends, words = word_spans(data, offsets, _IS_WORD)
        hashes = span_hash(prefix_hash(data), starts, ends)
        count = max(0, len(hashes) - k + 1)
        rolled = np.zeros(count, np.uint64)
        for j in range(k):
            rolled += mix(hashes[j : j + count] + np.uint64(j + 1)) * places[j]
        rolled = mix(rolled)
        for i in range(last - first):
            a, b = int(words[i]), int(words[i + 1])
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.add.reduce(mix(tokens ^ np.uint64(salt)), dtype=np.uint64)
        out.append(int(mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def name_sets(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (shingles) and the digest (d1, d2) of each document's set, in rows whose d1 isn't null; and in the others, as often
    (token) and times, the shingles of more than one in HOT_SHARE of those that a task gathers, each set counting once there."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d1", "d2", "often", "times"]
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def frequent(kind: pa.DataType) -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= max(3, -(-size // HOT_SHARE))
            tokens, times = tokens[many].view(np.int64), times[many].astype(np.int64)
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), kind), none, none, none, pa.array(tokens), pa.array(times)], names=names)

        for batch in batches:
            sizes, digests = [], []
            for tokens in shingle_sets(batch.column(1), k):
                sizes.append(len(tokens))
                digests.append(set_digest(tokens))
                if len(tokens) and digests[-1] not in seen:
                    held.append(tokens)
                    seen.add(digests[-1])
                    size += len(tokens)
                    if size >= GATHER:
                        yield frequent(batch.column(0).type)
                        held, seen, size = [], set(), 0
            d1, d2 = zip(*digests, strict=True) if digests else ((), ())
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), none, none], names=names)
        if held:
            yield frequent(batch.column(0).type)

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2", "often", "times"))])
    return docs.select(F.col(doc_id).alias("doc_id"), text).transform(mapped, run, schema)


def hot_shingles(named: DataFrame, total: int) -> np.ndarray:
    """(2, k): shingles of one in HOT_SHARE of `total` or more, in order, and about how often they occur.

    A shingle of two in HOT_SHARE of all is here for certain: the tasks that don't report it hold less than half of it. Their number is
    bounded by HOT_SHARE, whatever the corpus; counts needn't be exact, as they only order shingles by rarity.
    """
    rows = named.where("often is not null").groupBy("often").agg(F.sum("times").alias("times")).where(F.col("times") >= max(PART_SHINGLES // 4, total // HOT_SHARE))
    found = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 2).T
    return found[:, np.argsort(found[0].view(np.uint64) if found.size else found[0])] if found.size else found


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """A range from 0 to n - 1 for each 64-bit key, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


PACKED = "part int, kind int, packed binary"


def _packed(parts: list[int], blobs: list[bytes], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "packed"])


def _deal(key: np.ndarray, n: int, *columns: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Packed columns by range of a sorted key."""
    cuts = np.searchsorted(_ranges(key, n), np.arange(n + 1, dtype=np.uint64))
    parts, blobs = [], []
    for r in range(n):
        a, b = int(cuts[r]), int(cuts[r + 1])
        if b > a:
            parts.append(r)
            blobs.append(pack_arrays(*(c[a:b] for c in columns)))
    return _packed(parts, blobs, kind)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """The packed columns of each part in a task's sorted rows."""
    part, held = None, []
    for batch in batches:
        for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and at != part:
                yield held
                held = []
            part = at
            held.append(unpack_arrays(data.as_py()))
    if held:
        yield held


def signature_bits(n: int) -> int:
    return 1 << max(9, min(13, (4 * max(n, 1) - 1).bit_length()))


def signature(tokens: np.ndarray, n: int) -> bytes:
    """Parity of the tokens that fall on each bit: two signatures differ in no more bits than the sets do in tokens."""
    bits = signature_bits(n)
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _signatures(rows: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to the shortest one's length."""
    width = min(map(len, rows)) // 8
    out = np.empty((len(rows), width), np.uint64)
    for i, row in enumerate(rows):
        words = np.frombuffer(row, np.uint64)
        while len(words) > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def _near(bound: Bound, sig: np.ndarray, n: np.ndarray, lone: np.ndarray, i: int, to: int) -> np.ndarray:
    """Rows before `to` that may link with row i by size and signature; lone: tokens that no other set has."""
    a, b = n[i], n[:to]
    most = a + b - 2 * bound.overlap(a, b) - lone[i] - lone[:to]
    at = np.flatnonzero((most >= 0) & (bound.den * np.minimum(a, b) >= bound.num * np.maximum(a, b)))
    if len(at):
        at = at[np.bitwise_count(sig[at] ^ sig[i]).sum(axis=1) <= most[at]]
    return at


def survivors(docs: DataFrame, k: int, bound: Bound, total: int, hot: np.ndarray, clash: frozenset[int], text: str = "text") -> DataFrame:
    """The sets that can have links: set_id, n, tokens shared with other sets (sorted), prefix (the rarest of them), list_cost, signature.

    Shingles are dealt by range of their hash as packed, sorted arrays, counted over all sets there, and those of two sets or more go
    back to their sets. A link needs an overlap of least_size(n), so a set with fewer shared tokens is dropped; of the others any link
    shares a token among the m - least_size(n) + 1 rarest shared ones (m of them in all). Hot shingles, which may be in a third of all
    sets, go back to their sets at once, with the count that is known. A set's name is d1, or d2 where two sets have the same d1 (clash).
    """
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // PART_SHINGLES))
    often = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()
        size = 0
        known = often.value[0].view(np.uint64) if often.value.size else np.zeros(0, np.uint64)

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            ids = np.array(names, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                is_hot = known[at] == tokens
                name, times = ids[owner[is_hot]], np.minimum(often.value[1][at[is_hot]], 0xFFFFFFFF).astype(np.uint32)
                order = np.argsort(name.view(np.uint64), kind="stable")
                yield _deal(name.view(np.uint64)[order], parts, name[order], tokens[is_hot][order], times[order], sizes[owner[is_hot]].astype(np.uint32)[order], kind=1)
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            cuts = np.searchsorted(_ranges(tokens, parts), np.arange(parts + 1, dtype=np.uint64))
            rows, blobs = [], []
            for r in range(parts):
                a, b = int(cuts[r]), int(cuts[r + 1])
                if b > a:
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    rows.append(r)
                    blobs.append(pack_arrays(tokens[a:b], local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), ids[used], sizes[used].astype(np.uint32)))
            yield _packed(rows, blobs, 0)

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), k):
                if not len(tokens):
                    continue
                d1, d2 = set_digest(tokens)
                name = d2 if d1 in clash else d1
                if name not in seen:
                    held.append(tokens)
                    names.append(name)
                    seen.add(name)
                    size += len(tokens)
                    if size >= GATHER:
                        yield from flush()
                        held, names, seen, size = [], [], set(), 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_part(batches):
            tokens = np.concatenate([f[0] for f in found])
            ids = np.concatenate([f[2][f[1]] for f in found])
            sizes = np.concatenate([f[3][f[1]] for f in found])
            order = np.argsort(tokens)
            tokens = tokens[order]
            same = tokens[1:] == tokens[:-1]
            twice = np.zeros(len(tokens), bool)
            twice[1:] |= same
            twice[:-1] |= same
            order, tokens = order[twice], tokens[twice]
            ids, sizes = ids[order], sizes[order]
            order = np.lexsort((ids, tokens))  # copies of a set count once
            tokens, ids, sizes = tokens[order], ids[order], sizes[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
            tokens, ids, sizes = tokens[new], ids[new], sizes[new]
            _, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
            df = df[inverse]
            tokens, ids, sizes, df = tokens[df > 1], ids[df > 1], sizes[df > 1], df[df > 1]
            if len(ids):
                order = np.argsort(ids.view(np.uint64), kind="stable")
                yield _deal(ids.view(np.uint64)[order], parts, ids[order], tokens[order], df[order].astype(np.uint32), sizes[order])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_part(batches):
            ids, tokens, df, sizes = (np.concatenate([f[i] for f in found]) for i in range(4))
            order = np.lexsort((tokens, df, ids))
            ids, tokens, df, sizes = ids[order], tokens[order], df[order], sizes[order]
            new = np.ones(len(ids), bool)  # a set's hot shingles come once from each task that has a copy of it
            new[1:] = (ids[1:] != ids[:-1]) | (tokens[1:] != tokens[:-1])
            ids, tokens, df, sizes = ids[new], tokens[new], df[new], sizes[new]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ends = np.append(starts[1:], len(ids))
            rows = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                n = int(sizes[a])
                prefix = b - a - bound.least_size(n) + 1
                if prefix > 0:
                    shared = tokens[a:b]
                    rows.append((int(ids[a]), n, np.sort(shared).tobytes(), shared[:prefix].tobytes(), int(df[a : a + prefix].sum()), signature(shared, n)))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SET_TYPES, strict=True)], names=_SET_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SET_TYPES, strict=True)], names=_SET_NAMES)

    packed = docs.select(text).transform(mapped, deal, PACKED)
    if hot.size:
        packed = materialise(packed)
    counted = dealt(packed.where("kind = 0"), parts).select("part", "packed").transform(mapped, count, PACKED)
    if hot.size:
        counted = counted.union(packed.where("kind = 1"))
    gathered = dealt(counted, parts).select("part", "packed")
    return materialise(gathered.transform(mapped, gather, "set_id bigint, n int, tokens binary, prefix binary, list_cost bigint, signature binary"))


_SET_NAMES = ["set_id", "n", "tokens", "prefix", "list_cost", "signature"]
_SET_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]


def subset_sizes(n: int, bound: Bound, largest: int) -> list[int]:
    """Sizes of the subsets that a small set of n shares with any other small set it links with."""
    sizes = {bound.overlap(n, s) for s in range(bound.least_size(n), min(n * bound.den // bound.num, largest) + 1)}
    return sorted(c for c in sizes if 0 < c <= n)


def choose_boundary(sets: DataFrame, bound: Bound, most: int = MOST_LIGHT) -> int:
    """The size up to which enumerating subsets costs no more than scanning inverted lists; at most `most` rows reach the driver."""
    m = F.octet_length("tokens") / 8
    rows = sets.where(F.col("n") <= most).groupBy("n", m.cast("int").alias("m")).agg(F.count("*").alias("k"), F.sum("list_cost").alias("c")).collect()
    best, boundary = None, 0
    for x in range(most + 1):
        light = sum(r["k"] * sum(comb(r["m"], c) for c in subset_sizes(r["n"], bound, x)) for r in rows if r["n"] <= x)
        heavy = sum(r["c"] for r in rows if r["n"] > x or r["n"] >= bound.least_size(x + 1))
        if best is None or light + heavy < best:
            best, boundary = light + heavy, x
    return boundary


def postings(sets: DataFrame, bound: Bound, boundary: int) -> DataFrame:
    """(key, set_id, n, m, signature): hashed subsets of small sets, prefix tokens of large sets and of the small ones they may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, (n, tokens, prefix) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                made = []
                if n >= bound.least_size(boundary + 1):
                    made.append(np.frombuffer(prefix.as_py(), np.uint64))
                if n <= boundary:
                    shared = np.frombuffer(tokens.as_py(), np.uint64)
                    for c in subset_sizes(n, bound, boundary):
                        if c <= len(shared):
                            chosen = shared[np.array(list(combinations(range(len(shared)), c)), np.int64)]
                            made.append(mix(np.add.reduce(mix(chosen), axis=1, dtype=np.uint64) + np.uint64(c)))
                if made:
                    made = np.concatenate(made)
                    keys.append(made)
                    rows.append(np.full(len(made), i))
            if keys:
                at = pa.array(np.concatenate(rows))
                m = pa.array([len(t.as_py()) // 8 for t in batch.column(2)], pa.int32())
                yield pa.RecordBatch.from_arrays([as_longs(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at), m.take(at), batch.column(5).take(at)], names=["key", "set_id", "n", "m", "signature"])

    return sets.transform(mapped, run, "key bigint, set_id bigint, n int, m int, signature binary")


def candidate_components(lists: DataFrame, bound: Bound) -> DataFrame:
    """(node, root) of components that no link leaves: sets of one list that sizes and signatures don't keep apart are joined.

    A list is compared inside a task and gives no more edges than it has sets. A list of more than LIST_SETS sets is split by the sets'
    size class (each set being in its own class and the next, as sets that link are at most one class apart); one that is still longer
    is joined whole, by edges to its smallest set, without gathering it: that only makes a component larger.
    """
    lists = materialise(lists)
    hot = materialise(lists.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > LIST_SETS).select("key"))
    classes = F.array(size_class(F.col("n"), bound), size_class(F.col("n"), bound) + 1)
    split = lists.join(hot, "key").withColumn("_class", F.explode(classes)).withColumn("key", F.xxhash64("key", "_class")).drop("_class")
    split = materialise(split)
    least = materialise(split.groupBy("key").agg(F.count("*").alias("k"), F.min("set_id").alias("least")).where(F.col("k") > LIST_SETS).select("key", "least"))
    stars = split.select("key", "set_id").join(least, "key").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    cold = lists.join(hot, "key", "left_anti").unionByName(split.join(least, "key", "left_anti"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()  # edges known in this task aren't sent again
        out: list[tuple[int, int]] = []

        def flush(keys, ids, n, m, sig) -> None:
            k = len(ids)
            if k < 2:
                return
            n, m = np.array(n, np.int64), np.array(m, np.int64)
            words = _signatures(sig)
            for i in range(1, k):
                for j in _near(bound, words, n, n - m, i, i).tolist():
                    if ids[i] != ids[j] and forest.join(ids[i], ids[j]):
                        out.append((ids[i], ids[j]))

        held: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] and held[0][0] != row[0]:
                    flush(*held)
                    held = ([], [], [], [], [])
                for h, x in zip(held, row, strict=True):
                    h.append(x)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        flush(*held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    parts = shuffle_partitions(lists.sparkSession)
    edges = cold.select("key", "set_id", "n", "m", "signature").repartition(parts, "key").sortWithinPartitions("key", "set_id").transform(mapped, compare, "a bigint, b bigint")
    return connected_components(materialise(edges).union(stars))


def size_class(n: Column, bound: Bound) -> Column:
    """Sizes of a class are within the similarity's ratio, so that sets that link are of one class or of two that follow each other."""
    return F.floor(F.log(n.cast("double")) / F.lit(log(bound.den / bound.num)) - 1e-9).cast("int") if bound.num < bound.den else n.cast("int")


class _Block:
    """Sets of a block that are compared with one another and with sets that pass by."""

    def __init__(self, bound: Bound, rows: list[dict]):
        self.bound, self.rows = bound, rows
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.tokens = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
        self.lone = self.n - np.array([len(t) for t in self.tokens], np.int64)
        self.sig = _signatures([r["signature"] for r in rows])

    def linked(self, i: int, j: int) -> bool:
        overlap = len(np.intersect1d(self.tokens[i], self.tokens[j], assume_unique=True))
        return self.bound.linked(overlap, int(self.n[i]), int(self.n[j]))


def _exact(bound: Bound, rows: list[dict], near=_near) -> list[int]:
    """The component, as its smallest set_id, of each row by links between these rows."""
    block, forest = _Block(bound, rows), Forest()
    ids = [r["set_id"] for r in rows]
    for i in range(1, len(rows)):
        for j in near(bound, block.sig, block.n, block.lone, i, i).tolist():
            if forest.root(ids[i]) != forest.root(ids[j]) and block.linked(i, j):
                forest.join(ids[i], ids[j])
    return [forest.root(x) for x in ids]


def _cross_links(members: DataFrame, passing: DataFrame, bound: Bound, near=_near) -> DataFrame:
    """Edges between roots of `members` and `passing` sets of the same candidate component that link but have other roots.

    Passing sets go to the blocks of their component that hold sets of their size class or the next ones; a task holds one block of
    members while they stream by.
    """
    blocks = members.select("component", "class", "block").distinct()
    classes = F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1))))
    visits = passing.drop("block").withColumn("class", classes).join(blocks, ["component", "class"]).withColumn("visit", F.lit(1))
    rows = members.withColumn("visit", F.lit(0)).unionByName(visits).select("component", "block", "visit", "set_id", "root", "n", "tokens", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, roots, forest = None, [], None, None, Forest()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["component"], row["block"]) != at:
                    at, held, block = (row["component"], row["block"]), [], None
                if not row["visit"]:
                    held.append(row)
                    continue
                if not held:
                    continue
                if block is None:
                    block = _Block(bound, held)
                    roots = [r["root"] for r in held]
                alone = _Block(bound, [row])
                sig = alone.sig[0]
                words = block.sig
                while len(sig) > words.shape[1]:
                    sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
                while words.shape[1] > len(sig):
                    words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
                k = len(held)
                for j in near(bound, np.vstack((words, sig)), np.append(block.n, alone.n), np.append(block.lone, alone.lone), k, k).tolist():
                    if forest.root(row["root"]) != forest.root(roots[j]):
                        overlap = len(np.intersect1d(block.tokens[j], alone.tokens[0], assume_unique=True))
                        if bound.linked(overlap, int(block.n[j]), row["n"]):
                            forest.join(row["root"], roots[j])
                            out.append((row["root"], roots[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    parts = shuffle_partitions(members.sparkSession)
    return rows.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "visit", "set_id").transform(mapped, run, "a bigint, b bigint")


def _relabel(members: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return members.join(roots, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def link_sets(sets: DataFrame, components: DataFrame, bound: Bound, near=_near) -> DataFrame:
    """(set_id, root) of every set with a link: exact components inside each candidate component.

    A component of up to BLOCK_SETS sets and BLOCK_BYTES bytes is one block. A larger one is dealt into blocks of one size class each;
    then a few sets of each block's largest part visit the blocks of sizes that they may link with, which joins the large parts, and
    every set that is not in the component's largest part after that visits them too, so that each pair that may link is compared.
    near: which rows before one may link with it by size and signature; other signatures than signature() come with their own.
    """
    members = sets.select("set_id", "n", "tokens", "signature").join(components.select(F.col("node").alias("set_id"), F.col("root").alias("component")), "set_id")
    members = materialise(members)
    sizes = members.groupBy("component").agg(F.count("*").alias("_k"), F.sum(F.octet_length("tokens")).alias("_b"))
    several = (F.col("_k") > BLOCK_SETS) | (F.col("_b") > BLOCK_BYTES)
    members = members.join(sizes.select("component", several.alias("several")), "component").withColumn("class", F.when(F.col("several"), size_class(F.col("n"), bound)).otherwise(0))
    sizes = members.where("several").groupBy("component", "class").agg(F.count("*").alias("_k"), F.sum(F.octet_length("tokens")).alias("_b"))
    blocks = F.greatest(F.ceil(F.col("_k") / BLOCK_SETS), F.ceil(F.col("_b") / BLOCK_BYTES)).cast("int")
    members = members.join(sizes.select("component", "class", blocks.alias("blocks")), ["component", "class"], "left")
    block = F.concat_ws(":", "class", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    members = materialise(members.withColumn("block", F.when(F.col("several"), block).otherwise("")).drop("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(held: list[dict]) -> pa.RecordBatch:
            roots = _exact(bound, held, near)
            columns = [pa.array([r[c] for r in held], t) for c, t in (("component", pa.int64()), ("class", pa.int32()), ("block", pa.string()), ("several", pa.bool_()), ("set_id", pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(roots, pa.int64())], names=["component", "class", "block", "several", "set_id", "root"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["component"], row["block"]) != (held[0]["component"], held[0]["block"]):
                    yield result(held)
                    held = []
                held.append(row)
        if held:
            yield result(held)

    parts = shuffle_partitions(sets.sparkSession)
    blocked = members.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "set_id")
    parted = materialise(blocked.transform(mapped, run, "component bigint, class int, block string, several boolean, set_id bigint, root bigint"))
    single = parted.where("not several").select("set_id", "root")
    several = parted.where("several").drop("several")
    if several.isEmpty():
        return single
    several = materialise(several.join(members.select("set_id", "n", "tokens", "signature"), "set_id"))
    largest = several.groupBy("component", "block", "root").count().groupBy("component", "block").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
    pivots = several.join(largest, ["component", "block", "root"])
    pivots = pivots.withColumn("_i", F.row_number().over(W.partitionBy("component", "block").orderBy("set_id"))).where(F.col("_i") <= PIVOTS).drop("_i")
    several = materialise(_relabel(several, _cross_links(several, pivots, bound, near)))
    largest = several.groupBy("component", "root").count().groupBy("component").agg(F.max_by("root", F.struct("count", "root")).alias("_most"))
    rest = several.join(largest, "component").where(F.col("root") != F.col("_most")).drop("_most")
    several = _relabel(several, _cross_links(several, rest, bound, near))
    return single.unionByName(several.select("set_id", "root"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of each document.

    Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of num / den or more. Texts without words
    (null, empty) link with nothing; fewer than k words make one shingle. Documents of equal sets are one node; repeated rows each get
    a row, ties are all kept, an empty table gives none. Texts of any length are shingled whole. Shingles are told apart by 64-bit
    hashes, sets by 128 bits.
    """
    bound = Bound(num, den)
    found = materialise(name_sets(docs, k, doc_id, text))
    named = found.where("d1 is not null").drop("often", "times")
    classes = materialise(named.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("_least"), F.max("n").alias("_n")))
    total = classes.agg(F.sum("_n")).first()[0] or 0
    # Two sets of one 64-bit digest: none is to be expected below 10**9 sets, some 70 at 5 * 10**10.
    clash = frozenset(r[0] for r in classes.groupBy("d1").count().where("count > 1").select("d1").collect())
    sets = survivors(docs, k, bound, total, hot_shingles(found, total), clash, text)
    lists = postings(sets, bound, choose_boundary(sets, bound))
    links = link_sets(sets, candidate_components(lists, bound), bound)
    name = F.when(F.col("d1").isin(*clash), F.col("d2")).otherwise(F.col("d1")) if clash else F.col("d1")
    classes = classes.withColumn("set_id", name).join(links, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    of = classes.join(least, "root").select("d1", "d2", "component_id")
    out = named.join(of, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op8_size_aware_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by four-word shingles and a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 17, 20)
