"""MinHash near-dedup by SetSketch: registers of truncated, exponentially spaced minima, banded, estimated jointly by likelihood, verified."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.components import Forest, as_longs, connected_components
from foliospark.llm.jaccard import LIST_SETS, Bound, link_sets, set_digest, shingle_sets, size_class
from foliospark.llm.shared import mapped, materialise, mix, shuffle_partitions

#: Bands and the registers of each: a pair of similarity 0.8 shares no band once in 2 * 10**7 times. Registers are a power of two.
BANDS, BAND = 32, 4
REGISTERS = BANDS * BAND
#: A register holds floor(1 - log_BASE(h)) of the smallest h, an exponential variable of rate RATE, kept within 0 and LIMIT.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Standard deviations of the estimate that a pair may be below the bound and still be verified.
SLACK = 7.0
#: Hashed single bits of the registers that come with a band, to tell apart what shares a band by chance.
SAMPLE_BITS = 128
#: Points that are made at once.
SKETCH_POINTS = 400_000


def _minima(sets: list[np.ndarray], registers: int, rate: float) -> np.ndarray:
    """The smallest of each register's exponential variables over each set's tokens (sorted, distinct, 64 bits), a row for each set.

    A token gives each register an exponential variable of rate `rate`, told as points of one Poisson process of rate * registers whose
    points each fall into a register at random: a register's variable is its first point's time. A token's points are made in order of
    time and only up to a bound, by which a set's registers are likely to be full; else the set's bound is raised.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    least = np.full(len(sets) * registers, np.inf)
    bound = (log(registers) + 3) / (rate * np.maximum(sizes, 1))
    state = mix((np.concatenate(sets) if sets else np.zeros(0, np.uint64)) ^ np.uint64(0x5851F42D4C957F2D))
    owner, time = np.repeat(np.arange(len(sets)), sizes), np.zeros(int(sizes.sum()))
    later: list[tuple[np.ndarray, ...]] = []
    moved = False  # whether the points at hand are made, but not yet taken
    while True:
        while len(state):
            if not moved:
                state = mix(state + np.uint64(0x9E3779B97F4A7C15))
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate * registers)
            moved = False
            early = time < bound[owner]
            later.append((state[~early], time[~early], owner[~early]))
            state, time, owner = state[early], time[early], owner[early]
            at = (state & np.uint64(registers - 1)).astype(np.int64)  # the time has the bits above
            np.minimum.at(least, owner * registers + at, time)
        short = (sizes > 0) & ~np.isfinite(least.reshape(len(sets), registers)).all(axis=1)
        if not short.any():
            return least.reshape(len(sets), registers)
        bound = np.where(short, 2 * bound, 0)
        state, time, owner = (np.concatenate(x) for x in zip(*later, strict=True))
        later, moved = [], True
        keep = short[owner]
        state, time, owner = state[keep], time[keep], owner[keep]


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """The registers of each set; those of a union are the larger ones of its parts' (merge). An empty set's are 0."""
    out = np.zeros((len(sets), registers), np.uint16)
    first, size = 0, 0
    for i, s in enumerate(sets):
        size += len(s) + 16 * registers
        if size >= SKETCH_POINTS or i == len(sets) - 1:
            least = _minima(sets[first : i + 1], registers, RATE)
            out[first : i + 1] = np.clip(np.floor(1 - np.log(least) / log(BASE)), 0, LIMIT).astype(np.uint16)
            first, size = i + 1, 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def estimate(above: np.ndarray, below: np.ndarray, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets of sizes a and b, `above` of whose m registers are larger in the first and `below` in the second.

    A register is larger in the first with probability p(u - v * J), in the second with p(v - u * J), where u and v are the sets' shares
    of a + b and p(x) = -log_BASE(1 - x * (BASE - 1) / BASE); the likelihood is concave in J, so its slope's zero is found by halving.
    """
    u, v = a / (a + b), b / (a + b)
    share = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * share) / log(BASE)
    slope_p = lambda x: share / (1 - x * share) / log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    equal = m - above - below
    tiny = 1e-12
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, tiny), np.maximum(v - u * j, tiny)
        px, py = p(x), p(y)
        slope = equal * (v * slope_p(x) + u * slope_p(y)) / np.maximum(1 - px - py, tiny) - above * v * slope_p(x) / px - below * u * slope_p(y) / py
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def _least_estimate(bound: Bound, m: int) -> float:
    j = bound.num / bound.den
    return j - SLACK * (j * (1 - j) / m) ** 0.5


def near_by_sketch(bound: Bound, sig: np.ndarray, n: np.ndarray, lone: np.ndarray, i: int, to: int) -> np.ndarray:
    """Rows before `to` whose similarity to row i may reach the bound by size and by the joint estimate from the registers (sig)."""
    a, b = n[i], n[:to]
    at = np.flatnonzero(bound.den * np.minimum(a, b) >= bound.num * np.maximum(a, b))
    if not len(at):
        return at
    own, theirs = sig[i].view(np.uint16), sig[at].view(np.uint16)
    above, below = (own > theirs).sum(axis=1), (own < theirs).sum(axis=1)
    least = _least_estimate(bound, len(own))
    some = np.flatnonzero(len(own) - above - below >= (least - 0.1) * len(own))  # an estimate is hardly above the share of equal registers
    return at[some[estimate(above[some], below[some], len(own), np.full(len(some), a, float), b[at[some]].astype(float)) >= least]]


def sketch_documents(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (a hash of id and text), n (shingles), d1 and d2 (the set's name), registers (null if the task has met the set before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sizes, digests, registers, fresh = [], [], [], []
            held = 0

            def fill(registers=registers, fresh=fresh) -> None:
                for (i, _), row in zip(fresh, sketches([t for _, t in fresh]), strict=True):
                    registers[i] = row.tobytes()
                fresh.clear()

            for tokens in shingle_sets(batch.column(2), k):
                sizes.append(len(tokens))
                digests.append(set_digest(tokens))
                registers.append(None)
                if len(tokens) and digests[-1] not in seen:
                    seen.add(digests[-1])
                    fresh.append((len(registers) - 1, tokens))
                    held += len(tokens)
                    if held >= SKETCH_POINTS:
                        fill()
                        held = 0
            fill()
            d1, d2 = zip(*digests, strict=True) if digests else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(registers, pa.binary())], names=["doc_id", "key", "n", "d1", "d2", "registers"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("key", "n", "d1", "d2")), T.StructField("registers", T.BinaryType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text).transform(mapped, run, schema)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row's bands (rows x REGISTERS of uint16)."""
    words = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(registers), BANDS)).copy()
    for i in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + words[:, :, i])
    return keys


def sample_bits(registers: np.ndarray) -> np.ndarray:
    """SAMPLE_BITS hashed bits of each row, one of every register up to that many, as 64-bit words."""
    bits = (mix(registers[:, :SAMPLE_BITS].astype(np.uint64) + np.arange(SAMPLE_BITS, dtype=np.uint64) * np.uint64(1 << 20)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def bands(sets: DataFrame) -> DataFrame:
    """(key, set_id, n, s0, s1) of each band of each set, s0 and s1 being its sample bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                registers = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                rows = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                sample = sample_bits(registers)
                yield pa.RecordBatch.from_arrays([as_longs(band_keys(registers).ravel()), part.column(0).take(rows), part.column(1).take(rows), *(as_longs(sample[:, i]).take(rows) for i in (0, 1))], names=["key", "set_id", "n", "s0", "s1"])

    return sets.select("set_id", "n", "registers").transform(mapped, run, "key bigint, set_id bigint, n bigint, s0 bigint, s1 bigint")


def candidates(lists: DataFrame, bound: Bound) -> DataFrame:
    """(node, root) of components that no link of sets which share a band leaves.

    Sets of one band are joined where sizes and sample bits allow a link. A band of more than LIST_SETS sets is split by size class
    (each set being in its own class and the next); one that is still longer is joined whole, by edges to its smallest set.
    """
    hot = materialise(lists.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > LIST_SETS).select("key"))
    classes = F.array(size_class(F.col("n"), bound), size_class(F.col("n"), bound) + 1)
    split = materialise(lists.join(hot, "key").withColumn("_class", F.explode(classes)).withColumn("key", F.xxhash64("key", "_class")).drop("_class"))
    least = materialise(split.groupBy("key").agg(F.count("*").alias("k"), F.min("set_id").alias("least")).where(F.col("k") > LIST_SETS).select("key", "least"))
    stars = split.select("key", "set_id").join(least, "key").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    cold = lists.join(hot, "key", "left_anti").unionByName(split.join(least, "key", "left_anti"))
    j = bound.num / bound.den
    differ = int(SAMPLE_BITS * (1 - j) / 2 + SLACK * (SAMPLE_BITS * (1 - j) / 2 * (1 + j) / 2) ** 0.5)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()  # edges known in this task aren't sent again
        rest: list[np.ndarray] = []

        def edges(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
            key, ids, n, s0, s1 = columns
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for i in range(first + 1, last):
                    apart = np.bitwise_count((s0[first:i] ^ s0[i]).view(np.uint64)) + np.bitwise_count((s1[first:i] ^ s1[i]).view(np.uint64))
                    size, sizes = n[i], n[first:i]
                    near = (apart <= differ) & (bound.den * np.minimum(size, sizes) >= bound.num * np.maximum(size, sizes))
                    for k in np.flatnonzero(near).tolist():
                        a, b = int(ids[i]), int(ids[first + k])
                        if a != b and forest.join(a, b):
                            yield a, b

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = list(edges(columns))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            columns = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest or [np.zeros(0, np.int64)] * 5, batch.columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last key may go on
            yield from out([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if rest:
            yield from out(rest)

    parts = shuffle_partitions(lists.sparkSession)
    found = cold.select("key", "set_id", "n", "s0", "s1").repartition(parts, "key").sortWithinPartitions("key", "set_id").transform(mapped, compare, "a bigint, b bigint")
    return connected_components(materialise(found).union(stars))


def token_sets(docs: DataFrame, k: int, clash: frozenset[int], text: str) -> DataFrame:
    """set_id and the whole set (sorted 64-bit shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [((d[1] if d[0] in clash else d[0]), t.tobytes()) for t in shingle_sets(batch.column(0), k) for d in (set_digest(t),)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["set_id", "tokens"])

    return docs.select(text).transform(mapped, run, "set_id bigint, tokens binary")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (whether that is its own) of each document.

    Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of num / den or more, which is decided on
    the full sets of pairs that share a band of SetSketch registers. A pair of that similarity shares none with the probability at
    BANDS, a higher one less often still. Texts without words (null, empty) link with nothing; fewer than k words make one shingle.
    Documents of equal sets are one node; repeated rows and null ids each get a row, a null id's class being that of its text, ties are
    all kept, an empty table gives none, other columns aren't looked at. Texts of any length are shingled whole.
    """
    bound = Bound(num, den)
    named = materialise(sketch_documents(docs, k, doc_id, text))
    classes = named.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("_least"), F.max("n").alias("n"), F.min("key").alias("key"))
    clash = frozenset(r[0] for r in classes.groupBy("d1").count().where("count > 1").select("d1").collect())  # see jaccard_components
    name = F.when(F.col("d1").isin(*clash), F.col("d2")).otherwise(F.col("d1")) if clash else F.col("d1")
    classes = materialise(classes.withColumn("set_id", name))
    sets = named.where("registers is not null").select(name.alias("set_id"), "n", "registers").groupBy("set_id", "n").agg(F.max("registers").alias("registers"))
    sets = materialise(sets)
    components = materialise(candidates(materialise(bands(sets)), bound))
    wanted = classes.join(components.select(F.col("node").alias("set_id")), "set_id", "left_semi").select(F.col("key").alias("_key"))
    texts = docs.select(text, F.xxhash64(doc_id, text).alias("_key")).join(wanted, "_key", "left_semi")
    full = token_sets(texts, k, clash, text).join(sets.select("set_id", F.col("n").cast("int").alias("n"), F.col("registers").alias("signature")), "set_id")
    links = link_sets(full, components, bound, near_by_sketch).groupBy("set_id").agg(F.min("root").alias("root"))
    classes = classes.join(links, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    out = named.join(classes.join(least, "root").select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents by four-word shingles and a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 4, 5)
