"""Suffix-array dedup: repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Suffixes are sorted at anchors only: in each window of `length` bytes the place of the least hash among its first starts (a minimizer).
Equal windows have their anchor at equal offsets, so a repeated window shows as two anchors whose suffixes agree to the window's end and
whose preceding bytes agree back to its start. Tasks sort the suffixes of their anchors into front-coded runs; the runs are exchanged
by range of the anchor context's hash (which all suffixes that can agree far enough share) and merged by loser trees that carry the common
prefix with the last output, so that no known prefix is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import dealt, mapped, materialise, mix, pack_arrays, prefix_hash, shuffle_partitions, span_hash, text_chunks, unpack_arrays

LENGTH = 200
GRAM = 16
#: Anchors or bytes of suffixes that a task gathers before it deals them out.
GATHER = 1_000_000
GATHER_BYTES = 24 << 20
#: Suffixes that are compared with the bytes before them at once (more where one group has more).
SLAB = 20_000
#: Bytes of a text that are hashed at once; longer texts are taken in overlapping pieces. Must be under 2 ** _PLACE_BITS.
PIECE = 4 << 20
_PLACE_BITS = 28


def span_of(length: int) -> int:
    """Starts of a window among which its anchor is chosen."""
    return length // 2 - 4


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side: place, first and last window start, text number and context hash of each anchor, by place."""
    if len(data) <= PIECE:
        return _anchors(data, offsets, length)
    found = []
    for at in range(0, len(data), PIECE):  # a piece has the windows that start in it
        part = data[at : at + PIECE + length - 1]
        inner = np.clip(offsets - at, 0, len(part))
        number = np.flatnonzero(np.diff(inner))
        place, first, last, text, context = _anchors(part, np.concatenate((inner[number], inner[-1:])), length)
        found.append([place + at, first + at, last + at, number[text] if len(text) else text, context])
    for before, after in zip(found, found[1:], strict=False):  # windows on both sides of a seam may have one anchor
        if len(before[0]) and len(after[0]) and before[0][-1] == after[0][0] and before[3][-1] == after[3][0]:
            after[1][0] = before[1][-1]
            before[:] = [c[:-1] for c in before]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    span = span_of(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    least = (span_hash(prefix, at, at + GRAM) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(offsets[1:][texts] - np.arange(len(data)) >= length)
    if not len(starts):
        return none, none, none, none, none.view(np.uint64)
    place = (least[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    place, first, last = place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return place, first, last, texts[first], span_hash(prefix, place, place + length - span + 1)


def _range_cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts of sorted 64-bit keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def repeated_contexts(texts: DataFrame, length: int) -> DataFrame:
    """(text_hash, n_bytes, contexts): of each text, the context hashes of its anchors that occur at two places or more."""
    parts = shuffle_partitions(texts.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, sizes, seen, count = [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _, _ in held])
            owner = np.concatenate([o for _, o, _ in held])
            times = np.concatenate([t for _, _, t in held])
            order = np.argsort(keys)
            keys, owner, times = keys[order], owner[order], times[order]
            cuts = _range_cuts(keys, parts)
            name, size = np.array(names, np.int64), np.array(sizes, np.int64)
            rows, blobs = [], []
            for r in range(parts):
                a, b = int(cuts[r]), int(cuts[r + 1])
                if b > a:
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    rows.append(r)
                    blobs.append(pack_arrays(keys[a:b], local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), times[a:b], name[used], size[used]))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "packed"])

        for batch in batches:
            hashes, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, _, data, offsets in text_chunks(batch.column(2)):
                _, _, _, text, context = anchors(data, offsets, length)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    if bounds[i] < bounds[i + 1] and (hashes[first + i], lengths[first + i]) not in seen:
                        keys, times = np.unique(context[bounds[i] : bounds[i + 1]], return_counts=True)
                        held.append((keys, np.full(len(keys), len(names), np.uint32), np.minimum(times, 2).astype(np.uint8)))
                        names.append(hashes[first + i])
                        sizes.append(lengths[first + i])
                        seen.add((hashes[first + i], lengths[first + i]))
                        count += len(keys)
                if count >= GATHER:
                    yield flush()
                    held, names, sizes, seen, count = [], [], [], set(), 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def result() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([f[0] for f in held])
            names = np.concatenate([f[3][f[1]] for f in held])
            times = np.concatenate([f[2] for f in held])
            sizes = np.concatenate([f[4][f[1]] for f in held])
            order = np.lexsort((sizes, names, keys))
            keys, names, times, sizes = keys[order], names[order], times[order], sizes[order]
            new = np.ones(len(keys), bool)  # the same text may come from several tasks
            new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]) | (sizes[1:] != sizes[:-1])
            keys, names, times, sizes = keys[new], names[new], times[new], sizes[new]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            total = np.add.reduceat(times.astype(np.int64), starts)
            again = np.repeat(total > 1, np.diff(np.append(starts, len(keys))))
            keys, names, sizes = keys[again], names[again], sizes[again]
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(sizes[part]), pa.array(keys[part].view(np.int64))], names=["text_hash", "n_bytes", "context"])

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and at != part:
                    yield from result()
                    held = []
                part = at
                held.append(unpack_arrays(data.as_py()))
        if held:
            yield from result()

    packed = texts.select("text_hash", "n_bytes", "text").transform(mapped, deal, "part int, packed binary")
    found = dealt(packed, parts).transform(mapped, count, "text_hash bigint, n_bytes bigint, context bigint")
    return found.groupBy("text_hash", "n_bytes").agg(F.collect_list("context").alias("contexts"))


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, of which `start` bytes are known."""
    n = min(len(a), len(b)) - start
    x = int.from_bytes(a[start : start + n], "big") ^ int.from_bytes(b[start : start + n], "big")
    return start + n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the suffix before) of all suffixes in order, from sorted runs of (common prefix with the run's
    suffix before, suffix).

    A loser tree. known[r] is the common prefix of run r's head with the suffix put out last; of two heads the one that shares more with
    it comes first without a comparison, and equal heads are compared from there on.
    """
    count = len(runs)
    if not count:
        return
    leaves = 1 << max(0, (count - 1).bit_length())
    place = [0] * leaves
    known = [0 if r < count and runs[r] else -1 for r in range(leaves)]  # -1: no more suffixes
    head = [runs[r][0][1] if r < count and runs[r] else b"" for r in range(leaves)]
    loser = [0] * leaves

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        a, b = known[x], known[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0:
            return x, y
        both = _common(head[x], head[y], a)
        p, q = head[x], head[y]
        if both == len(p) or (both < len(q) and p[both] < q[both]):
            known[y] = both
            return x, y
        known[x] = both
        return y, x

    winners = list(range(leaves))
    level = leaves // 2
    while level:
        nexts = []
        for i in range(level):
            won, lost = play(winners[2 * i], winners[2 * i + 1])
            loser[level + i] = lost
            nexts.append(won)
        winners = nexts
        level //= 2
    top = winners[0]
    while known[top] >= 0:
        yield top, place[top], known[top]
        place[top] += 1
        if place[top] < len(runs[top]):
            known[top], head[top] = runs[top][place[top]]
        else:
            known[top] = -1
        node = (leaves + top) // 2
        while node:
            x = loser[node]
            a, b = known[top], known[x]
            if a < b:
                loser[node], top = top, x
            elif a == b and a >= 0:
                top, loser[node] = play(top, x)
            node //= 2


def _front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefixes with the one before, lengths and remaining bytes of sorted suffixes."""
    shared = [0, *(_common(a, b, 0) for a, b in zip(suffixes, suffixes[1:], strict=False))]
    tails = b"".join(s[k:] for s, k in zip(suffixes, shared, strict=True))
    return np.array(shared, np.uint32), np.fromiter(map(len, suffixes), np.uint32, len(suffixes)), np.frombuffer(tails, np.uint8)


def _decoded(shared: np.ndarray, lengths: np.ndarray, tails: bytes) -> list[tuple[int, bytes]]:
    out, before, at = [], b"", 0
    for k, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:k] + tails[at : at + n - k]
        at += n - k
        out.append((k, before))
    return out


def repeated_windows(common: np.ndarray, lefts: list[bytes], low: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """Of sorted suffixes, a row for each and a column for each offset: whether the window that starts so many bytes before occurs twice.

    common: prefix shared with the suffix before; lefts: bytes before; low: least offset of the suffix's windows; own: whether the suffix
    counts (a text's copy from another task doesn't).
    """
    span = span_of(length)
    sizes = np.fromiter(map(len, lefts), np.int64, len(lefts))
    bytes_before = np.zeros((len(lefts), span), np.uint8)
    for i, left in enumerate(lefts):
        if left:
            bytes_before[i, : len(left)] = np.frombuffer(left, np.uint8)[::-1]
    out = np.zeros((len(lefts), span), bool)
    left_hash = np.zeros(len(lefts), np.uint64)
    for offset in range(span):
        if offset:
            left_hash = mix(left_hash * np.uint64(0x9E3779B97F4A7C15) + bytes_before[:, offset - 1] + np.uint64(1))
        active = np.flatnonzero(own & (low <= offset) & (sizes >= offset))
        if len(active) < 2:
            continue
        group = np.cumsum(common < length - offset)[active].astype(np.uint64)
        _, inverse, times = np.unique(left_hash[active] ^ mix(group + np.uint64(1)), return_inverse=True, return_counts=True)
        out[active[times[inverse] > 1], offset] = True
    return out


SPANS = "text_hash bigint, n_bytes bigint, first bigint, last bigint"


def find_repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_hash, n_bytes, spans) of the texts (text_hash, n_bytes, text) with bytes inside strings of `length` that occur elsewhere.

    Copies of a text count as one here; see remove_repeats for whole copies.
    """
    parts = shuffle_partitions(texts.sparkSession)
    flagged = texts.join(repeated_contexts(texts, length), ["text_hash", "n_bytes"]).select("text_hash", "n_bytes", "text", "contexts")

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (context, suffix, left, text_hash, n_bytes, place, least offset)
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: (((r[0] >> 32) * parts) >> 32, r[1], r[2]))
            rows, kinds, blobs = [], [], []
            i = 0
            while i < len(held):
                part = ((held[i][0] >> 32) * parts) >> 32
                j = i
                kept, known = [], []
                while j < len(held) and ((held[j][0] >> 32) * parts) >> 32 == part:
                    k = j + 1
                    while k < len(held) and held[k][0] == held[j][0] and held[k][1] == held[j][1] and held[k][2] == held[j][2]:
                        k += 1
                    kept.append(held[j])  # equal suffixes with equal bytes before: one stands for all, whose windows all repeat
                    if k - j > 1:
                        known += held[j:k]
                    j = k
                shared, lengths, tails = _front_coded([r[1] for r in kept])
                lefts = [r[2] for r in kept]
                numbers = [np.array([r[c] for r in kept], np.int64) for c in (3, 4, 5, 6)]
                rows.append(part)
                kinds.append(0)
                blobs.append(pack_arrays(shared, lengths, tails, np.fromiter(map(len, lefts), np.uint32, len(lefts)), np.frombuffer(b"".join(lefts), np.uint8), *numbers))
                if known:
                    rows.append(part)
                    kinds.append(1)
                    blobs.append(pack_arrays(*(np.array(c, np.int64) for c in zip(*((r[3], r[4], r[5] - len(r[2]), r[5] - r[6] + length) for r in known), strict=True))))
                i = j
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "packed"])

        for batch in batches:
            hashes, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, _, data, offsets in text_chunks(batch.column(2)):
                place, first, last, text, context = anchors(data, offsets, length)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    name = (hashes[start + i], lengths[start + i])
                    if bounds[i] == bounds[i + 1] or name in seen:
                        continue
                    seen.add(name)
                    mine = slice(bounds[i], bounds[i + 1])
                    wanted = batch.column(3)[start + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    hit = np.flatnonzero(np.isin(context[mine], wanted)) + bounds[i]
                    base = int(offsets[i])
                    for h, p, f, e in zip(context[hit].tolist(), place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                        held.append((h, raw[p : e + length], raw[f:p], *name, p - base, p - e))
                        size += e + length - f + 100
                if size >= GATHER_BYTES:
                    yield flush()
                    held, seen, size = [], set(), 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []

        def spans(names, sizes, firsts, lasts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (names, sizes, firsts, lasts)], names=["text_hash", "n_bytes", "first", "last"])

        def slab(rows: list[tuple[int, int, int]], lefts, numbers) -> pa.RecordBatch:
            common = np.array([r[2] for r in rows], np.int64)
            before = [lefts[r][i] for r, i, _ in rows]
            name, size, place, low = (np.array([numbers[r][c][i] for r, i, _ in rows], np.int64) for c in range(4))
            order = np.lexsort((size, place, name))
            own = np.ones(len(rows), bool)
            a, b = order[:-1], order[1:]
            own[b[(name[a] == name[b]) & (place[a] == place[b]) & (size[a] == size[b])]] = False
            marks = repeated_windows(common, before, low, own, length)
            edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, nearest = np.nonzero(edges == 1)
            _, past = np.nonzero(edges == -1)
            return spans(name[row], size[row], place[row] - past + 1, place[row] - nearest + length)

        def result() -> Iterator[pa.RecordBatch]:
            decoded = [_decoded(f[0], f[1], f[2].tobytes()) for f in runs]
            lefts = []
            for f in runs:
                ends = np.cumsum(f[3].astype(np.int64)).tolist()
                raw = f[4].tobytes()
                lefts.append([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            numbers = [[c.tolist() for c in f[5:9]] for f in runs]
            least = length - span_of(length) + 1
            rows: list[tuple[int, int, int]] = []
            for row in merge_runs(decoded):
                if row[2] < least and len(rows) >= SLAB:
                    yield slab(rows, lefts, numbers)
                    rows = []
                rows.append(row)
            if rows:
                yield slab(rows, lefts, numbers)

        for batch in batches:
            for at, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if runs and at != part:
                    yield from result()
                    runs = []
                part = at
                found = unpack_arrays(data.as_py())
                if kind:
                    yield spans(*found)
                else:
                    runs.append(found)
        if runs:
            yield from result()

    runs = flagged.transform(mapped, sort_runs, "part int, kind int, packed binary")
    found = dealt(runs, parts, "part", "kind").transform(mapped, merge, SPANS)
    return found.groupBy("text_hash", "n_bytes").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Add n_bytes, removed_spans (array of first byte, end), kept (the remaining bytes) and kept_text to each row.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same text or another, on the texts as they
    come. Null texts count as empty; texts shorter than `length` stay whole; rows of equal text (of `length` bytes or more) lose all of
    it; kept_text leaves out characters of which bytes have gone; equal rows get equal results, an empty table none; texts of any length
    are taken whole. Texts are told apart by their length and a 64-bit hash. Columns of the result's names are replaced.
    """
    docs = docs.drop("n_bytes", "removed_spans", "kept", "kept_text", "text_hash", "spans")
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = docs.withColumn("text_hash", F.xxhash64(content)).withColumn("n_bytes", F.octet_length(content).cast("long"))
    texts = named.where(F.col("n_bytes") >= length).select("text_hash", "n_bytes", F.col(text).alias("text"))
    copies = texts.groupBy("text_hash", "n_bytes").count().where("count > 1")
    whole = copies.select("text_hash", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last"))).alias("spans"))
    spans = find_repeats(texts, length).unionByName(whole).groupBy("text_hash", "n_bytes").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = materialise(spans)
    joined = named.join(spans, ["text_hash", "n_bytes"], "left").select(*docs.columns, "n_bytes", "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for value, gone in zip(batch.column(text), batch.column("spans").to_pylist(), strict=True):
                data = (value.as_py() or "").encode()
                found = union_spans([(s["first"], s["last"]) for s in gone or ()])
                cuts = [0, *(x for span in found for x in span), len(data)]
                removed.append([list(x) for x in found])
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            names = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names=[*names, "removed_spans", "kept", "kept_text"])

    return joined.transform(mapped, cut, schema)


def op3_suffix_merge(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


