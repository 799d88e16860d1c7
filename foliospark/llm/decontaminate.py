"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import mapped

WINDOW = 10
#: Pattern words held by one table; larger benchmarks are scanned in several passes of this size. Bounds what is broadcast.
PASS_WORDS = 2_000_000

#: A-Z to lower case; every other ASCII character but digits and letters ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class WuManber:
    """Tables over patterns of one length m: shifts of two-word blocks and buckets of patterns by their last block."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[int]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.buckets[pattern[m - self.block :]].append((list(pattern), sorted(items)))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence, by start."""
        m, shift, buckets, n = self.m, self.shift.get, self.buckets, len(words)
        end = m
        if self.block == 1:
            while end <= n:
                if (block := (words[end - 1],)) in buckets:
                    yield end - 1, [i for _, items in buckets[block] for i in items]
                end += 1
            return
        far = m - 1  # a block that no pattern has lets the window pass it
        while end <= n:
            block = (words[end - 2], words[end - 1])
            step = shift(block, far)
            if step:
                end += step
                continue
            start = end - m
            window = words[start:end]
            for pattern, items in buckets[block]:
                if pattern == window:
                    yield start, items
            end += 1


def item_windows(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """Every run of `window` words; all the words of a shorter item."""
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def build_tables(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for pattern in item_windows(words_of(text), window):
            by_length[len(pattern)][pattern].update(() if item is None else (item,))
    return [WuManber(patterns, m) for m, patterns in sorted(by_length.items())]


def scan(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of words inside occurrences, merged, and the items that occur."""
    found: list[tuple[int, int]] = []
    items: set[int] = set()
    for table in tables:
        for start, of in table.search(words):
            found.append((start, start + table.m))
            items.update(of)
    spans: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans, items


def _passes(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of the benchmark, each of at most PASS_WORDS pattern words (or one item)."""
    held, size = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item).toLocalIterator():
        cost = len(words_of(row[1])) * window
        if held and size + cost > PASS_WORDS:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += cost
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_words, hit_spans (of words, end exclusive) and items (occurring item ids, ascending) to each document.

    A document word inside any occurrence of an item's window is hit. Null or empty texts have no words; items without words have
    no windows, items without an id hit words but aren't listed; ties and repeated rows each get their own result; an empty benchmark
    finds nothing. Texts of any length are searched whole. The pattern tables are broadcast
    in blocks of bounded size, the documents being scanned once for each block without any shuffle. Columns of the result's names
    are replaced.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType()))]
    names = {f.name for f in added}
    docs = docs.drop(*names)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<array<bigint>>"), "items": F.array().cast("array<bigint>")})
    schema = out.schema
    for block in _passes(benchmark, item, text, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = build_tables(shared.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for value, old, had in zip(batch.column(text), batch.column("hit_spans"), batch.column("items"), strict=True):
                    words = words_of(value.as_py())
                    found, of = scan(words, tables)
                    counts.append(len(words))
                    spans.append(_merge(found, old.as_py()))
                    items.append(sorted(of.union(had.as_py())))
                columns = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.transform(mapped, search, schema)
    return out


def _merge(found: list[tuple[int, int]], old: list[list[int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for start, end in sorted([*found, *map(tuple, old)]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    return spans


def digest(found: DataFrame) -> DataFrame:
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op5_wu_manber(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(find_contamination(docs, benchmark))


def items_digest(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
