"""Source divergence audit: how far the term frequencies of a language's sources are from one another, by DuckDB over hash shards."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.shared import mapped, materialise, shuffle_partitions, text_chunks

#: Bytes of text that one DuckDB query counts; rows of a shard; pairs of sources that one query sums up; sources of a block of groups.
COUNT_BYTES = 16 << 20
SHARD_ROWS = 500_000
PAIRS = 1_000_000
BLOCK_SOURCES = 1000
DUCKDB = {"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": "false"}
SCALE = 1_000_000_000

_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[:128] = 32
_TERM_BYTES[97:123] = np.arange(97, 123)
_TERM_BYTES[65:91] = np.arange(97, 123)


@contextmanager
def _duckdb():
    """A connection of one thread and bounded memory, which spills to a folder of this task that goes with it."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="duckdb-")
    con = duckdb.connect(config=DUCKDB | {"temp_directory": folder})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _rows(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in con.sql(sql).to_arrow_reader(50_000):
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types, strict=True)], schema=schema)


def _sharded(df: DataFrame, run: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """run(con, schema) over all rows of a task, which DuckDB reads as they come as table `rows`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with _duckdb() as con:
            con.register("rows", pa.RecordBatchReader.from_batches(first.schema, again()))
            yield from run(con, arrow)

    return df.transform(mapped, task, schema)


_COUNTS = "lang string, term string, source string, n bigint, d bigint"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
_COUNT_SQL = """
WITH words AS (SELECT row, lang, source, unnest(string_split(text, ' ')) AS term FROM texts),
once AS (SELECT row, lang, source, term, count(*) AS n FROM words WHERE term <> '' GROUP BY ALL)
SELECT lang, term, source, sum(n)::BIGINT AS n, count(*) AS d FROM once GROUP BY ALL"""


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, source, n (occurrences) and d (documents that hold the term), in parts: each task sums up COUNT_BYTES at once.

    Terms are the runs of ASCII letters, with A-Z lower-cased, and of characters beyond ASCII. Nulls count as empty strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.append_column("row", pa.array(np.arange(table.num_rows)))
            with _duckdb() as con:
                con.register("texts", table)
                yield from _rows(con, _COUNT_SQL, _COUNTS_ARROW)

        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(0)):
                blanked = pa.Array.from_buffers(pa.large_string(), last - first, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_TERM_BYTES[data])])
                held.append(pa.RecordBatch.from_arrays([blanked, *(batch.column(i).slice(first, last - first) for i in (1, 2))], names=["text", "lang", "source"]))
                size += len(data)
                if size >= COUNT_BYTES:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return docs.select(text, *(F.coalesce(c, F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).transform(mapped, run, _COUNTS)


_KEPT = "lang string, term string, source string, n bigint, first boolean"
_KEPT_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])


def keep_terms(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, source, n of terms in `least` documents of their language or more; first holds for one row of each lang and term."""
    sql = f"""
WITH merged AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM rows GROUP BY ALL),
often AS (SELECT lang, term, min(source) AS least FROM merged GROUP BY ALL HAVING sum(d) >= {least})
SELECT lang, term, source, n, source = least AS first FROM merged JOIN often USING (lang, term)"""
    shards = counts.repartition(shuffle_partitions(counts.sparkSession), "lang", "term")
    return _sharded(shards, lambda con, schema: _rows(con, sql, schema), _KEPT, _KEPT_ARROW)


def per_billion(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 5), wide(total) + 5 * wide(terms)
    return 1 + F.call_function("div", top, bottom)


_PART = "lang string, source string, other string, term string, value bigint"
_PART_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.string()), ("value", pa.int64())])


def _shard_parts(top: int) -> Callable:
    def run(con, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        con.execute("CREATE TABLE shard AS SELECT * FROM rows")
        yield from _rows(con, f"""
WITH spread AS (SELECT lang, source, term, p - (1 + {SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5) // (lang_total + 5::HUGEINT * terms)) AS f FROM shard)
SELECT lang, source, NULL, term, f FROM spread WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {top}""", schema)
        for lang, sources in con.execute("SELECT lang, count(DISTINCT source) FROM shard GROUP BY lang").fetchall():
            blocks = -(-sources * sources // PAIRS)
            con.execute("CREATE OR REPLACE TEMP TABLE one AS SELECT term, source, p, p0, hash(source) % $blocks AS block FROM shard WHERE lang = $lang", {"lang": lang, "blocks": blocks})
            for block in range(blocks):
                name = lang.replace("'", "''")
                yield from _rows(con, f"""
SELECT '{name}', a.source, b.source, NULL, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0)) FROM one a JOIN one b USING (term) WHERE a.source < b.source AND a.block = {block} GROUP BY ALL""", schema)

    return run


def _alone(groups: DataFrame, hist: DataFrame, n_groups: int) -> DataFrame:
    """Of each pair of a language's sources, the part of its sum that needs no term of both: as if no term had both.

    A group's frequencies (p, in how many terms) meet those that all other sources give to terms that they lack (p0). A block of
    a language's groups meets the list of its sources; each pair is one row of the result.
    """
    salts = max(1, -(-n_groups // BLOCK_SOURCES))
    salt = F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt")
    lists = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("all"))
    lists = lists.select("lang", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    steps = hist.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "k"))).alias("steps"))
    rows = groups.join(steps, ["lang", "source"], "left").select("lang", "source", "p0", "terms", salt, F.expr("coalesce(steps.p, array())").alias("p"), F.expr("coalesce(steps.k, array())").alias("k"))
    rows = rows.join(lists, ["lang", "salt"]).select("lang", "source", "p0", "terms", "p", "k", F.col("all.source").alias("others"), F.col("all.p0").alias("p0s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                own, p0, terms = row["source"].as_py(), row["p0"].as_py(), row["terms"].as_py()
                p, k, theirs = (np.array(row[c].values, np.int64) for c in ("p", "k", "p0s"))
                names = row["others"].values.to_pylist()
                upto_k, upto_p = np.concatenate(([0], np.cumsum(k))), np.concatenate(([0], np.cumsum(p * k)))
                below = np.searchsorted(p, theirs)
                value = theirs * (2 * upto_k[below] - upto_k[-1]) + upto_p[-1] - 2 * upto_p[below] - upto_k[-1] * np.abs(p0 - theirs)
                pairs = [(min(own, o), max(own, o), int(v) + (terms * abs(p0 - int(q)) if own < o else 0)) for o, v, q in zip(names, value, theirs, strict=True) if o != own]
                if pairs:
                    low, high, value = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"].as_py()] * len(low)), pa.array(low), pa.array(high), pa.nulls(len(low), pa.string()), pa.array(value, pa.int64())], schema=_PART_ARROW)

    return rows.transform(mapped, run, _PART)


def audit_sources(docs: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: how far each (lang, source) group is from the others, and the terms that mark it.

    Each lang keeps the terms in `least` of its documents or more. A group's frequency of a kept term is 1 + floor(10**9 * (n + 5) /
    (N + 5 * V)), V being the lang's kept terms and N the group's occurrences of all of them; a lang's is that of its documents.
    `pair`: each other source of the lang with the frequencies' absolute differences summed over the kept terms (0 without any), all
    ranks. `term`: terms that the group has and whose frequency is above the lang's, with the difference, the first `top`. Ranks go
    by value descending, then by item in UTF-8 order. Null texts, langs and sources are empty strings; ids aren't used, so repeated
    rows count as often as they come; other columns aren't looked at; an empty table gives no rows.

    Terms that two groups lack differ alike, so only terms that a group has are looked at: what depends on one group's frequencies and
    the other's p0 (the frequency of a term without occurrences) comes from the first group's histogram, and each shard of the terms
    adds what pairs that both hold a term change.
    """
    spark = docs.sparkSession
    kept = materialise(keep_terms(count_terms(docs, text, lang, source), least))
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    p0 = F.when(F.col("terms") > 0, per_billion(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups = materialise(groups.withColumn("p0", p0))
    n_groups = groups.count()
    rated = kept.join(groups, ["lang", "source"]).withColumn("p", per_billion(F.col("n"), F.col("total"), F.col("terms")))
    rated = rated.select("lang", "term", "source", "n", "p", "p0", "lang_total", "terms")
    shards = max(shuffle_partitions(spark), -(-kept.count() // SHARD_ROWS))
    parts = materialise(_sharded(rated.repartition(shards, "lang", "term"), _shard_parts(top), _PART, _PART_ARROW))
    hist = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    pairs = parts.where("other is not null").unionByName(_alone(groups, hist, n_groups)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source").alias("of"), F.col("other").alias("item")), F.struct(F.col("other").alias("of"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", sides.alias("_s"), "value").select("lang", F.col("_s.of").alias("source"), F.lit("pair").alias("part"), F.col("_s.item").alias("item"), "value")
    terms = parts.where("other is null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in 30 documents of a lang, the first 50 terms of each source."""
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY 1, 2, 3),
c AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""
