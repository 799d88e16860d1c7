"""Registered queries over files that are written from the driver's tables and read back by ranges, numbered groups, streams and trees."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalogue import register, table
from foliospark.functions import text as tx
from foliospark.operators import layout, relational
from foliospark.operators import search as indexed
from foliospark.plans import pipelines, printing
from foliospark.sources import archives as ar
from foliospark.sources import files, texts
from foliospark.sources import images as im
from foliospark.streaming import cascade, progress
from foliospark.tables import number_groups, shared_dir


def _mixed_archives(spark, sf_dir: str) -> DataFrame:
    """An archive of each text: the text stored, a name that comes twice, and a media entry."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, data, method in (("text.txt", (text or "").encode(), 0), ("word/media/image1.png", b"a" * (doc_id % 7), 8), ("twice.bin", b"1", 8), ("word/media/image2.png", b"b" * 100, 0)):
                        z.writestr(zipfile.ZipInfo(name), data, method)
                    second = zipfile.ZipInfo("twice.bin")
                    z.NameToInfo.pop("twice.bin")  # no warning: the second is meant
                    z.writestr(second, b"22", 0)
                rows.append((f"doc{doc_id}.docx", out.getvalue()))
            yield pd.DataFrame(rows, columns=["doc_path", "archive"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(make, "doc_path string, archive binary")


@register("""
SELECT 'doc' || doc_id || '.docx' AS name, e AS path_in_zip, CASE e WHEN 'word/media/image1.png' THEN doc_id % 7 ELSE 100 END::BIGINT AS size, CASE WHEN e = 'word/media/image1.png' THEN repeat('a', (doc_id % 7)::INT) ELSE repeat('b', 100) END AS content, true AS in_part
FROM documents, (VALUES ('word/media/image1.png'), ('word/media/image2.png')) v(e) WHERE (e = 'word/media/image2.png' OR doc_id % 7 >= 3)""")
def ranged_entries(spark, sf_dir):
    """Archives written as files by the committed sink; media entries of three bytes or more read by ranges, a part of each file."""
    folder = shared_dir(spark)
    files.write_folder(_mixed_archives(spark, sf_dir), folder, "doc_path", "archive")
    found = files.read_entries(spark, folder).where(F.col("path_in_zip").startswith("word/media/") & (F.col("size") >= 3))
    return found.select(tx.basename(F.col("doc_path")).alias("name"), "path_in_zip", "size", F.col("content").cast("string").alias("content"), (F.col("bytes_read") < F.col("doc_size")).alias("in_part"))


@register("""
SELECT 'doc' || doc_id || '.docx' AS name, i AS entry_idx, n AS path_in_zip, CASE i WHEN 0 THEN strlen(coalesce(text, '')) WHEN 1 THEN doc_id % 7 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 7 ELSE 100 END ELSE 2 END::BIGINT AS size,
  CASE i WHEN 2 THEN '1' WHEN 4 THEN '22' WHEN 3 THEN CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'changed' END END AS short
FROM documents, (VALUES (0, 'text.txt'), (1, 'word/media/image1.png'), (2, 'twice.bin'), (3, 'word/media/image2.png'), (4, 'twice.bin')) v(i, n)""")
def rebuilt_entries(spark, sf_dir):
    """Archives with one entry replaced where the document has a label; entries of one name keep what each holds."""
    docs = _mixed_archives(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.format_string("doc%d.docx", "doc_id").alias("doc_path")).distinct()
    new = labelled.withColumns({"path_in_zip": F.lit("word/media/image2.png"), "new_content": F.lit(b"changed")})
    entries = ar.list_entries(ar.rebuild_archives(docs, new, keep=True), prefix="")
    return entries.select(F.col("doc_path").alias("name"), "entry_idx", "path_in_zip", "size", F.when(F.octet_length("content").isin(1, 2, 7) & ~F.col("path_in_zip").isin("text.txt", "word/media/image1.png"), F.col("content").cast("string")).alias("short"))


@register("""
SELECT lang AS folder, doc_id || '.txt' AS name, sha256(text) AS digest FROM documents WHERE text IS NOT NULL""")
def committed_folder(spark, sf_dir):
    """Every text as a file in its language's sub-folder, and the folder read back."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    files.write_folder(docs, folder)
    found = files.read_folder(spark, folder)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), tx.basename(F.col("path")).alias("name"), F.sha2("content", 256).alias("digest"))


@register("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.png' ELSE '.jpg' END END AS file, CASE WHEN s_suppkey % 3 > 0 THEN strlen(s_name) END::BIGINT AS size FROM supplier""")
def generated_files(spark, sf_dir):
    """Generated items whose pictures are done go to a folder; the others keep no path."""
    key = F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), key).alias("slug"), F.when(key % 3 > 0, pipelines.DONE).otherwise(pipelines.ERROR).alias("status"), F.when(key % 2 == 0, "png").otherwise("jpg").alias("format"), F.col("s_name").cast("binary").alias("content"))
    folder = shared_dir(spark)
    saved = pipelines.save_generated(items, folder).select("s_suppkey", tx.basename(F.col("path")).alias("file"))
    found = spark.read.format("binaryFile").load(folder).select(tx.basename(F.col("path")).alias("file"), F.octet_length("content").cast("long").alias("size"))
    return saved.join(found, "file", "left").select("s_suppkey", "file", "size")


@register("""
SELECT p_partkey, trim(x) AS item FROM (SELECT p_partkey, unnest(string_split(' ' || p_brand || ' , #' || p_size || ',, ' || p_type, ',')) AS x FROM part) WHERE trim(x) <> ''""")
def item_args(spark, sf_dir):
    """A table of arguments split at commas; no line is a comment here."""
    args = F.concat(F.lit(" "), "p_brand", F.lit(" , #"), F.col("p_size"), F.lit(",, "), "p_type")
    return texts.items_of_arg_rows(table(spark, sf_dir, "part").select("p_partkey", args.alias("value")))


@register("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem""")
def group_numbers(spark, sf_dir):
    """Numbers inside three groups that hold the whole table, without a task that holds a group."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return number_groups(items, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rn")


@register("""
WITH i AS (SELECT p_brand, p_name || '_' || p_partkey || '.png' AS path, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, (k // 2)::BIGINT AS pair, count(*) + max(CASE WHEN k = n - 1 AND n % 2 = 1 THEN 1 ELSE 0 END) AS sides, min(p_size)::BIGINT AS least FROM i GROUP BY 1, 2""")
def books_of_pairs(spark, sf_dir):
    """Two-up pages of a book for each brand, in the natural order of their names; an odd last one stands twice."""
    images = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("i"), F.col("p_partkey"), F.lit(".png")).alias("path"), F.col("p_size").alias("width"), F.lit(10).alias("height"), "p_size")
    placed = pipelines.lay_out_two_up(images.drop("p_size"), by=["p_brand"])
    sizes = images.select("path", "p_size")
    return placed.join(sizes, "path").groupBy("p_brand", F.col("pair").cast("long").alias("pair")).agg(F.count("*").alias("sides"), F.min("p_size").cast("long").alias("least"))


@register("""
SELECT event_id, count(*) OVER w AS completed, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w ::BIGINT AS success, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w ::BIGINT AS failed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def streamed_progress(spark, sf_dir):
    """The events in three instalments by time, each taken up by the stream where it had stopped; the same counts as running_progress."""
    folder = shared_dir(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    cuts = [None, *events.select(F.percentile_approx("ts", [0.3, 0.7])).first()[0], None]
    kind = F.col("event_type")
    before = {k: spark.conf.get(k, None) for k in progress.STATE_STORE}
    for k, v in progress.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = events.where((F.lit(True) if low is None else F.col("ts") >= F.lit(low)) & (F.lit(True) if high is None else F.col("ts") < F.lit(high)))
            part.write.mode("append").parquet(f"{folder}/in")
            stream = cascade.stream_table(spark, f"{folder}/in", events.schema, files_per_trigger=1 << 30)
            counted = progress.stream_progress(stream, "user_id", ["ts", "event_id"], kind == "purchase", kind == "error")
            counted.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/out").select("event_id", "completed", "success", "failed")


@register(r"""
WITH RECURSIVE p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS steps FROM pages),
n AS (SELECT DISTINCT unnest(list_transform(range(1, len(steps) + 1), lambda i: array_to_string(steps[:i], '/'))) AS node FROM p),
h AS (SELECT node, regexp_replace(node, '/[^/]*$', '') AS parent, ends_with(node, '5') OR starts_with(node, 'spam') AS hidden FROM n),
v AS (SELECT node FROM h WHERE NOT contains(node, '/') AND NOT hidden UNION ALL SELECT h.node FROM v JOIN h ON h.parent = v.node AND h.node <> v.node WHERE NOT h.hidden)
SELECT page_id, array_to_string(steps, '/') IN (SELECT node FROM v) AS visible FROM p""")
def visible_pages(spark, sf_dir):
    """Pages of which no step of the path from their host on is hidden (it ends in 5, or the host begins with spam)."""
    steps = F.split(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/")
    pages = table(spark, sf_dir, "pages").select("page_id", steps.alias("steps"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.array_join(F.slice("steps", 1, i), "/"))
    nodes = pages.select(F.explode(prefixes).alias("node")).distinct()
    nodes = nodes.select("node", F.when(F.col("node").contains("/"), F.regexp_replace("node", "/[^/]*$", "")).alias("parent"), (F.endswith("node", F.lit("5")) | F.startswith("node", F.lit("spam"))).alias("hidden"))
    shown = relational.visible_nodes(nodes, "node", "parent", ~F.col("hidden")).withColumn("_shown", F.lit(True))
    joined = pages.join(shown, F.array_join("steps", "/") == F.col("node"), "left")
    return joined.select("page_id", F.coalesce("_shown", F.lit(False)).alias("visible"))


def _drawn_at(books: DataFrame, key: str, pattern: str) -> DataFrame:
    """key and the groups of each place where an uncompressed content stream of a book has the pattern."""
    found = F.regexp_extract_all(F.decode("pdf", "ISO-8859-1"), F.lit(pattern), 0)
    return books.select(key, F.posexplode(found).alias("n", "_m"))


@register(r"""
WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
t AS (SELECT DISTINCT p_brand, i // 6 AS page, 'Pág. ' || (i // 6 + 1) || ' / ' || ((n + 5) // 6) AS text, 'page' AS kind FROM n),
l AS (SELECT p_brand, i // 6 AS page, 'K' || p_partkey AS text, 'label' AS kind FROM n)
SELECT p_brand, kind, text, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM l UNION ALL SELECT p_brand, page, 'Sheet (' || p_brand || ')', 'title' FROM (SELECT DISTINCT p_brand, page FROM t)) GROUP BY ALL""")
def sheet_texts(spark, sf_dir):
    """Card sheets of each brand written as files page by page; titles, page labels and card labels read back from them. All books have
    one title; its word TITLE becomes the brand afterwards."""
    items = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("k"), F.col("p_partkey"), F.lit(".png")).alias("path"))
    cells = pipelines.lay_out_cards(items, by=["p_brand"]).withColumn("content", F.lit(None).cast("binary"))
    folder = shared_dir(spark)
    printing.write_documents(printing.card_sheets(cells, ["p_brand"], title="Sheet (TITLE)"), ["p_brand"], folder, F.concat("p_brand", F.lit(".pdf")))
    books = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)\.pdf$", 1).alias("p_brand"), F.col("content").alias("pdf"))
    books = books.withColumn("p_brand", F.url_decode("p_brand"))
    drawn = _drawn_at(books, "p_brand", r"BT /F[12] [0-9.]+ Tf [0-9. ]+ rg [0-9. ]+ Td \((?:[^()\\]|\\.)*\) Tj\sET")
    text = F.regexp_replace(F.regexp_extract("_m", r"Td \((.*)\) Tj", 1), r"\\([()\\])", "$1")
    kind = F.when(F.col("_m").startswith("BT /F2"), "page").when(F.col("_m").contains(" Tj\n"), "title").otherwise("label")
    return drawn.select("p_brand", kind.alias("kind"), F.replace(text, F.lit("TITLE"), F.col("p_brand")).alias("text")).groupBy("p_brand", "kind", "text").agg(F.count("*").alias("n"))


@register(r"""
WITH d AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 400 ELSE 100 END AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier),
o AS (SELECT *, i % 2 AS side FROM d UNION ALL SELECT *, 1 FROM d WHERE i = c - 1 AND c % 2 = 1),
p AS (SELECT *, 100.0::DOUBLE AS dw, 200.0::DOUBLE AS dh FROM o)
SELECT s_nationkey, i // 2 AS page, side, w = 400 AS rotated, round((side * 148.5 + 5 + (138.5 - dw) / 2) * 72 / 25.4, 1) AS x, round(5 * 72 / 25.4, 1) AS y, round(dw * 72 / 25.4, 1) AS seen_w, round(dh * 72 / 25.4, 1) AS seen_h,
  floor(w * least(floor(dw / 25.4 * 20) / w, floor(dh / 25.4 * 20) / 200) + 1e-9)::BIGINT AS pixels_w
FROM p""")
def pair_places(spark, sf_dir):
    """Two-up books of each nation at 20 points an inch: where pictures stand, how large, turned or not, and with how many pixels."""
    k = F.col("s_suppkey")
    wide, tall = (F.lit(im.png_bytes(np.full((200, w, 3), 90, np.uint8))) for w in (400, 100))
    images = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("i"), k, F.lit(".png")).alias("path"), F.when(k % 2 == 0, 400).otherwise(100).alias("width"), F.lit(200).alias("height"))
    options = layout.TwoUpOptions(max_dpi=20)
    placed = pipelines.lay_out_two_up(images, options, by=["s_nationkey"]).withColumn("content", F.when(F.col("width") == 400, wide).otherwise(tall))
    books = printing.two_up_pdf(placed, ["s_nationkey"], options)
    number = r"(-?[0-9.]+)"
    drawn = _drawn_at(books, "s_nationkey", rf"q {number} {number} {number} {number} {number} {number} cm /I(\d+) Do Q")
    of = lambda i, t="double": F.regexp_extract("_m", rf"q {number} {number} {number} {number} {number} {number} cm /I(\d+) Do", i).cast(t)
    turned = of(1) == 0
    drawn = drawn.select("s_nationkey", turned.alias("rotated"), F.when(turned, -of(3)).otherwise(of(1)).alias("seen_w"), F.when(turned, of(2)).otherwise(of(4)).alias("seen_h"), F.when(turned, of(5) + of(3)).otherwise(of(5)).alias("x"), of(6).alias("y"), of(7, "int").alias("object"))
    sizes = _drawn_at(books, "s_nationkey", r"(\d+) 0 obj\n<</Type/XObject/Subtype/Image/Width (\d+)").select("s_nationkey", F.regexp_extract("_m", r"^(\d+)", 1).cast("int").alias("object"), F.regexp_extract("_m", r"Width (\d+)", 1).cast("long").alias("pixels_w"))
    both = drawn.join(sizes, ["s_nationkey", "object"])
    place = F.col("object") - printing.FIRST_ID  # a page has four objects: itself, its content, two pictures
    rounded = [F.round(c, 1).alias(c) for c in ("x", "y", "seen_w", "seen_h")]
    return both.select("s_nationkey", F.floor(place / 4).alias("page"), (place % 4 - 2).cast("long").alias("side"), "rotated", *rounded, "pixels_w")


@register("SELECT doc_id, n_chars FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'src1 the')")
def indexed_search(spark, sf_dir):
    """The rows that search() finds, by an index of the documents' trigrams."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    indexed.write_index(docs, folder, "doc_id", "lang", "source", "text")
    return indexed.search_indexed(docs, folder, "doc_id", " SRC1 The ", "lang", "source", "text").select("doc_id", "n_chars")
