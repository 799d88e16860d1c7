"""Registered queries over pictures, folders, whole pipelines and printed pages that are made from the driver's small tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.catalogue import register, table
from foliospark.functions import text as tx
from foliospark.operators import layout
from foliospark.plans import pipelines, printing
from foliospark.sources import archives as ar
from foliospark.sources import images as im
from foliospark.sources import texts
from foliospark.sources.models import TableAdapter, TableFetcher
from foliospark.tables import materialise, shared_dir, write_files

JPEG_WIDTH, JPEG_HEIGHT = 160, 32


def jpeg_bytes(spark, coloured: int, width: int = JPEG_WIDTH, height: int = JPEG_HEIGHT) -> bytes:
    """A grey JPEG whose first columns are red, made by the JVM's ImageIO on the driver."""
    j = spark._jvm
    image = j.java.awt.image.BufferedImage(width, height, 1)
    g = image.createGraphics()
    for x, w, colour in ((0, width, (120, 120, 120)), (0, coloured, (200, 10, 10))):
        g.setColor(j.java.awt.Color(*colour))
        g.fillRect(x, 0, w, height)
    g.dispose()
    out = j.java.io.ByteArrayOutputStream()
    j.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def _jpegs(spark) -> DataFrame:
    """(k, content): k times 16 of the columns are red."""
    return spark.createDataFrame([(k, bytearray(jpeg_bytes(spark, 16 * k))) for k in range(4)], "k int, content binary")


@register(f"SELECT s_suppkey, {JPEG_WIDTH} AS width, {JPEG_HEIGHT} AS height, s_suppkey % 4 > 0 AS coloured, true AS decoded FROM supplier")
def jpeg_images(spark, sf_dir):
    """JPEG pictures take part in the saturation rule."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("k")).join(_jpegs(spark), "k")
    return im.measure_images(rows).select("s_suppkey", "width", "height", "coloured", F.col("error").isNull().alias("decoded"))


@register(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 50 ELSE {JPEG_WIDTH} END AS matched_w, CASE WHEN s_suppkey % 3 = 0 THEN 20 ELSE {JPEG_HEIGHT} END AS matched_h, CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE {JPEG_WIDTH} END AS capped_w, CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE {JPEG_HEIGHT} END AS capped_h FROM supplier""")
def jpeg_resized(spark, sf_dir):
    """JPEG answers resized to the original's size, and JPEG pictures capped for a small slot; equal or small enough ones stay."""
    small = F.lit(im.png_bytes(np.zeros((20, 50, 3), np.uint8)))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("k")).join(_jpegs(spark), "k")
    rows = materialise(rows.withColumn("original", F.when(F.col("s_suppkey") % 3 == 0, small).otherwise(F.col("content"))))
    matched = im.resize_to_match(rows, "original", "content", "matched")
    even = im.cap_resolution(matched.where("s_suppkey % 2 = 0"), "content", 100 / 300 * 25.4 + 0.01, 25.4, out="capped")
    odd = im.cap_resolution(matched.where("s_suppkey % 2 = 1"), "content", 25.4, 25.4, out="capped")
    both = even.unionByName(odd).withColumns({"m": im.header_size("matched"), "c": im.header_size("capped")})
    return both.select("s_suppkey", F.col("m.width").alias("matched_w"), F.col("m.height").alias("matched_h"), F.col("c.width").alias("capped_w"), F.col("c.height").alias("capped_h"))


def _drawn(spark, sf_dir: str, kind: str) -> DataFrame:
    """Pictures of nations. clear: of 20 columns, the first ones are red; of these every second row is clear where the key is even.
    large: 1000 by 600 pixels, red where a column's number leaves n_nationkey % 3 when divided by 2."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["n_nationkey"]:
                if kind == "clear":
                    pixels = np.full((20, 20, 4), 128, np.uint8)
                    pixels[:, : key % 8, 1:3] = 0
                    pixels[:, :, 3] = 255
                    if key % 2 == 0:
                        pixels[::2, : key % 8, 3] = 127
                else:
                    pixels = np.full((600, 1000, 3), 90, np.uint8)
                    pixels[:, np.arange(1000) % 2 == key % 3, 0] = 250
                rows.append((int(key), im.png_bytes(pixels)))
            yield pd.DataFrame(rows, columns=["n_nationkey", "content"])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")).mapInPandas(make, "n_nationkey bigint, content binary")


@register("""
SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey % 8 * 10) / (400 - n_nationkey % 8 * 10) ELSE (n_nationkey % 8) / 20 END::DOUBLE AS ratio FROM nation""")
def transparent_pixels(spark, sf_dir):
    """Pixels that are more than half clear don't count."""
    return im.measure_images(_drawn(spark, sf_dir, "clear")).select("n_nationkey", "ratio")


@register("""
SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END::DOUBLE AS ratio, n_nationkey % 3 = 0 AS coloured FROM nation""")
def sampled_pixels(spark, sf_dir):
    """600,000 pixels: every second column and row is looked at."""
    return im.measure_images(_drawn(spark, sf_dir, "large")).select("n_nationkey", "ratio", "coloured")


@register("""
SELECT 'p' || n_nationkey || CASE n_nationkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.webp' ELSE '.JPG' END AS name, length(n_name) AS size FROM nation WHERE n_nationkey % 5 < 4""")
def image_folder(spark, sf_dir):
    """Files written to a folder and its pictures read back; other files and those of sub-folders don't count."""
    folder = shared_dir(spark)
    k, key = F.col("n_nationkey") % 4, F.col("n_nationkey").cast("string")
    ending = F.when(F.col("n_nationkey") % 5 == 4, ".txt").when(k == 0, ".PNG").when(k == 1, ".jpeg").when(k == 2, ".webp").otherwise(".JPG")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key, ending).alias("name"), F.col("n_name").cast("binary").alias("content"))
    write_files(rows, folder)
    write_files(rows, f"{folder}/deeper")
    return im.read_images(spark, folder).select(tx.basename(F.col("path")).alias("name"), F.octet_length("content").cast("long").alias("size"))


@register("SELECT CASE WHEN n_nationkey % 4 = 1 THEN 'plan' || n_nationkey || '.DOCX' ELSE 'plan' || n_nationkey || '.docx' END AS name, n_name AS text FROM nation WHERE n_nationkey % 4 < 3")
def archive_folder(spark, sf_dir):
    """Documents of a folder without lock files and files of other kinds."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [f"{'~$' if k % 4 == 3 else ''}plan{k}.{'DOCX' if k % 4 == 1 else 'docx'}" for k in batch["n_nationkey"]]
            yield pd.DataFrame({"name": names, "content": [ar.docx_of_lines([x]) for x in batch["n_name"]]})
            yield pd.DataFrame({"name": [n + ".bak" for n in names], "content": [b"x"] * len(names)})

    folder = shared_dir(spark)
    write_files(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "name string, content binary"), folder)
    found = ar.extract_text(ar.read_archives(spark, folder))
    return found.select(tx.basename(F.col("doc_path")).alias("name"), "text")


def _answer(content: Column) -> Column:
    """A model's response with this text."""
    return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))


def _grey(key: int) -> bytes:
    pixels = np.full((10, 20, 3), key % 200, np.uint8)
    return im.png_bytes(pixels)


@register("""
SELECT 'd' || s_suppkey AS doc_path, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 4 END::BIGINT AS listed, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS skipped,
  CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 4 = 1 OR s_suppkey % 3 = 1 THEN 0 ELSE 1 END::BIGINT AS coloured, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS skipped_local, CASE WHEN s_suppkey % 10 > 0 AND s_suppkey % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS skipped_triage,
  s_suppkey % 10 = 0 AS unreadable, CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 4 = 1 OR s_suppkey % 3 = 1 THEN NULL ELSE 20 END AS new_width FROM supplier""")
def document_pipeline(spark, sf_dir):
    """Documents of a red PNG, a red JPEG, a grey PNG and one that is too small; one of ten archives is broken. The model rejects a
    quarter of the grey ones (and fails on another quarter, which lets them pass), colours those that pass as data or behind a URL, or,
    for a third, sends nothing usable."""
    red_jpeg, red_png = jpeg_bytes(spark, 64), im.png_bytes(np.full((9, 9, 3), (200, 0, 0), np.uint8))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["s_suppkey"]:
                grey = _grey(int(key)) + b"%d" % key
                whole = ar.write_archive([(ar.DOCUMENT, b"<w/>"), ("word/media/a.png", red_png), ("word/media/b.JPG", red_jpeg), ("word/media/c.png", grey), ("word/media/d.png", b"tiny")])
                rows.append((int(key), whole[:50] if key % 10 == 0 else whole, grey))
            yield pd.DataFrame(rows, columns=["key", "archive", "grey"])

    made = materialise(table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(make, "key bigint, archive binary, grey binary"))
    k = F.col("key")
    verdict = F.concat(F.lit('{"should_colorize": '), F.when(k % 4 == 1, "false").otherwise("true"), F.lit("}"))
    triage = made.select(pipelines.request_key("triage", F.col("grey")).alias("key"), F.when(k % 4 == 2, 500).otherwise(200).alias("status"), _answer(verdict).alias("body"))
    colourful = im.png_bytes(np.full((30, 30, 3), (10, 200, 10), np.uint8))
    data = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.lit(colourful)), r"\s", ""))
    url = F.concat(F.lit("https://x.example.com/"), k.cast("string"), F.lit(".jpg"))
    said = F.when(k % 3 == 0, data).when(k % 3 == 1, "sorry").otherwise(F.concat(F.lit("see "), url))
    colour = made.select(pipelines.request_key("colour", F.col("grey")).alias("key"), F.lit(200).alias("status"), _answer(said).alias("body"))
    files = made.select(url.alias("url"), F.lit(200).alias("status"), F.lit(jpeg_bytes(spark, 32, 48, 48)).alias("content"), F.lit("image/jpeg").alias("content_type"))
    docs = made.select(F.concat(F.lit("d"), k.cast("string")).alias("doc_path"), "archive")
    out = pipelines.process_documents(docs, TableAdapter(triage), TableAdapter(colour), "5B", fetch=TableFetcher(files))
    sizes = ar.list_entries(out.archives.where("archive is not null")).where("original_name = 'c.png'").select("doc_path", im.header_size("content")["width"].alias("new_width"))
    return out.summary.join(sizes, "doc_path", "left").select("doc_path", "listed", "skipped", "coloured", "skipped_local", "skipped_triage", F.col("error").isNotNull().alias("unreadable"), "new_width")


@register("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 OR s_suppkey % 12 = 4 THEN 'error' ELSE 'done' END AS status, CASE WHEN s_suppkey % 3 = 2 THEN NULL WHEN s_suppkey % 12 = 4 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'png' WHEN s_suppkey % 2 = 0 THEN 'webp' ELSE 'jpg' END AS format,
  CASE WHEN s_suppkey % 3 = 2 THEN 'no image in the reply' WHEN s_suppkey % 12 = 4 THEN 'download: status 404' END AS error FROM supplier""")
def url_answers(spark, sf_dir):
    """Pictures generated as data, behind URLs (one of four even ones can't be had) or not at all."""
    k = F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("draw "), k.cast("string")).alias("prompt"), F.lit("pending").alias("status"))
    png = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.lit(_grey(1) * 2)), r"\s", ""))
    url = F.concat(F.lit("http://x.example.com/image/"), k.cast("string"))
    answers = items.select(F.sha2(F.concat_ws("|", F.lit("1:1"), "prompt"), 256).alias("key"), F.lit(200).alias("status"), _answer(F.when(k % 3 == 0, png).when(k % 3 == 1, url).otherwise("no")).alias("body"))
    files = items.select(url.alias("url"), F.when(k % 12 == 4, 404).otherwise(200).alias("status"), F.lit(b"picture").alias("content"), F.when(k % 2 == 0, "image/webp").otherwise("image/jpeg; q=1").alias("content_type"))
    return pipelines.generate_images(items, TableAdapter(answers), fetch=TableFetcher(files)).select("s_suppkey", "status", "format", "error")


@register("""
SELECT n_regionkey, 'Data' || chr(10) || 'Campo' || chr(10) || 'Experiência' || chr(10) || string_agg(lpad((n_nationkey % 5 + 1)::VARCHAR, 2, '0') || '/03/26' || chr(10) || n_name || chr(10) || 'n' || n_nationkey, chr(10) ORDER BY n_nationkey % 5, n_nationkey::VARCHAR) AS text FROM nation GROUP BY 1""")
def report_documents(spark, sf_dir):
    """One report for each region, its rows by date; read back as text."""
    key = F.col("n_nationkey").cast("string")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lpad((F.col("n_nationkey") % 5 + 1).cast("string"), 2, "0"), F.lit("/03/26")).alias("data"), F.col("n_name").alias("campo"), F.concat(F.lit("n"), key).alias("experiencia"), key.alias("doc_path"), F.lit(0).alias("seq"))
    made = pipelines.reports(rows, "n_regionkey").select(F.col("n_regionkey").cast("string").alias("doc_path"), "archive")
    return ar.extract_text(made).select(F.col("doc_path").cast("int").alias("n_regionkey"), "text")


@register("""
WITH d AS (SELECT s_suppkey AS k, 'img' || s_suppkey || '.png' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 2000 ELSE 500 END::DOUBLE AS w, 1000::DOUBLE AS h, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
o AS (SELECT *, ((rn - 1) // 2)::INT AS pair, ((rn - 1) % 2)::INT AS side FROM d UNION ALL SELECT *, ((rn - 1) // 2)::INT, 1 FROM d WHERE rn % 2 = 1 AND rn = (SELECT count(*) FROM d))
SELECT pair, side, path, k % 2 = 0 AS rotated, 100::DOUBLE AS draw_w, 200::DOUBLE AS draw_h FROM o""")
def two_up_layout(spark, sf_dir):
    """Two pictures a page in natural order of names; wide ones are turned."""
    k = F.col("s_suppkey")
    pictures = table(spark, sf_dir, "supplier").select(F.concat(F.lit("img"), k.cast("string"), F.lit(".png")).alias("path"), F.when(k % 2 == 0, 2000).otherwise(500).alias("width"), F.lit(1000).alias("height"))
    placed = pipelines.lay_out_two_up(pictures)
    return placed.select("pair", "side", "path", "rotated", F.round("draw_w", 6).alias("draw_w"), F.round("draw_h", 6).alias("draw_h"))


def _cells(spark, sf_dir: str) -> DataFrame:
    """Card cells of each region's nations, two by two."""
    items = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("1_"), F.lower("n_name"), F.lit(".png")).alias("path"))
    numbered = layout.number_rows(items, ["n_nationkey"], ["n_regionkey"])
    return layout.card_cells(numbered, columns=2, rows=2).withColumn("label", tx.upper_label(tx.card_label(F.col("path"))))


@register("""
WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n_regionkey, (i // 4)::INT AS page, '<section style="grid-template-columns:repeat(2,1fr)"><h1>A &amp; B</h1>' || string_agg('<figure><figcaption>' || replace(upper(n_name), '_', ' ') || '</figcaption></figure>', '' ORDER BY i) || '</section>' AS html FROM n GROUP BY 1, 2""")
def cards_html_pages(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("data_uri", F.lit(None).cast("string"))
    return pipelines.cards_html(cells, "A & B", 2, ["n_regionkey"])


@register("""
WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n_regionkey, count(DISTINCT i // 4)::INT AS pages, (count(*) FILTER (n_nationkey % 3 > 0))::INT AS pictures, (count(*) FILTER (n_nationkey % 3 = 1))::INT AS jpegs, count(*)::INT AS labels FROM n GROUP BY 1""")
def printed_cards(spark, sf_dir):
    """Card sheets as PDF: one of three cards has no picture that can be decoded, JPEG goes in as it is."""
    cells = _cells(spark, sf_dir)
    k = F.col("n_nationkey") % 3
    cells = cells.withColumn("content", F.when(k == 1, F.lit(jpeg_bytes(spark, 16))).when(k == 2, F.lit(_grey(7))).otherwise(F.lit(b"none")))
    return _counted(printing.cards_pdf(cells, ["n_regionkey"]), "n_regionkey")


def _counted(books: DataFrame, key: str) -> DataFrame:
    text = F.decode("pdf", "ISO-8859-1")
    return books.select(key, F.regexp_count(text, F.lit("/Type/Page/")).alias("pages"), F.regexp_count(text, F.lit("/Subtype/Image")).alias("pictures"), F.regexp_count(text, F.lit("/DCTDecode")).alias("jpegs"), F.regexp_count(text, F.lit(r"\) Tj ET")).alias("labels"))


@register("""
WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT n_regionkey, ((n + 1) // 2)::INT AS pages, ((n + 1) // 2 * 2)::INT AS pictures, ((n + 1) // 2 * 2)::INT AS jpegs, 0 AS labels FROM n""")
def printed_pairs(spark, sf_dir):
    """Two-up pages as PDF, one file for each region; an odd last picture stands twice."""
    numbered = layout.number_rows(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ["n_nationkey"], ["n_regionkey"])
    pairs = layout.pair_two_up(numbered, "n_nationkey", partition=["n_regionkey"])
    sides = pairs.select("n_regionkey", "pair", F.posexplode(F.array("left", "right")).alias("side", "n_nationkey"))
    sized = sides.withColumns({"width": F.lit(float(JPEG_WIDTH)), "height": F.lit(float(JPEG_HEIGHT)), "content": F.lit(jpeg_bytes(spark, 16))})
    return _counted(printing.two_up_pdf(layout.place_in_slot(sized, "width", "height"), ["n_regionkey"]), "n_regionkey")
