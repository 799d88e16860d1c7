"""Registered queries over archives and images that are made from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalogue import register, table
from foliospark.plans import pipelines
from foliospark.sources import archives as ar
from foliospark.sources import images as im
from foliospark.sources import texts
from foliospark.sources.models import TableAdapter


def _archives(spark, sf_dir: str) -> DataFrame:
    """A document archive of each text, with one paragraph a line and three media entries of given sizes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                media = [(f"word/media/image{k}.{e}", bytes(doc_id % 50 * k)) for k, e in ((1, "png"), (2, "JPG"), (10, "svg"))]
                rows.append((f"doc{doc_id}.docx", ar.docx_of_lines((text or "").split("\n"), media)))
            yield pd.DataFrame(rows, columns=["doc_path", "archive"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(make, "doc_path string, archive binary")


def _labelled(spark, sf_dir: str) -> DataFrame:
    """Paths of the documents that have labels."""
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("doc_path")).distinct()


@register(r"""
SELECT 'doc' || doc_id || '.docx' AS doc_path, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text, NULL::VARCHAR AS error FROM documents""")
def docx_text(spark, sf_dir):
    return ar.extract_text(_archives(spark, sf_dir))


@register("""
SELECT 'doc' || doc_id || '.docx' AS doc_path, 'image' || k || '.' || e AS original_name, (doc_id % 50 * k)::BIGINT AS size, lower(e) AS format, doc_id % 50 * k >= 100 AS kept
FROM documents, (VALUES (1, 'png'), (2, 'JPG'), (10, 'svg')) v(k, e)""")
def archive_entries(spark, sf_dir):
    return ar.list_entries(_archives(spark, sf_dir), 100).select("doc_path", "original_name", "size", "format", "kept")


@register("""
SELECT 'doc' || doc_id || '.docx' AS doc_path, 'image2.JPG' AS original_name, (doc_id % 50 * 2)::BIGINT AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def entries_from_list(spark, sf_dir):
    docs = _archives(spark, sf_dir)
    wanted = _labelled(spark, sf_dir).withColumn("path_in_zip", F.lit("word/media/image2.JPG"))
    return ar.entries_from_list(docs, wanted).select("doc_path", "original_name", "size")


@register("""
SELECT 'doc' || doc_id || '.docx' AS doc_path, 'image' || k || '.' || e AS original_name, CASE WHEN k = 2 AND doc_id IN (SELECT doc_id FROM labels) THEN 7 ELSE doc_id % 50 * k END::BIGINT AS size
FROM documents, (VALUES (1, 'png'), (2, 'JPG'), (10, 'svg')) v(k, e)""")
def rebuilt_archives(spark, sf_dir):
    docs = _archives(spark, sf_dir)
    new = _labelled(spark, sf_dir).withColumns({"path_in_zip": F.lit("word/media/image2.JPG"), "new_content": F.lit(b"changed")})
    return ar.list_entries(ar.rebuild_archives(docs, new, keep=True), with_content=False).select("doc_path", "original_name", "size")


@register(r"""
WITH l AS (SELECT doc_id, doc_id % 7 AS k, CASE doc_id % 7 WHEN 0 THEN '# note, a' WHEN 1 THEN '   ' ELSE ' ' || lang || ' , ' || source || ',' END AS value FROM documents)
SELECT trim(x) AS item, count(*) AS n FROM (SELECT unnest(string_split(value, ',')) AS x FROM l WHERE trim(value) <> '' AND left(trim(value), 1) <> '#') WHERE trim(x) <> '' GROUP BY 1""")
def item_lines(spark, sf_dir):
    k = F.col("doc_id") % 7
    value = F.when(k == 0, "# note, a").when(k == 1, "   ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" , "), "source", F.lit(",")))
    return texts.items_of_lines(table(spark, sf_dir, "documents").select(value.alias("value"))).groupBy("item").agg(F.count("*").alias("n"))


@register("""
SELECT 'KEY' || (doc_id % 20) AS key, arg_max(lang || '=' || doc_id, doc_id) AS value FROM documents WHERE doc_id % 3 > 0 GROUP BY 1""")
def setting_lines(spark, sf_dir):
    line = F.when(F.col("doc_id") % 3 == 0, "# KEY=none").otherwise(F.concat(F.lit(" key"), (F.col("doc_id") % 20).cast("string"), F.lit(" = "), "lang", F.lit("="), F.col("doc_id").cast("string")))
    return texts.settings_of_lines(table(spark, sf_dir, "documents").select(line.alias("value"), F.col("doc_id").alias("line_no")))


def _pictures(spark, sf_dir: str) -> DataFrame:
    """A PNG for each part: coloured columns by size, grey others; every tenth can't be decoded."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, size in zip(batch["p_partkey"], batch["p_size"], strict=True):
                pixels = np.full((10, 100, 3), 120, np.uint8)
                pixels[:, : int(size) % 12, 1:] = 0
                rows.append((int(key), int(size), f"p{key}.png", b"broken" if key % 10 == 0 else im.png_bytes(pixels)))
            yield pd.DataFrame(rows, columns=["p_partkey", "p_size", "path", "content"])

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # rows are small, pictures aren't
    return parts.mapInPandas(make, "p_partkey bigint, p_size int, path string, content binary")


@register("""
SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN (p_size % 12) / 100 END AS ratio, p_partkey % 10 > 0 AND p_size % 12 >= 5 AS coloured, p_partkey % 10 = 0 AS undecodable FROM part""")
def image_saturation(spark, sf_dir):
    return im.measure_images(_pictures(spark, sf_dir)).select("p_partkey", "ratio", "coloured", F.col("error").isNotNull().alias("undecodable"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN 50 END AS width, CASE WHEN p_partkey % 10 > 0 THEN 20 END AS height FROM part")
def resized_images(spark, sf_dir):
    small = F.lit(im.png_bytes(np.zeros((20, 50, 3), np.uint8)))
    done = im.resize_to_match(_pictures(spark, sf_dir).withColumn("small", small), "small", "content")
    return im.measure_images(done.select("p_partkey", "resized"), "resized").select("p_partkey", "width", "height")


@register("""
SELECT CASE WHEN p_partkey % 10 > 0 AND p_size % 12 >= 5 THEN 'local' WHEN p_size % 4 = 0 THEN 'triage' WHEN p_size % 4 = 1 THEN 'fail_open' ELSE 'approved' END AS stage, count(*) AS n FROM part GROUP BY 1""")
def image_cascade(spark, sf_dir):
    """Pictures through the saturation rule and a table of replies."""
    items = _pictures(spark, sf_dir).withColumn("format", F.lit("png"))
    items = items.withColumn("content", F.concat("content", F.col("p_partkey").cast("string").cast("binary"))).withColumnRenamed("p_partkey", "image_key")
    reply = F.when(F.col("p_size") % 4 == 0, '{\\"should_colorize\\": false, \\"reason\\": \\"text\\"}').otherwise('{\\"should_colorize\\": true}')
    answers = items.select(pipelines.request_key("triage", F.col("content")).alias("key"), F.when(F.col("p_size") % 4 == 1, 429).otherwise(200).alias("status"), F.concat(F.lit('{"choices": [{"message": {"content": "'), reply, F.lit('"}}]}')).alias("body"))
    return pipelines.judge_images(items, TableAdapter(answers)).groupBy("stage").agg(F.count("*").alias("n"))


@register("""
WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM documents),
n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS n FROM l)
SELECT 'doc' || doc_id || '.docx' AS doc_path, CASE WHEN n % 4 > 1 THEN NULL ELSE lpad((n % 28 + 1)::VARCHAR, 2, '0') || '/03/26' END AS data, CASE n % 4 WHEN 2 THEN 'status 429' WHEN 3 THEN 'reply holds no rows' END AS error FROM n""")
def routine_pipeline(spark, sf_dir):
    """Documents' texts, a table of replies (one of four fails, one of four holds no rows; texts that documents share have one reply),
    rows and rejected documents."""
    docs = _archives(spark, sf_dir)
    said = ar.extract_text(docs).groupBy("text").agg(F.min(F.regexp_extract("doc_path", r"(\d+)", 1).cast("long")).alias("n"))
    k = F.col("n") % 4
    reply = F.when(k == 3, "none").otherwise(F.concat(F.lit('[{\\"data\\": \\"'), F.lpad((F.col("n") % 28 + 1).cast("string"), 2, "0"), F.lit('/03/26\\"}]')))
    body = F.concat(F.lit('{"choices": [{"message": {"content": "'), reply, F.lit('"}}]}'))
    answers = said.select(F.sha2("text", 256).alias("key"), F.when(k == 2, 429).otherwise(200).alias("status"), body.alias("body"))
    rows, rejected = pipelines.compile_routines(docs, TableAdapter(answers))
    return rows.select("doc_path", "data", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("doc_path", F.lit(None).cast("string").alias("data"), "error"))
