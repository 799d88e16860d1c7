"""The registered queries over the driver's tables, with DuckDB SQL for each that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark import tables
from foliospark.functions import structured as st
from foliospark.functions import text as tx
from foliospark.operators import cascade, layout, relational

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from foliospark import files_catalogue, pictures_catalogue, sources_catalogue  # noqa: F401  add their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from foliospark import files_catalogue, pictures_catalogue, sources_catalogue  # noqa: F401

    return dict(_SQL)


# --- cascade, filters -------------------------------------------------------------------------------------------------------------


@register("""
SELECT CASE WHEN n_chars < 200 THEN 'local' WHEN l.doc_id IS NULL THEN 'fail_open' WHEN quality = 0 OR toxic = 1 THEN 'triage' ELSE 'approved' END AS stage, count(*) AS n
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def triage_cascade(spark, sf_dir):
    """Short texts stop at the local rule, labels play the model, a missing label is a model error and lets pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")

    def ask(rows: DataFrame) -> DataFrame:
        judged = rows.select("doc_id").join(labels.withColumn("_known", F.lit(True)), "doc_id", "left")
        good = (F.col("quality") != 0) & (F.col("toxic") != 1)
        return judged.select("doc_id", good.alias("should_colorize"), F.lit("").alias("reason"), F.when(F.col("_known").isNull(), "no label").alias("error"))

    return cascade.summary(cascade.run_cascade(docs, F.col("n_chars") < 200, F.lit(None).cast("string"), ask, "doc_id"))


@register("SELECT count(*) AS total, count(*) FILTER (n_chars >= 1024) AS kept, count(*) FILTER (n_chars < 1024) AS skipped, sum(n_chars) FILTER (n_chars >= 1024)::BIGINT AS kept_chars FROM documents")
def split_by_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    kept, skipped = relational.split_by_size(docs, "n_chars", 1024)
    both = kept.withColumn("_k", F.lit(True)).unionByName(skipped.withColumn("_k", F.lit(False)))
    return both.agg(F.count("*").alias("total"), F.count_if("_k").alias("kept"), F.count_if(~F.col("_k")).alias("skipped"), F.sum(F.when(F.col("_k"), F.col("n_chars"))).alias("kept_chars"))


@register("SELECT doc_id, n_chars FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'loser')")
def search_documents(spark, sf_dir):
    return relational.search(table(spark, sf_dir, "documents"), "  LOSER ", "lang", "source", "text").select("doc_id", "n_chars")


@register("""
SELECT o_orderkey, r, r IN ('1:1','2:3','3:2','3:4','4:3','4:5','5:4','9:16','16:9','21:9','auto') AS valid, (o_custkey % 8) BETWEEN 1 AND 6 AS grid_ok
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '16:9' WHEN 1 THEN '7:5' WHEN 2 THEN 'auto' ELSE 'AUTO' END AS r FROM orders)""")
def validate_options(spark, sf_dir):
    from foliospark.plans.options import ASPECTS

    k = F.col("o_orderkey") % 4
    ratio = F.when(k == 0, "16:9").when(k == 1, "7:5").when(k == 2, "auto").otherwise("AUTO")
    return table(spark, sf_dir, "orders").select("o_orderkey", ratio.alias("r"), ratio.isin(*ASPECTS).alias("valid"), (F.col("o_custkey") % 8).between(1, 6).alias("grid_ok"))


# --- strings ----------------------------------------------------------------------------------------------------------------------


@register(r"""
SELECT doc_id, 'imagens ' || CASE WHEN s = '' THEN 'doc' ELSE s END AS folder FROM (
  SELECT doc_id, trim(left(trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_extract(text, '([^/\\]*)$', 1), '\.[^.]*$', ''))), '[^a-z0-9]+', ' ', 'g')), 45)) AS s FROM documents)""")
def sanitize_folder(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.folder_name(F.col("text")).alias("folder"))


@register(r"""
SELECT doc_id, CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id || '_' || CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (
  SELECT doc_id, regexp_replace(replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), ' ', '_'), '[^\p{L}\p{N}_]', '', 'g') AS s FROM documents)""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug(F.col("doc_id"), F.col("text")).alias("slug"))


@register(r"""
WITH p AS (SELECT p_partkey, lpad(p_size::VARCHAR, 2, '0') || '_' || replace(p_name, ' ', '-') || '''s_USA.PNG' AS f FROM part),
q AS (SELECT p_partkey, f, trim(translate(regexp_replace(regexp_replace(f, '\.[^.]*$', ''), '^\d+[_\s-]+', ''), '_-', '  ')) AS s FROM p)
SELECT p_partkey, f AS file, array_to_string(list_transform(regexp_extract_all(s, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS label FROM q""")
def card_labels(spark, sf_dir):
    name = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("'s_USA.PNG"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("file"), tx.card_label(name).alias("label"))


@register(r"""
SELECT p_partkey, trim(regexp_replace(trim(p_name || CASE p_partkey % 4 WHEN 0 THEN '_2up_2UP' WHEN 1 THEN ' _2up ' WHEN 2 THEN '' ELSE '_2upx' END), '(?i)(\s*_2up)+$', '')) AS title FROM part""")
def strip_two_up(spark, sf_dir):
    k = F.col("p_partkey") % 4
    suffix = F.when(k == 0, "_2up_2UP").when(k == 1, " _2up ").when(k == 2, "").otherwise("_2upx")
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_two_up(F.concat("p_name", suffix)).alias("title"))


@register(r"""
WITH e AS (SELECT doc_id, doc_id % 200 AS ord, text || ' – n' || doc_id AS path FROM documents),
w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN path WHEN doc_id % 3 = 1 THEN '  ' || lower(replace(strip_accents(path), '–', '-')) ELSE path || '?' END AS want FROM e),
k AS (SELECT trim(regexp_replace(lower(strip_accents(translate(path, '–—ºª', '--oa'))), '\s+', ' ', 'g')) AS key, arg_min(path, ord) AS fuzzy FROM e GROUP BY 1)
SELECT w.doc_id, md5(want) AS path, md5(coalesce(x.path, fuzzy)) AS resolved FROM w LEFT JOIN (SELECT DISTINCT path FROM e) x ON x.path = want
LEFT JOIN k ON k.key = trim(regexp_replace(lower(strip_accents(translate(want, '–—ºª', '--oa'))), '\s+', ' ', 'g'))""")
def resolve_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    existing = docs.select("doc_id", (F.col("doc_id") % 200).alias("ord"), F.concat("text", F.lit(" – n"), F.col("doc_id").cast("string")).alias("path"))
    k = F.col("doc_id") % 3
    want = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("  "), F.lower(F.replace(tx.strip_accents(F.col("path")), F.lit("–"), F.lit("-"))))).otherwise(F.concat("path", F.lit("?")))
    found = relational.resolve_paths(existing.select("doc_id", want.alias("path")), existing)
    return found.select("doc_id", F.md5("path").alias("path"), F.md5("resolved").alias("resolved"))


@register(r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size || 'KB' WHEN 1 THEN p_size || 'mb' WHEN 2 THEN ' ' || p_size || ' B ' WHEN 3 THEN p_size || 'k' WHEN 4 THEN p_size || '.5MB' WHEN 5 THEN p_size || 'GB' WHEN 6 THEN '' ELSE p_size || '' END AS size FROM part),
u AS (SELECT *, regexp_extract(upper(trim(size)), '^([+-]?\d+)\s*(KB|MB|B|K)?$', 1) AS n, regexp_extract(upper(trim(size)), '^([+-]?\d+)\s*(KB|MB|B|K)?$', 2) AS f FROM s)
SELECT p_partkey, size, CASE WHEN size = '' THEN 0 WHEN n <> '' THEN n::BIGINT * CASE WHEN f IN ('KB', 'K') THEN 1024 WHEN f = 'MB' THEN 1048576 ELSE 1 END END AS bytes FROM u""")
def parse_size(spark, sf_dir):
    k, s = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    size = F.when(k == 0, F.concat(s, F.lit("KB"))).when(k == 1, F.concat(s, F.lit("mb"))).when(k == 2, F.concat(F.lit(" "), s, F.lit(" B "))).when(k == 3, F.concat(s, F.lit("k"))).when(k == 4, F.concat(s, F.lit(".5MB"))).when(k == 5, F.concat(s, F.lit("GB"))).when(k == 6, "").otherwise(s)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), tx.parse_size(size).alias("bytes"))


@register("SELECT p_partkey, CASE WHEN strlen(k) <= 8 THEN '****' ELSE left(k, 6) || '...' || right(k, 4) END AS shown FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '-' || p_type || p_partkey END AS k FROM part)")
def obfuscate_keys(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("-"), "p_type", F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.obfuscate(key).alias("shown"))


@register(r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split('  ' || replace(text, '. ', '.' || chr(9) || chr(10) || ' ' || chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents""")
def clean_lines(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".\t\n \n")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_lines(padded).alias("cleaned"))


@register("""SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') AS escaped FROM (SELECT doc_id, '<p class="x">' || text || '</p>''' AS t FROM documents)""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.html_escape(F.concat(F.lit('<p class="x">'), "text", F.lit("</p>'"))).alias("escaped"))


@register("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS message FROM documents")
def truncate_messages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_message(F.col("text")).alias("message"))


@register(r"""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS ext, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.basename(u).alias("base"), tx.extension(u).alias("ext"), tx.stem(u).alias("stem"))


@register("SELECT l_orderkey, l_linenumber, printf('%.1f', round_even(l_extendedprice / 1024, 1)) AS kb, printf('%.0f', round_even(l_discount * 100, 0)) AS percent FROM lineitem")
def format_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.format_tenths(F.col("l_extendedprice") / 1024).alias("kb"), tx.format_whole(F.col("l_discount") * 100).alias("percent"))


@register(r"""
WITH f AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '.docx' ELSE '.Png' END AS f, p_name FROM part)
SELECT p_partkey, regexp_replace(f, '\.[^.]*$', '') || '_colorida.' || lower(regexp_extract(f, '\.([^.]*)$', 1)) AS coloured, regexp_replace(f, '\.[^.]*$', '') || ' colorida.docx' AS rebuilt,
  regexp_replace(f, '\.[^.]*$', '') || '_fichas_a4.pdf' AS cards, regexp_replace(f, '\.[^.]*$', '') || '_2up.pdf' AS two_up, upper(p_name) AS label, replace(lower(p_name), ' ', '_') AS theme, lower(f) LIKE '%.docx' AS is_docx FROM f""")
def output_names(spark, sf_dir):
    from foliospark.plans import options as names

    f = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, ".docx").otherwise(".Png"))
    return table(spark, sf_dir, "part").select("p_partkey", names.coloured_name(f).alias("coloured"), names.rebuilt_name(f).alias("rebuilt"), names.cards_name(f, "pdf").alias("cards"), names.two_up_name(f).alias("two_up"), tx.upper_label(F.col("p_name")).alias("label"), tx.theme_slug(F.col("p_name")).alias("theme"), F.lower(f).endswith(".docx").alias("is_docx"))


# --- dates, numbers ---------------------------------------------------------------------------------------------------------------

_DATE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 1 THEN strftime(o_orderdate, ' %d/%m/%Y ') WHEN 2 THEN strftime(o_orderdate, '%d/%m') WHEN 3 THEN strftime(o_orderdate, '%d/%m/YY')
  WHEN 4 THEN '29/02' ELSE strftime(o_orderdate, '%m-%d') END"""
_DATE_SQL = f"""
WITH t AS (SELECT o_orderkey, {_DATE_TEXT} AS raw FROM orders),
d AS (SELECT *, regexp_replace(trim(raw), '/(YY|yy)$', '/26') AS s FROM t)
SELECT o_orderkey, raw, CASE WHEN regexp_matches(s, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN try_strptime(s, '%d/%m/%Y')::DATE
  WHEN regexp_matches(s, '^\\d{{2}}/\\d{{2}}/\\d{{2}}$') THEN try_strptime(left(s, 6) || CASE WHEN right(s, 2)::INT >= 69 THEN '19' ELSE '20' END || right(s, 2), '%d/%m/%Y')::DATE
  WHEN s = '29/02' THEN DATE '2026-03-01' WHEN regexp_matches(s, '^\\d{{2}}/\\d{{2}}$') THEN try_strptime(s || '/2026', '%d/%m/%Y')::DATE END AS day FROM d"""


def _raw_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yy")).when(k == 1, F.date_format(d, " dd/MM/yyyy ")).when(k == 2, F.date_format(d, "dd/MM")).when(k == 3, F.concat(F.date_format(d, "dd/MM/"), F.lit("YY"))).when(k == 4, "29/02").otherwise(F.date_format(d, "MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@register(f"SELECT o_orderkey, raw, strftime(day, '%Y-%m-%d') AS day FROM ({_DATE_SQL})")
def resilient_date(spark, sf_dir):
    return _raw_dates(spark, sf_dir).withColumn("day", F.date_format(tx.resilient_date(F.col("raw")), "yyyy-MM-dd"))


@register(f"SELECT o_orderkey, row_number() OVER (ORDER BY day ASC NULLS LAST, raw, o_orderkey)::INT AS rn FROM ({_DATE_SQL})")
def date_sort(spark, sf_dir):
    return tables.number_all(_raw_dates(spark, sf_dir), [tx.resilient_date(F.col("raw")), "raw", "o_orderkey"]).select("o_orderkey", "rn")


@register("""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(abs(x::DOUBLE) * 400)))) AS v FROM embeddings),
p AS (SELECT vec_id, unnest(range(0, len(v) // 3)) AS i, v FROM c), s AS (SELECT vec_id, v[3*i+1] AS r, v[3*i+2] AS g, v[3*i+3] AS b FROM p),
t AS (SELECT vec_id, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s FROM s)
SELECT vec_id, round(max(s), 9) AS most, count(*) FILTER (s >= 0.15) / count(*) AS ratio, count(*) FILTER (s >= 0.15) / count(*) >= 0.05 AS coloured FROM t GROUP BY vec_id""")
def saturation(spark, sf_dir):
    values = F.transform("embedding", lambda x: tx.clamp(F.floor(F.abs(x.cast("double")) * 400)))
    at = lambda i, j: F.element_at("v", i * 3 + j).cast("double")
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1), lambda i: tx.saturation(at(i, 1), at(i, 2), at(i, 3)))
    s = table(spark, sf_dir, "embeddings").select("vec_id", values.alias("v")).select("vec_id", pixels.alias("s"))
    ratio = F.size(F.filter("s", lambda x: x >= 0.15)) / F.size("s")
    return s.select("vec_id", F.round(F.array_max("s"), 9).alias("most"), ratio.alias("ratio"), (ratio >= 0.05).alias("coloured"))


# --- sorts, layout ----------------------------------------------------------------------------------------------------------------


@register(r"""
WITH n AS (SELECT p_partkey, 'Img' || (p_partkey * 7 % 1000) || CASE WHEN p_partkey % 3 = 0 THEN repeat('0', p_size) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_size ELSE '' END || '.png' AS name FROM part),
k AS (SELECT *, list_transform(regexp_extract_all(name, '\d+|\D+'), lambda r: CASE WHEN regexp_matches(r, '^\d') THEN lpad(ltrim(r, '0'), 80, '0') ELSE lower(r) END) AS runs FROM n)
SELECT p_partkey, name, row_number() OVER (ORDER BY runs, name, p_partkey)::INT AS rn FROM k""")
def natural_rank(spark, sf_dir):
    zeros = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit("0"), F.col("p_size"))).otherwise("")
    name = F.concat(F.lit("Img"), (F.col("p_partkey") * 7 % 1000).cast("string"), zeros, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(""), F.lit(".png"))
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return tables.number_all(parts, [tx.natural_key(F.col("name")), "p_partkey"])


@register("""
WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
l AS (SELECT *, (rn - 1) // 6 AS page, (rn - 1) % 6 AS local FROM n)
SELECT p_partkey, page::INT AS page, ((n + 5) // 6)::BIGINT AS pages, (local % 2)::INT AS col, (local // 2)::INT AS row, round(10 + (local % 2) * ((210 - 20 - 4) / 2.0 + 4), 6) AS x, round(22 + (local // 2) * ((297 - 20 - 12 - 8) / 3.0 + 4), 6) AS y FROM l""")
def paginate_cards(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    numbered = layout.number_rows(parts, ["p_name", "p_partkey"], ["p_brand"])
    numbered = numbered.withColumn("n", F.count("*").over(W.partitionBy("p_brand")))
    cells = layout.card_cells(numbered)
    return cells.select("p_partkey", "page", tx.ceil_div(F.col("n"), 6).alias("pages"), "col", "row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("""
WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
g AS (SELECT p_brand, ((rn - 1) // 2)::INT AS pair, max(CASE WHEN rn % 2 = 1 THEN p_partkey END) AS l, max(CASE WHEN rn % 2 = 0 THEN p_partkey END) AS r FROM n GROUP BY ALL)
SELECT p_brand, pair, l AS "left", coalesce(r, l) AS "right" FROM g""")
def pair_two_up(spark, sf_dir):
    parts = layout.number_rows(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_partkey"], ["p_brand"])
    return layout.pair_two_up(parts, "p_partkey", partition=["p_brand"])


@register("""
WITH d AS (SELECT p_partkey, (p_size * 40 + 100)::DOUBLE AS w, (p_partkey * 37 % 2000 + 100)::DOUBLE AS h FROM part),
s AS (SELECT *, least(138.5 / w, 200.0 / h) AS a, least(138.5 / h, 200.0 / w) AS b FROM d),
r AS (SELECT *, ((w * b) * (h * b) - (w * a) * (h * a)) / ((w * a) * (h * a)) * 100 >= 15 AS rot FROM s)
SELECT p_partkey, rot AS rotated, round(CASE WHEN rot THEN h * b ELSE w * a END, 6) AS draw_w, round(CASE WHEN rot THEN w * b ELSE h * a END, 6) AS draw_h FROM r""")
def layout_rotate(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("double").alias("w"), (F.col("p_partkey") * 37 % 2000 + 100).cast("double").alias("h"))
    placed = layout.place_in_slot(dims, "w", "h")
    return placed.select("p_partkey", "rotated", F.round("draw_w", 6).alias("draw_w"), F.round("draw_h", 6).alias("draw_h"))


@register("""
WITH d AS (SELECT p_partkey, (p_size * 140 + 100)::DOUBLE AS w, (p_partkey * 37 % 5000 + 100)::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN w > 1635 OR h > 2362 THEN greatest(1, trunc(w * least(1635.0::DOUBLE / w, 2362.0::DOUBLE / h)))::INT ELSE w::INT END AS w, CASE WHEN w > 1635 OR h > 2362 THEN greatest(1, trunc(h * least(1635.0::DOUBLE / w, 2362.0::DOUBLE / h)))::INT ELSE h::INT END AS h FROM d""")
def capped_dimensions(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 140 + 100).cast("double").alias("w"), (F.col("p_partkey") * 37 % 5000 + 100).cast("double").alias("h"))
    w, h = layout.capped_dimensions(F.col("w"), F.col("h"), *layout.TwoUpOptions().slot())
    return dims.select("p_partkey", w.alias("w"), h.alias("h"))


@register("""
SELECT p_partkey, CASE WHEN u > 0 THEN u WHEN n <= 3 THEN n WHEN n <= 10 THEN 4 ELSE 5 END AS workers, CASE WHEN u > 0 THEN 100 WHEN n <= 3 THEN 0 WHEN n <= 10 THEN 150 ELSE 300 END AS delay_ms
FROM (SELECT p_partkey, p_size AS n, CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE 0 END AS u FROM part)""")
def dispatch_policy(spark, sf_dir):
    user = F.when(F.col("p_partkey") % 5 == 0, 7).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", layout.dispatch_policy(F.col("p_size"), user).alias("d")).select("p_partkey", "d.*")


# --- joins, groups, windows, sets -------------------------------------------------------------------------------------------------


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def allow_list_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return relational.allow_list(table(spark, sf_dir, "part").select("p_partkey", "p_name"), allowed, "p_partkey")


@register("""
SELECT p_partkey, coalesce(new_content, p_name) AS content, new_content IS NOT NULL AS replaced, s_name IS NOT NULL AS known
FROM part LEFT JOIN (SELECT l_partkey, max(l_comment) AS new_content FROM (SELECT l_partkey, 'new ' || l_orderkey AS l_comment FROM lineitem WHERE l_discount > 0.09) GROUP BY 1) ON l_partkey = p_partkey
LEFT JOIN (SELECT s_suppkey AS s_name FROM supplier) ON s_name = p_partkey""")
def replace_content(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("content"))
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.09")
    new = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.concat(F.lit("new "), F.col("l_orderkey").cast("string"))).alias("new_content"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit(True).alias("_k"))
    out = relational.lookup(relational.replace_content(entries, new, "p_partkey"), known, "p_partkey")
    return out.select("p_partkey", "content", "replaced", F.col("_k").isNotNull().alias("known"))


@register("""
SELECT event_id, count(*) OVER w AS completed, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w ::BIGINT AS success, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w ::BIGINT AS failed, count(*) OVER (PARTITION BY user_id) AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return relational.progress(events, ["user_id"], ["ts", "event_id"], kind == "purchase", kind == "error").select("event_id", "completed", "success", "failed", "total")


@register("SELECT user_id, min(event_id) AS first_event, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_of_each(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relational.first_of_each(events, "user_id", "event_id").select("user_id", F.col("event_id").alias("first_event"), "event_type")


@register("""
WITH c AS (SELECT p_name, CASE WHEN p_type LIKE '%PROMO%' THEN 'process' WHEN p_size < 10 THEN 'print' WHEN p_size > 45 THEN 'other' ELSE 'create' END AS category FROM part)
SELECT category, CASE category WHEN 'create' THEN 1 WHEN 'process' THEN 2 ELSE 3 END AS ord, count(*) AS n, min(p_name) AS first_name, max(p_name) AS last_name FROM c WHERE category <> 'other' GROUP BY 1, 2""")
def category_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_name", "p_type", "p_size")
    rules = [(F.col("p_type").contains("PROMO"), "process"), (F.col("p_size") < 10, "print"), (F.col("p_size") > 45, "other")]
    groups = relational.group_categories(relational.categorise(parts, rules, "create"), ["create", "process", "print"], "p_name")
    return groups.select("category", "ord", F.size("names").cast("long").alias("n"), F.element_at("names", 1).alias("first_name"), F.element_at("names", -1).alias("last_name"))


@register("""
WITH a AS (SELECT p_brand AS k, max(p_name) AS v FROM part GROUP BY 1), b AS (SELECT p_brand AS k, max(p_type) AS v FROM part WHERE p_size > 40 GROUP BY 1)
SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (k)""")
def upsert_map(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    old = parts.groupBy(F.col("p_brand").alias("k")).agg(F.max("p_name").alias("v"))
    new = parts.where("p_size > 40").groupBy(F.col("p_brand").alias("k")).agg(F.max("p_type").alias("v"))
    return relational.upsert(old, new, "k", "v")


@register(r"""
WITH s AS (SELECT 0 AS o, p_partkey AS k, p_name || ', ' || p_brand || ',,' AS t FROM part UNION ALL SELECT 1, item_id, text FROM benchmark UNION ALL SELECT 2, region.r_regionkey, r_name || ' , ' FROM region),
x AS (SELECT o, k, unnest(list_filter(list_transform(string_split(t, ','), lambda i: regexp_replace(i, '^\s+|\s+$', '', 'g')), lambda i: i <> '')) AS item FROM s)
SELECT o::INT AS source_ord, k, item, count(*) AS n FROM x GROUP BY ALL""")
def union_items(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(",,")).alias("t"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("t"))
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.concat("r_name", F.lit(" , ")).alias("t"))
    items = relational.union_in_order(a, b, c).select("source_ord", "k", F.explode(tx.split_items(F.col("t"))).alias("item"))
    return items.groupBy("source_ord", "k", "item").agg(F.count("*").alias("n"))


@register(r"""
WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '# ' || replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ') END AS line FROM conversations),
m AS (SELECT conv_id, turn, trim(line) AS line, left(trim(line), 1) = '#' AS head FROM l WHERE trim(line) <> ''),
b AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM m)
SELECT conv_id, block::BIGINT AS block, coalesce(max(CASE WHEN head THEN trim(regexp_replace(line, '^#+', '')) END), '') AS description, coalesce(string_agg(CASE WHEN NOT head THEN line END, ' ' ORDER BY turn), '') AS body FROM b GROUP BY 1, 2""")
def example_blocks(spark, sf_dir):
    head = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("# "), head)).otherwise(head).alias("line"))
    return relational.example_blocks(lines, "conv_id", "turn")


# --- JSON, messages ---------------------------------------------------------------------------------------------------------------


@register("""
SELECT event_type, count(*) AS n, count(props->>'$.k') AS with_k, count(DISTINCT props) AS kinds, md5(min(props)) AS least FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.countDistinct("props").alias("kinds"), F.md5(F.min("props")).alias("least"))


@register("""
SELECT conv_id, count(*) AS turns, string_agg(turn || '. ' || role || ':' || length(text), chr(10) ORDER BY turn, role, length(text)) AS listing FROM conversations GROUP BY 1""")
def numbered_list(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit(". "), "role", F.lit(":"), F.length("text").cast("string"))
    order = F.struct("turn", "role", F.length("text").alias("_n"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), relational.ordered_text(order, line).alias("listing"))


@register("""
SELECT conv_id, min(role) AS first_role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""")
def chat_payload(spark, sf_dir):
    """Requests are built as JSON and read back."""
    messages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content")))
    requests = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("m")).select("conv_id", st.chat_request(F.lit("model"), F.col("m")).alias("body"))
    parsed = F.from_json("body", "model string, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    back = requests.select("conv_id", F.explode(parsed["messages"]).alias("m"))
    return back.groupBy("conv_id").agg(F.min("m.role").alias("first_role"), F.count("*").alias("n"), F.sum(F.length(F.element_at("m.content", 1)["text"])).alias("chars"))


@register("""
SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN NULL WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 2 THEN false ELSE doc_id % 2 = 0 END AS should_colorize,
  CASE doc_id % 5 WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'bad JSON' END AS error, CASE WHEN doc_id % 5 < 2 THEN lang WHEN doc_id % 5 = 2 THEN '' END AS reason FROM documents""")
def fenced_json(spark, sf_dir):
    """Plain, fenced, keyless, empty and wrongly typed replies."""
    k = F.col("doc_id") % 5
    body = F.concat(F.lit('{"should_colorize": '), (F.col("doc_id") % 2 == 0).cast("string"), F.lit(', "reason": "'), "lang", F.lit('"}'))
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, "{}").when(k == 3, "no object here").otherwise('{"should_colorize": "perhaps"}')
    verdict = st.triage_verdict(reply)
    return table(spark, sf_dir, "documents").select("doc_id", verdict["should_colorize"].alias("should_colorize"), verdict["error"].alias("error"), verdict["reason"].alias("reason"))


@register(r"""
WITH t AS (SELECT page_id, page_id % 5 AS k, url FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'image_url' WHEN 1 THEN 'url' WHEN 2 THEN 'data' WHEN 3 THEN 'base64' END AS kind,
  CASE k WHEN 0 THEN 'https://x.example.com/' || page_id || '.PNG' WHEN 1 THEN 'https://x.example.com/' || page_id WHEN 2 THEN 'data:image/jpeg;base64,' || repeat('QUJD', 20) WHEN 3 THEN repeat('QUJD', 30) END AS value,
  CASE WHEN k = 2 THEN 'jpg' ELSE 'png' END AS ext FROM t""")
def image_references(spark, sf_dir):
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("see https://x.example.com/"), i, F.lit(".PNG) there"))).when(k == 1, F.concat(F.lit("at https://x.example.com/"), i, F.lit(" now"))).when(k == 2, F.concat(F.lit("![](data:image/jpeg;base64,"), F.repeat(F.lit("QUJD"), 20), F.lit(")"))).when(k == 3, F.concat(F.lit(" "), F.repeat(F.lit("QUJD"), 30), F.lit("\n"))).otherwise("nothing")
    found = st.image_reference(text)
    return table(spark, sf_dir, "pages").select("page_id", found["kind"].alias("kind"), found["value"].alias("value"), st.data_url_extension(F.coalesce(found["value"], F.lit(""))).alias("ext"))


@register("""SELECT doc_id, 'data:image/' || CASE doc_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'svg+xml' ELSE 'png' END || ';base64,' || to_base64(encode(text)) AS url FROM documents""")
def data_urls(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 3 == 0, "JPG").when(F.col("doc_id") % 3 == 1, "svg").otherwise("gif")
    return table(spark, sf_dir, "documents").select("doc_id", st.data_url(F.col("text").cast("binary"), ext).alias("url"))


@register("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'status 429' WHEN 1 THEN 'quota' WHEN 2 THEN 'no choices' END AS error, CASE WHEN doc_id % 4 = 3 THEN lang END AS content, CASE WHEN doc_id % 8 = 3 THEN 'https://x.example.com/a.png' END AS image FROM documents""")
def unwrap_responses(spark, sf_dir):
    k = F.col("doc_id") % 4
    status = F.when(k == 0, 429).otherwise(200)
    images = F.when(F.col("doc_id") % 8 == 3, ', "images": [{"image_url": {"url": "https://x.example.com/a.png"}}]').otherwise("")
    body = F.when(k == 0, "{}").when(k == 1, '{"error": {"message": "quota"}}').when(k == 2, '{"choices": []}').otherwise(F.concat(F.lit('{"choices": [{"message": {"content": "'), "lang", F.lit('"'), images, F.lit("}}]}")))
    found = st.unwrap_response(status, body)
    return table(spark, sf_dir, "documents").select("doc_id", found["error"].alias("error"), found["content"].alias("content"), found["image"].alias("image"))


@register("""
SELECT n_regionkey, md5(string_agg('#' || n_nationkey || ' ' || n_name, '|' ORDER BY n_nationkey)) AS listing FROM nation GROUP BY 1""")
def routine_rows(spark, sf_dir):
    """Replies with an array of rows, decoded and put together again."""
    row = F.concat(F.lit('{"data": "'), F.col("n_nationkey").cast("string"), F.lit('", "campo": "'), "n_name", F.lit('"}'))
    replies = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("Here:\n["), F.array_join(F.collect_list(row), ","), F.lit("] ok")).alias("reply"))
    rows = replies.select("n_regionkey", F.explode(st.routine_rows(F.col("reply"))).alias("r"))
    line = F.concat(F.lit("#"), "r.data", F.lit(" "), "r.campo")
    return rows.groupBy("n_regionkey").agg(F.md5(relational.ordered_text(F.col("r.data").cast("int"), line, "|")).alias("listing"))


# --- options, stamps, prompts, lookups --------------------------------------------------------------------------------------------


@register("""
SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M%S') AS second FROM orders""")
def output_stamps(spark, sf_dir):
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.day_stamp(F.col("o_orderdate")).alias("day"), tx.second_stamp(at).alias("second"))


@register(r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 < 3 THEN source ELSE 'constant' END AS prompt, 'In ' || lang || ', as ' || source || '; {{.Other}} ' || lang AS filled FROM documents""")
def prompt_choice(spark, sf_dir):
    """The user's text if it isn't blank, else the built-in one, else the constant; and a template filled in."""
    k = F.col("doc_id") % 4
    override = F.when(k == 0, F.col("lang")).when(k == 1, " \n\t")
    chosen = tx.first_filled(override, F.when(k < 3, F.col("source")), F.lit("constant"))
    filled = tx.fill_template(F.lit("In {{.Lang}}, as {{.Source}}; {{.Other}} {{.Lang}}"), Lang=F.col("lang"), Source=F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", chosen.alias("prompt"), filled.alias("filled"))


@register("""
SELECT p_partkey, CASE WHEN p_size % 7 > 2 THEN (p_size % 7 - 2)::DOUBLE ELSE 5 END AS margin, CASE WHEN p_size % 5 > 1 THEN (p_size % 5 - 1)::DOUBLE ELSE 15 END AS rotate_threshold,
  CASE WHEN p_size % 3 = 0 THEN 'contain' ELSE 'cover' END AS fit, CASE WHEN p_size % 2 = 0 THEN 300 ELSE p_size END::INT AS max_dpi, CASE WHEN p_partkey % 150 BETWEEN 1 AND 100 THEN p_partkey % 150 ELSE 85 END::INT AS quality FROM part""")
def settled_options(spark, sf_dir):
    size = F.col("p_size")
    o = layout.settled_options((size % 7 - 2).cast("double"), (size % 5 - 1).cast("double"), F.when(size % 3 == 0, "").otherwise("cover"), F.when(size % 2 == 0, -size).otherwise(size), (F.col("p_partkey") % 150).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", o.alias("o")).select("p_partkey", "o.*")


@register("""
WITH d AS (SELECT p_partkey, (p_size * 40 + 100)::DOUBLE AS w, (p_partkey * 37 % 2000 + 100)::DOUBLE AS h FROM part)
SELECT p_partkey, round(w * least(91.0 / w, 75.0 / h), 6) AS contain_w, round(h * least(91.0 / w, 75.0 / h), 6) AS contain_h, round(w * greatest(91.0 / w, 75.0 / h), 6) AS cover_w, round(h * greatest(91.0 / w, 75.0 / h), 6) AS cover_h FROM d""")
def fitted_sizes(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("double").alias("w"), (F.col("p_partkey") * 37 % 2000 + 100).cast("double").alias("h"))
    cw, ch = layout.fit_contain(F.col("w"), F.col("h"), 91.0, 75.0)
    vw, vh = layout.fit(F.col("w"), F.col("h"), 91.0, 75.0, "Cover")
    return dims.select("p_partkey", F.round(cw, 6).alias("contain_w"), F.round(ch, 6).alias("contain_h"), F.round(vw, 6).alias("cover_w"), F.round(vh, 6).alias("cover_h"))


_WIDTHS = ", ".join(map(str, layout.HELVETICA_BOLD))


@register(f"""
WITH l AS (SELECT p_partkey, upper(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END) AS label FROM part),
w AS (SELECT p_partkey, label, list_sum(list_transform(string_split(label, ''), lambda c: [{_WIDTHS}][unicode(c) - 31])) AS width FROM l),
s AS (SELECT p_partkey, label, width, size FROM w, (SELECT 8 + range * 0.5 AS size FROM range(0, 9)) WHERE size = 8 OR width / 1000.0 * size * 25.4 / 72 <= 93 - 2 + 1e-9)
SELECT p_partkey, label, max(size)::DOUBLE AS size FROM s GROUP BY 1, 2""")
def label_sizes(spark, sf_dir):
    label = tx.upper_label(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), layout.label_size(label, F.lit(93.0)).alias("size"))


@register("SELECT p_partkey, p_name, s_suppkey * 2 AS twice FROM part JOIN supplier ON s_suppkey = p_partkey")
def required_lookup(spark, sf_dir):
    """Rows that the dimension lacks go."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), (F.col("s_suppkey") * 2).alias("twice"))
    return relational.lookup(table(spark, sf_dir, "part").select("p_partkey", "p_name"), known, "p_partkey", required=True)


@register("SELECT p_partkey, (p_size % 3 + 1) * 1200 + p_partkey * 7 % 400 AS wait FROM part")
def retry_waits(spark, sf_dir):
    from foliospark.sources.models import wait_ms

    return table(spark, sf_dir, "part").select("p_partkey", wait_ms(F.col("p_size") % 3 + 1, F.col("p_partkey") * 7).alias("wait"))


@register("""
WITH r AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 3 = 0 AND p_size % 2 = 0) AS ready, min(CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN p_partkey END) AS first_ready FROM part GROUP BY 1)
SELECT * FROM r WHERE ready > 0""")
def ready_items(spark, sf_dir):
    """Items that are done and have a path."""
    from foliospark.plans import pipelines

    size = F.col("p_size")
    items = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(size % 3 == 0, "done").when(size % 3 == 1, "error").otherwise("pending").alias("status"), F.when(size % 2 == 0, F.concat(F.lit("/x/"), "p_name")).when(size % 4 == 1, "").alias("path"))
    made = pipelines.ready(items).groupBy("p_brand").agg(F.count("*").alias("ready"), F.min("p_partkey").alias("first_ready"))
    return items.groupBy("p_brand").agg(F.count("*").alias("n")).join(made, "p_brand")


@register("""
SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS pos, n_name AS name, 'draw ' || lower(n_name) AS prompt FROM nation""")
def prompt_items(spark, sf_dir):
    """Item lists decoded from fenced replies with prose around them."""
    item = F.to_json(F.struct(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"), F.lit("x").alias("slug"), F.concat(F.lit("draw "), F.lower("n_name")).alias("prompt")))
    replies = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("item")))).alias("items"))
    reply = F.concat(F.lit("```json\nHere you are: ["), F.array_join(F.col("items")["item"], ", "), F.lit("] enjoy\n```"))
    rows = replies.select("n_regionkey", F.posexplode(st.prompt_items(reply)).alias("pos", "i"))
    return rows.select("n_regionkey", (F.col("pos") + 1).alias("pos"), "i.name", "i.prompt")
