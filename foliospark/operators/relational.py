"""Joins, groups, windows, sorts and sets over item tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as tx


def split_by_size(df: DataFrame, size: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows of `least` bytes or more, and all others; a null size is skipped."""
    kept = F.coalesce(F.col(size) >= least, F.lit(False)) if least > 0 else F.lit(True)
    return df.where(kept), df.where(~kept)


def allow_list(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; repeated list entries multiply nothing. Spark picks the join by the list's size."""
    return df.join(names.select(key), key, "left_semi")


def lookup(df: DataFrame, dimension: DataFrame, key: str, required: bool = False) -> DataFrame:
    return df.join(dimension, key, "inner" if required else "left")


def replace_content(entries: DataFrame, replacements: DataFrame, key: str, content: str = "content", new: str = "new_content") -> DataFrame:
    """Each entry with its replacement's content if there is one, else its own."""
    joined = entries.join(replacements.select(key, new), key, "left")
    return joined.withColumn("replaced", F.col(new).isNotNull()).withColumn(content, F.coalesce(new, content)).drop(new)


def resolve_paths(wanted: DataFrame, existing: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """(path, resolved): the same path if it exists, else the first existing one of equal path_key, else null."""
    exact = wanted.join(existing.select(F.col(path).alias("_exact")).distinct(), F.col(path) == F.col("_exact"), "left")
    keyed = existing.groupBy(tx.path_key(F.col(path)).alias("_key")).agg(F.min_by(path, order).alias("_fuzzy"))
    found = exact.join(keyed, tx.path_key(F.col(path)) == F.col("_key"), "left")
    return found.select(*wanted.columns, F.coalesce("_exact", "_fuzzy").alias("resolved"))


def progress(df: DataFrame, partition: list, order: list, done: Column, failed: Column) -> DataFrame:
    """Running completed, success and failed counts, and the total, of ordered events."""
    so_far = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({
        "completed": F.count("*").over(so_far),
        "success": F.sum(F.when(done, 1).otherwise(0)).over(so_far),
        "failed": F.sum(F.when(failed, 1).otherwise(0)).over(so_far),
        "total": F.count("*").over(W.partitionBy(*partition)),
    })


def ordered_text(order: Column, value: Column, separator: str = "\n") -> Column:
    """Aggregate: values in order as one text."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(key, "_first.*")


def categorise(df: DataFrame, rules: list[tuple[Column, str]], default: str, out: str = "category") -> DataFrame:
    column = None
    for test, name in rules:
        column = F.when(test, name) if column is None else column.when(test, name)
    return df.withColumn(out, column.otherwise(default))


def group_categories(df: DataFrame, categories: list[str], name: str, category: str = "category") -> DataFrame:
    """Names of each listed category, sorted, in the list's order (ord); empty and unlisted categories don't show."""
    place = F.array_position(F.array(*map(F.lit, categories)), F.col(category))
    return df.where(F.col(category).isin(categories)).groupBy(category, place.cast("int").alias("ord")).agg(F.sort_array(F.collect_list(name)).alias("names"))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two key-value tables; the new value wins."""
    both = old.select(key, value, F.lit(0).alias("_o")).unionByName(new.select(key, value, F.lit(1).alias("_o")))
    return both.groupBy(key).agg(F.max_by(value, "_o").alias(value))


def union_in_order(*sources: DataFrame) -> DataFrame:
    """UNION ALL with the source's number in source_ord."""
    out = None
    for i, df in enumerate(sources):
        df = df.withColumn("source_ord", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def date_order(raw: Column, *ties: Column) -> list[Column]:
    """Sort by date, rows without one last by their raw text."""
    return [tx.resilient_date(raw).asc_nulls_last(), raw.asc(), *ties]


def search(df: DataFrame, query: str, *fields: str) -> DataFrame:
    """Rows whose fields, joined by spaces, contain the query without regard to case; a blank query finds nothing."""
    q = query.strip().lower()
    return df.where(F.lower(F.concat_ws(" ", *fields)).contains(q) if q else F.lit(False))


def example_blocks(lines: DataFrame, partition: str, order: str, line: str = "line") -> DataFrame:
    """(partition, block, description, body): a line that starts with # opens a block, the lines after it join with spaces."""
    so_far = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    bare = tx.trim(F.col(line))
    marked = lines.withColumn("_line", bare).where(F.col("_line") != "").withColumn("_head", F.col("_line").startswith("#"))
    marked = marked.withColumn("block", F.sum(F.col("_head").cast("int")).over(so_far))
    description = F.max(F.when(F.col("_head"), tx.trim(F.regexp_replace("_line", "^#+", ""))))
    body = F.sort_array(F.collect_list(F.when(~F.col("_head"), F.struct(F.col(order).alias("o"), F.col("_line").alias("v")))))
    return marked.groupBy(partition, "block").agg(F.coalesce(description, F.lit("")).alias("description"), F.array_join(F.transform(body, lambda x: x["v"]), " ").alias("body"))


def visible_nodes(nodes: DataFrame, node: str, parent: str, shown: Column) -> DataFrame:
    """The nodes (column `node`) of a tree that are shown and all of whose ancestors are; a root has a null parent, and a node whose
    parent isn't in the table isn't visible. Nodes are distinct. Level by level from the roots, so rounds are as many as the tree is
    deep; Spark's own bounds on a recursion's rows and levels are lifted in the session."""
    spark = nodes.sparkSession
    for bound in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"):
        spark.conf.set(bound, "-1")
    names = [f"visible_{uuid.uuid4().hex}" for _ in range(2)]
    kept = nodes.where(shown).select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    kept.where("parent is null").createOrReplaceTempView(names[0])
    kept.where("parent is not null").createOrReplaceTempView(names[1])
    try:
        return spark.sql(f"WITH RECURSIVE v(node) AS (SELECT node FROM {names[0]} UNION ALL SELECT c.node FROM v JOIN {names[1]} c ON c.parent = v.node) SELECT node AS `{node}` FROM v")
    finally:
        for n in names:
            spark.catalog.dropTempView(n)
