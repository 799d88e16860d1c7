"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs; all but
the last return the columns of documents.

In every stage null and empty texts are documents without words: they aren't toxic, near any other, repeated or contaminated, so they
stay (null may become empty in the third stage), and they are packed as one end id each. Rows of null doc_id stay as well. Of rows that
agree in doc_id and text the second stage keeps one; before it they are scored alike. Other columns, whatever their names, are left out
by the first stage. Texts of any length are taken whole. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, jaccard, packing, shared, suffixes, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier predicts toxic go."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one of smallest doc_id stays; of repeated rows, one."""
    groups = jaccard.jaccard_components(docs, 5, 4, 5)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    kept = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return kept.select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def remove_repeated_strings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose strings of 200 bytes that occur elsewhere; every document stays."""
    out = suffixes.remove_repeats(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_spans") == 0).select(*COLUMNS)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of 4096."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the fitted classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
