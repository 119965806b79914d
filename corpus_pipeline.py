"""The corpus pipeline: toxicity, quality, line removal, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

Edge cases: null and empty texts pass toxicity and are judged on quality as empty pages; documents
without an id are documents like others, and go where a copy has an id; of rows with one id and one
text one stays after the near-duplicate stage, of rows with one id and different texts all that are
no copies; extra columns are carried to the last stage; an empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import op3_toxicity, op7_quality
from loomspark.llm.common import broadcast_if_small, durable
from loomspark.llm.near_copies import near_copies, text_key
from loomspark.llm.op2_packing import packed_documents
from loomspark.llm.op5_line_dedup import drop_boilerplate

SCORE, ROW = "__loom_score", "__loom_row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject."""
    model = op3_toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = op3_toxicity.score(docs, model, docs.columns, SCORE)
    return scored.filter(F.col(SCORE) < op3_toxicity.CUTOFF).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    model = op7_quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = op7_quality.score(docs, model, docs.columns, SCORE)
    return scored.filter(F.col(SCORE) >= op7_quality.CUTOFF).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    kept = drop_boilerplate(docs, host="source", count="__loom_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__loom_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity 0.8 or more: that of the least id.

    A document is its id and its text, so an id with several texts loses none but copies.
    """
    groups = durable(near_copies(docs), "groups")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key"))
    named = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key").alias(ROW)
    copies = groups.filter(~is_head).select(named).distinct()
    again = groups.filter(is_head).groupBy(named).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(ROW)
    n_copies, n_again = copies.count(), again.count()
    row = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_key().alias("key"))
    kept = docs.withColumn(ROW, row).join(broadcast_if_small(copies, n_copies, 48), ROW, "left_anti")
    if n_again:  # a document on several rows: the shuffle that leaves one row is paid for those alone
        again = broadcast_if_small(again, n_again, 48)
        kept = kept.join(again, ROW, "left_anti").unionByName(kept.join(again, ROW, "left_semi").dropDuplicates([ROW]))
    return kept.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Trained models, fingerprints over words and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
