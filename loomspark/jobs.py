"""Corpus jobs: each reads tables, runs operators and writes tables or a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import persian
from .functions.lexicon import Lexicon
from .operators import clustering, corpus, quantiles
from .plans import golden
from .sources import files

LETTER = "[ء-ی]"


def audit(spark: SparkSession, source: str, out: str, text: str = "sentence", key: str = "idx") -> DataFrame:
    """The manifest of a corpus: counts, flags and rates of every row, written as zstd Parquet."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(source)
    body = F.coalesce(F.col(text), F.lit(""))
    letters = F.regexp_count(body, F.lit(LETTER))
    rows = df.select(
        key,
        F.col("_metadata.file_name").alias("shard"),
        F.col("duration").cast("double").alias("duration"),
        F.length(body).alias("n_chars"),
        F.regexp_count(body, F.lit(r"\S+")).alias("n_words"),
        letters.alias("n_letters"),
        F.when(F.col("duration") > 0, F.round(letters / F.col("duration"), 4)).otherwise(0.0).alias("letters_per_sec"),
        body.rlike("[A-Za-z]").alias("has_latin"),
        F.expr(persian.digits(persian.SPARK, f"coalesce(`{text}`, '')")).rlike("[0-9]").alias("has_digit"),
        body.contains(persian.ZWNJ).alias("has_zwnj"),
        *corpus.mos_columns(df),
    )
    rows.write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def build_manifest(manifest: DataFrame, clusters: DataFrame, out: str, tier_a: dict, tier_b: dict, clips: int = 600, speakers: int = 40, size: tuple[int, int] = (10, 200), least_a: int = 5) -> dict:
    """Tiers and a speaker-disjoint evaluation set, written as JSON lines; a shared speaker aborts.

    ``tier_a`` and ``tier_b`` are keyword arguments of ``corpus.tier``; ``clusters`` is (idx, cluster).
    """
    window = corpus.fit_window(manifest, "letters_per_sec")
    if window is None:
        raise ValueError("no positive rate to fit a window on")
    rows = corpus.align(manifest, clusters)
    rows = rows.withColumn("a", corpus.tier(rate="letters_per_sec", window=window, **tier_a)).withColumn("b", corpus.tier(rate="letters_per_sec", window=window, **tier_b))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("all"), F.count_if("a").alias("n")).filter(F.col("all").between(*size) & (F.col("n") >= least_a))
    held = corpus.hold_out(sizes.select("cluster", "n"), clips, speakers).select("cluster")
    parts = {
        "eval": rows.filter("a").join(held, "cluster", "left_semi"),
        "tier_a": rows.filter("a").join(held, "cluster", "left_anti"),
        "tier_b": rows.filter("b").join(held, "cluster", "left_anti"),
    }
    for name in ("tier_a", "tier_b"):
        corpus.check_leak(parts[name], parts["eval"])
    report = {}
    for name, part in parts.items():
        part.drop("a", "b").write.json(f"{out}/{name}")
        r = part.agg(F.count(F.lit(1)).alias("clips"), (F.sum("duration") / 3600).alias("hours"), F.count_distinct("cluster").alias("speakers")).first()
        report[name] = r.asDict()
    return report | {"window": window}


def discover_speakers(vectors: DataFrame, threshold: float, out: str) -> DataFrame:
    """Cluster and confidence of every vector, and the cluster report."""
    labels = clustering.assign(vectors, clustering.fit_clusters(vectors, threshold))
    labels.write.parquet(f"{out}/labels")
    labels = vectors.sparkSession.read.parquet(f"{out}/labels")
    total = Window.partitionBy()
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")).withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(total), 2)).orderBy(F.desc("n"), "cluster").limit(60)


def verify(scored: DataFrame, thresholds=(0.05, 0.1, 0.15, 0.2, 0.3, 0.5)) -> dict:
    """Percentiles, mean and keep rates of a table with a ``cer`` column."""
    cuts = quantiles.exact_quantiles(scored, "cer", [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    kept = scored.agg(F.avg("cer").alias("mean"), *[F.avg((F.col("cer") <= t).cast("double")).alias(str(t)) for t in thresholds]).first().asDict()
    return {"percentiles": cuts, **kept}


def pack_subset(corpus_rows: DataFrame, selection: DataFrame, vectors: DataFrame, out: str, rows_per_file: int = 4000) -> None:
    """The selected rows with their vectors, in files of so many rows."""
    corpus.write_packed(corpus_rows.join(selection.select("idx", "speaker"), "idx").join(vectors.select("idx", "embedding"), "idx"), out, rows_per_file)


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon from a TSV of words and readings; it is a dictionary, small enough for every worker."""
    return Lexicon.build({r["key"]: r["readings"] for r in files.lexicon(spark, path).collect()})


def evaluate_golden(spark: SparkSession, path: str, lexicon: str | None = None) -> DataFrame:
    """Exact sentences and linkers of a golden set, by category and over all, with a lexicon of one's own or the default."""
    return golden.evaluate(spark, path, read_lexicon(spark, lexicon) if lexicon else None)
