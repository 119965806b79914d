"""Scoring: canonical text, character error rate, keep rates, accuracy, precision and recall.

References and hypotheses are adjacent turns of ``conversations``; accents are folded first, so
that edit distance counts characters in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect, catalogue
from ..operators.quantiles import grouped_quantiles
from ..operators.sequence import edit_distances

ACCENTED, PLAIN = "àáâäçèéêëìíîïñòóôöùúûüß", "aaaaceeeeiiiinoooouuuus"
#: Parts that pairs of texts are dealt in, at least.
PARTS = 48
THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9)


def canon(d: Dialect, x: str) -> str:
    """Lower case, accents folded, everything but letters a space, spaces collapsed."""
    folded = f"translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}')"
    return f"trim({d.sub(folded, '[^a-z]+', ' ')})"


def pairs(d: Dialect) -> str:
    """idx, ref, hyp: a turn and the one after it, whole."""
    ref, hyp = (canon(d, x) for x in ("a.text", "b.text"))
    return f"SELECT a.conv_id * 100 + a.turn AS idx, {ref} AS ref, {hyp} AS hyp FROM {d.t('conversations')} a JOIN {d.t('conversations')} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def cer(d: Dialect) -> str:
    """An empty reference scores 1; a score can pass 1.

    Distances are the whole cost, so in Spark the pairs are dealt anew, in as many parts as keep all cores
    busy (the join leaves as few as their bytes need), and each pair is measured once.
    """
    if d.session is None:
        return plain_cer(d)
    if "cer" not in d.fits:
        d.fits["cer"] = f"loomspark_cer_{uuid.uuid4().hex}"
        dealt = d.session.sql(pairs(d)).repartition(max(PARTS, 4 * d.session.sparkContext.defaultParallelism), F.xxhash64("idx", "ref", "hyp"))
        length = F.length("ref")
        score = F.when(length == 0, F.lit(1.0)).otherwise(edit_distances("ref", "hyp").cast("double") / length)
        dealt.select("idx", length.cast("long").alias("ref_len"), F.length("hyp").cast("long").alias("hyp_len"), score.alias("cer")).createOrReplaceTempView(d.fits["cer"])
    return f"SELECT idx, ref_len, hyp_len, cer FROM {d.fits['cer']}"


def plain_cer(d: Dialect) -> str:
    """``cer`` as SQL alone, for the oracle and for queries that leave the score out."""
    return f"SELECT idx, {d.long('length(ref)')} AS ref_len, {d.long('length(hyp)')} AS hyp_len, CASE WHEN length(ref) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(levenshtein(ref, hyp) AS DOUBLE) / length(ref) END AS cer FROM ({pairs(d)}) p"


TEXTS = {
    # T11
    "canon_text": lambda d: f"SELECT item_id, {canon(d, 'text')} AS canon FROM {d.t('benchmark')}",
    # T12 T13
    "cer_rows": lambda d: f"SELECT idx, ref_len, hyp_len, round(cer, 6) AS cer FROM ({cer(d)}) c",
    # A22
    "cer_summary": lambda d: "SELECT " + ", ".join(f"round({d.at('ps', str(i + 1))}, 6) AS p{q}" for i, q in enumerate((5, 25, 50, 75, 95, 99))) + f", round(mean, 6) AS mean FROM (SELECT {d.pcts('cer', (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))} AS ps, avg(cer) AS mean FROM ({cer(d)}) c) s",
    # A23
    "keep_rate": lambda d: f"SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN cer <= threshold THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS kept FROM ({cer(d)}) c CROSS JOIN {d.each(d.array(*THRESHOLDS), 'threshold')} t GROUP BY threshold",
    # A24
    "cost_projection": lambda d: f"SELECT count(*) AS n, round(CAST(sum(hyp_len) AS DOUBLE) / 15 / 3600, 6) AS hours, round(CAST(sum(hyp_len) AS DOUBLE) / 15 / 3600 / 2.3 * 0.8, 6) AS usd FROM ({plain_cer(d)}) c",
    # Overall and by category
    "golden_accuracy": lambda d: f"""
        SELECT coalesce(lang, 'overall') AS category, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS exact
        FROM {d.t('documents')} JOIN {d.t('labels')} USING (doc_id) GROUP BY ROLLUP (lang)""",
    # Counts of the linker per row, predicted against reference
    "linker_f1": lambda d: f"""
        SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision_, round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall_
        FROM (SELECT CAST(sum(least(p, r)) AS BIGINT) AS tp, CAST(sum(greatest(p - r, 0)) AS BIGINT) AS fp, CAST(sum(greatest(r - p, 0)) AS BIGINT) AS fn
              FROM (SELECT length(ref) - length(replace(ref, 'e', '')) AS r, length(hyp) - length(replace(hyp, 'e', '')) AS p FROM ({pairs(d)}) x) y) z""",
    # A29
    "median_latency": lambda d: f"SELECT event_type, round({d.pct('value', 0.5)}, 6) AS median_value FROM {d.t('events')} GROUP BY event_type",
}

QUERIES, ORACLE = catalogue(TEXTS)


def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each kind of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return grouped_quantiles(events, "event_type", "value", [0.5]).select("event_type", F.round(F.col("ps")[0], 6).alias("median_value"))


QUERIES["median_latency"] = median_latency
