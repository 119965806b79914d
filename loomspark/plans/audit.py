"""Corpus audit: profiles, percentiles, windows, tiers, histograms, frequencies, duplicates.

The manifest stands on ``lineitem`` where scale matters (l_suppkey as cluster, l_quantity as
duration, l_extendedprice / l_quantity as rate) and on ``documents`` where text does. A duration of
a document is the proxy ``1 + doc_id * 37 % 390 / 10`` seconds, and its MOS ``2.5 + 0.5 * quality``
(null where unlabelled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect, catalogue
from ..operators.corpus import register_text_counts
from ..operators.quantiles import column_report, grouped_quantiles
from .frontend import _folder

DURATION = "(1.0 + (doc_id * 37 % 390) / 10.0)"
HISTOGRAM_EDGES = (0, 0.5, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60)
QUANTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
LETTERS = "[^A-Za-zÀ-ÖØ-öø-ÿ]+"


def manifest(d: Dialect) -> str:
    """idx, shard, text, duration, n_chars, n_words, n_letters, rate, mos of every document.

    In Spark letters and words are counted in the bytes of a batch of texts at once: its regular expressions
    make a copy of all letters and an array of all words.
    """
    chars, letters, words = d.long("length(body)"), d.long(f"length({d.sub('body', LETTERS, '')})"), d.matches("body", "[^ \t\n]+")
    body = f"SELECT doc_id, source, coalesce(text, '') AS body, CAST({DURATION} AS DOUBLE) AS duration FROM {d.t('documents')}"
    if d.session is not None:
        # Below the join, which texts then need not pass.
        body = f"SELECT *, {chars} AS chars, {register_text_counts(d.session)}(body) AS counts FROM ({body}) b"
        chars, letters, words = "chars", "counts.letters", "counts.words"
    return f"""
        SELECT idx, shard, body, duration, n_chars, n_letters, n_words, mos, CASE WHEN duration > 0 THEN CAST(n_letters AS DOUBLE) / duration ELSE 0 END AS rate FROM (
            SELECT x.doc_id AS idx, source AS shard, body, duration, {chars} AS n_chars, {letters} AS n_letters,
                   {words} AS n_words, CAST(2.5 + 0.5 * quality AS DOUBLE) AS mos
            FROM ({body}) x
            LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {d.t('labels')} GROUP BY doc_id) l ON x.doc_id = l.doc_id) r"""


def rates(d: Dialect) -> str:
    """idx, cluster, duration, rate over the large table."""
    return f"SELECT l_orderkey * 10 + l_linenumber AS idx, l_suppkey AS cluster, l_quantity AS duration, l_extendedprice / l_quantity AS rate, l_discount AS mos FROM {d.t('lineitem')} WHERE l_quantity > 0"


def _percentiles(d: Dialect, x: str, name: str, rows: str) -> str:
    qs = [q / 100 for q in QUANTILES]
    cuts = ", ".join(f"round({d.at('ps', str(i + 1))}, 4) AS p{q}" for i, q in enumerate(QUANTILES))
    return f"SELECT '{name}' AS measure, {cuts}, mean, lowest, highest FROM (SELECT {d.fitted(rows, x, qs) or d.pcts(x, qs)} AS ps, round(avg({x}), 4) AS mean, round(min({x}), 4) AS lowest, round(max({x}), 4) AS highest FROM ({rows}) m) s"


def window(d: Dialect, rows: str) -> str:
    """The bounds of the usual rates: fitted first, then literals of the plan that filters by them."""
    positive = f"SELECT rate FROM ({rows}) w WHERE rate > 0"
    ps = d.fitted(positive, "rate", (0.02, 0.98))
    source = f"SELECT {ps} AS ps" if ps else f"SELECT {d.pcts('rate', (0.02, 0.98))} AS ps FROM ({positive}) p"
    return f"SELECT {d.at('ps', '1')} AS lo, {d.at('ps', '2')} AS hi FROM ({source}) s"


def tiers(d: Dialect, rows: str) -> str:
    """Rows with tier flags: bounds are inclusive, a missing MOS fails."""
    return f"""
        SELECT m.*, lo, hi, coalesce(mos, -1) >= 0.06 AND duration BETWEEN 10 AND 40 AND rate BETWEEN lo AND hi AS tier_a,
               coalesce(mos, -1) >= 0.03 AND duration BETWEEN 5 AND 48 AND rate BETWEEN lo AND hi AS tier_b
        FROM ({rows}) m CROSS JOIN ({window(d, rows)}) f"""


def _histogram(d: Dialect) -> str:
    pairs = list(zip(HISTOGRAM_EDGES, HISTOGRAM_EDGES[1:]))
    case = " ".join(f"WHEN duration >= {a} AND duration {'<=' if b == HISTOGRAM_EDGES[-1] else '<'} {b} THEN '{a}-{b}s'" for a, b in pairs)
    return f"SELECT bin, count(*) AS n FROM (SELECT CASE {case} END AS bin FROM ({rates(d)}) m) h WHERE bin IS NOT NULL GROUP BY bin"


def _tier_row(d: Dialect, tier: str) -> str:
    return f"SELECT '{tier}' AS tier, {d.when(tier)} AS n, round(sum(CASE WHEN {tier} THEN duration ELSE 0 END) / 3600, 6) AS hours, round(CAST(100 AS DOUBLE) * {d.when(tier)} / count(*), 4) AS pct FROM ({tiers(d, rates(d))}) t"


#: 128 bits that stand for a text, so that texts themselves are neither grouped nor shuffled.
_digest = "md5(trim(coalesce(text, '')))"

TEXTS = {
    # Flags and group-by shard
    "audit_profile_by_source": lambda d: f"""
        SELECT source, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, {d.when(d.has("coalesce(text, '')", '[0-9]'))} AS with_digit,
               {d.when(d.has("coalesce(text, '')", '[A-Za-z]'))} AS with_latin, {d.when("trim(coalesce(text, '')) = ''")} AS empty
        FROM {d.t('documents')} GROUP BY source""",
    "audit_flags": lambda d: f"""
        SELECT count(*) AS n, {d.when("body = ''")} AS empty, {d.when(d.has('body', '[A-Za-z]'))} AS latin, {d.when(d.has('body', '[0-9]'))} AS digit,
               {d.when("body LIKE '%‌%'")} AS zwnj FROM ({manifest(d)}) m""",
    "audit_shards": lambda d: f"""
        SELECT shard, count(*) AS n, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS mean_duration, round({d.pct('rate', 0.5)}, 6) AS median_rate,
               round({d.pct('mos', 0.5)}, 6) AS median_mos FROM ({manifest(d)}) m GROUP BY shard""",
    # P2 P3 P4 A7
    "text_profile": lambda d: f"SELECT idx, n_chars, n_words, n_letters, round(rate, 4) AS rate, mos FROM ({manifest(d)}) m",
    # A1
    "text_percentiles": lambda d: " UNION ALL ".join(_percentiles(d, x, x, manifest(d)) for x in ("duration", "n_chars", "rate")),
    "lineitem_percentiles": lambda d: _percentiles(d, "rate", "rate", rates(d)),
    # A2 P7
    "rate_window": lambda d: f"SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({window(d, rates(d))}) w",
    "rate_outliers": lambda d: f"SELECT count(*) AS n, {d.when('rate < lo OR rate > hi')} AS outside FROM ({rates(d)}) m CROSS JOIN ({window(d, rates(d))}) w",
    # A8 P9
    "duration_histogram": _histogram,
    "duration_limits": lambda d: "SELECT " + ", ".join(f"{d.when(f'duration {op} {x}')} AS {n}" for op, x, n in ((">", 15, "over_15"), (">", 20, "over_20"), (">", 30, "over_30"), ("<", 2, "under_2"))) + f" FROM ({rates(d)}) m",
    # P5 P6 A10
    "tier_summary": lambda d: f"{_tier_row(d, 'tier_a')} UNION ALL {_tier_row(d, 'tier_b')}",
    "tier_rows": lambda d: f"SELECT idx, cluster, tier_a, tier_b FROM ({tiers(d, rates(d))}) t WHERE tier_a OR tier_b",
    # A3 O2
    "char_inventory": lambda d: f"""
        SELECT ch, count(*) AS n FROM (SELECT {'explode' if d.spark else 'unnest'}({d.chars("text")}) AS ch FROM {d.t('documents')}) c WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch""",
    # A4 A5
    "distinct_dup_texts": lambda d: f"SELECT count(*) AS n, count(DISTINCT {_digest}) AS distinct_texts, count(*) - count(DISTINCT {_digest}) AS duplicates FROM {d.t('documents')}",
    # O1
    "top_texts": lambda d: f"""
        SELECT trim(text) AS body, n, first_id FROM (
            SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_digest} AS digest FROM {d.t('documents')} WHERE text IS NOT NULL) t GROUP BY digest ORDER BY n DESC, first_id LIMIT 15) w
        JOIN {d.t('documents')} ON doc_id = first_id AND {_digest} = digest""",
    # P8 P9 P11
    "loader_filters": lambda d: f"SELECT idx, n_chars, duration FROM ({manifest(d)}) m WHERE body <> '' AND n_chars <= 4000 AND duration BETWEEN 0.8 AND 13 AND n_letters >= 4",
    "first_rows": lambda d: f"SELECT idx, n_chars FROM ({manifest(d)}) m ORDER BY idx LIMIT 100",
    # Operators that sample
    "systematic_sample": lambda d: f"SELECT l_orderkey, l_linenumber, l_quantity FROM {d.t('lineitem')} WHERE l_orderkey % 20 = 0",
    "hash_sample": lambda d: f"SELECT l_orderkey, l_linenumber FROM {d.t('lineitem')} ORDER BY (l_orderkey * 1103515245 + l_linenumber * 12345) % 2147483648, l_orderkey, l_linenumber LIMIT 500",
    # P14 U3
    "unsupported_chars": lambda d: f"""
        SELECT idx, n_bad FROM (SELECT doc_id AS idx, CAST(length({d.sub("coalesce(text, '')", "[ء-ی،؛؟!.:()«»\"'‌ \t\n-]", '')}) AS BIGINT) AS n_bad FROM {d.t('documents')}) b WHERE n_bad > 0""",
    # S1-S5
    "scan_select": lambda d: f"SELECT o_orderkey, o_totalprice FROM {d.t('orders')} WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "row_offsets": lambda d: f"""
        SELECT source, n, CAST(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS row_offset
        FROM (SELECT source, count(*) AS n FROM {d.t('documents')} GROUP BY source) s""",
    # A number for every row, dense within the table: rows before its source, rows of its source before its slot of ids, place in the slot
    "row_ids": lambda d: f"""
        SELECT doc_id, r.source AS source, CAST(n_before + k - 1 AS BIGINT) AS row_id FROM (
            SELECT doc_id, source, slot, row_number() OVER (PARTITION BY source, slot ORDER BY doc_id, md5(coalesce(text, ''))) AS k FROM (SELECT doc_id, source, text, doc_id % 1024 AS slot FROM {d.t('documents')}) s) r
        JOIN (SELECT source, slot, sum(n) OVER (ORDER BY source, slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS n_before
              FROM (SELECT source, doc_id % 1024 AS slot, count(*) AS n FROM {d.t('documents')} GROUP BY source, doc_id % 1024) c) o ON r.source = o.source AND r.slot = o.slot""",
    # S15
    "centre_crop": lambda d: f"""
        SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substring(text, CAST(floor((length(text) - 200) / 2) AS INT) + 1, 200) END AS crop FROM {d.t('documents')}""",
}

QUERIES, ORACLE = catalogue(TEXTS)


def text_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: percentiles, mean, least and largest of three measures of the manifest, which is computed once for all."""
    measures = ["duration", "n_chars", "rate"]
    report = column_report(spark.sql(manifest(Dialect(True, sf_dir, spark))), measures, [q / 100 for q in QUANTILES])
    names = [*(f"p{q}" for q in QUANTILES), "mean", "lowest", "highest"]
    rows = [(m, *(found or [None] * len(QUANTILES)), *rest) for m, (found, *rest) in report.items()]
    plain = spark.createDataFrame(rows, "measure string, " + ", ".join(f"{n} double" for n in names))
    return plain.select("measure", *(F.round(n, 4).alias(n) for n in names))


def audit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, mean duration and medians by shard, the medians without an aggregate that holds a shard."""
    # Texts are read once: the passes go over four columns, written where all executors see them.
    path = _folder(spark, "manifest")
    spark.sql(manifest(Dialect(True, sf_dir, spark))).select("shard", "duration", "rate", "mos").write.parquet(path)
    rows = spark.read.schema("shard string, duration double, rate double, mos double").parquet(path)
    plain = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.round(F.avg("duration"), 6).alias("mean_duration"))
    for name in ("rate", "mos"):
        median = grouped_quantiles(rows, "shard", name, [0.5]).withColumnRenamed("shard", "s")
        plain = plain.join(median, F.col("shard").eqNullSafe(F.col("s")), "left").withColumn(f"median_{name}", F.round(F.col("ps")[0], 6)).drop("s", "ps")
    return plain


QUERIES |= {"text_percentiles": text_percentiles, "audit_shards": audit_shards}
