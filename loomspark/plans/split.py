"""Joins, clusters and the speaker-disjoint split."""

from __future__ import annotations

from .audit import rates, tiers
from ..functions.dialect import Dialect, catalogue

EVAL_CLIPS, EVAL_SPEAKERS = 2000, 40
SIZE_LOW, SIZE_HIGH, LEAST_A = 10, 2000, 5


def _tiers(d: Dialect) -> str:
    return tiers(d, rates(d))


def eligible(d: Dialect) -> str:
    """Clusters of a size within bounds that hold enough clips of the best tier."""
    return f"SELECT cluster, count(*) AS n, {d.when('tier_a')} AS n_a FROM ({_tiers(d)}) t GROUP BY cluster HAVING count(*) BETWEEN {SIZE_LOW} AND {SIZE_HIGH} AND {d.when('tier_a')} >= {LEAST_A}"


def held_out(d: Dialect) -> str:
    """Eligible clusters in hash order, taken until the clips or the speakers suffice."""
    order = "(cluster * 1103515245 + 1234) % 2147483648, cluster"
    return f"""
        SELECT cluster, n_a FROM (
            SELECT cluster, n_a, sum(n_a) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_a AS taken, row_number() OVER (ORDER BY {order}) AS k
            FROM ({eligible(d)}) e) w WHERE taken < {EVAL_CLIPS} AND k <= {EVAL_SPEAKERS}"""


def _summary(d: Dialect, split: str, where: str) -> str:
    return f"SELECT '{split}' AS split, count(*) AS clips, round(sum(duration) / 3600, 6) AS hours, count(DISTINCT cluster) AS speakers, round({d.pct('mos', 0.5)}, 6) AS median_mos, round({d.pct('duration', 0.5)}, 6) AS median_duration FROM ({_tiers(d)}) t WHERE {where}"


_IN = "cluster IN (SELECT cluster FROM ({}) h)"

TEXTS = {
    # Dense sizes, with clusters of none
    "cluster_sizes": lambda d: f"""
        SELECT k.cluster, coalesce(n, 0) AS n FROM (SELECT {'explode' if d.spark else 'unnest'}({d.sequence('0', '(SELECT max(l_suppkey) + 2 FROM ' + d.t('lineitem') + ')')}) AS cluster) k
        LEFT JOIN (SELECT l_suppkey AS cluster, count(*) AS n FROM {d.t('lineitem')} GROUP BY l_suppkey) c ON k.cluster = c.cluster""",
    # A13 O3
    "cluster_report": lambda d: f"""
        SELECT cluster, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 6) AS pct, round(confidence, 6) AS confidence
        FROM (SELECT cluster, count(*) AS n, avg(mos) AS confidence FROM ({rates(d)}) r GROUP BY cluster) c ORDER BY n DESC, cluster LIMIT 60""",
    # W1 W2 O7
    "eligible_clusters": eligible,
    "shuffled_clusters": lambda d: f"SELECT cluster, CAST(row_number() OVER (ORDER BY (cluster * 1103515245 + 1234) % 2147483648, cluster) AS BIGINT) AS place FROM ({eligible(d)}) e",
    "holdout_speakers": held_out,
    # J5 J6 A11 A27
    "train_split": lambda d: f"SELECT idx, cluster FROM ({_tiers(d)}) t LEFT ANTI JOIN ({held_out(d)}) h ON t.cluster = h.cluster WHERE tier_a" if d.spark else f"SELECT idx, cluster FROM ({_tiers(d)}) t WHERE tier_a AND NOT {_IN.format(held_out(d))}",
    "eval_split": lambda d: f"SELECT idx, cluster FROM ({_tiers(d)}) t LEFT SEMI JOIN ({held_out(d)}) h ON t.cluster = h.cluster WHERE tier_a" if d.spark else f"SELECT idx, cluster FROM ({_tiers(d)}) t WHERE tier_a AND {_IN.format(held_out(d))}",
    "split_summary": lambda d: f"{_summary(d, 'train', 'tier_b AND NOT ' + _IN.format(held_out(d)))} UNION ALL {_summary(d, 'eval', 'tier_a AND ' + _IN.format(held_out(d)))}",
    "speaker_leak": lambda d: f"""
        SELECT count(*) AS leaked FROM (SELECT cluster FROM ({_tiers(d)}) t WHERE tier_a AND NOT {_IN.format(held_out(d))} INTERSECT SELECT cluster FROM ({held_out(d)}) h) x""",
    # J1 J2
    "manifest_align": lambda d: f"SELECT doc_id, n_chars, label FROM {d.t('documents')} JOIN {d.t('embeddings')} ON doc_id = vec_id",
    # J3
    "keep_semi": lambda d: f"SELECT doc_id, source FROM {d.t('documents')} WHERE doc_id IN (SELECT doc_id FROM {d.t('labels')} WHERE quality = 1)",
    # J4
    "speaker_join": lambda d: f"SELECT doc_id, n_chars, quality, label FROM {d.t('documents')} JOIN {d.t('labels')} USING (doc_id) JOIN {d.t('embeddings')} ON doc_id = vec_id WHERE toxic = 0",
    # J7
    "lexicon_lookup": lambda d: f"""
        SELECT n_nationkey, n_name, coalesce(readings, 0) AS readings FROM {d.t('nation')} LEFT JOIN (SELECT s_nationkey, count(*) AS readings FROM {d.t('supplier')} WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON n_nationkey = s_nationkey""",
    # Rate card
    "rate_card_cost": lambda d: f"""
        SELECT o_orderkey, flavor, round(minutes / 60.0 * usd, 6) AS cost FROM (SELECT o_orderkey, o_orderpriority AS flavor, CAST(o_orderkey % 600 AS DOUBLE) AS minutes FROM {d.t('orders')}) o
        JOIN (SELECT '1-URGENT' AS flavor, 0.8 AS usd UNION ALL SELECT '2-HIGH', 0.4 UNION ALL SELECT '3-MEDIUM', 0.03 UNION ALL SELECT '4-NOT SPECIFIED', 0.01 UNION ALL SELECT '5-LOW', 0.0) c USING (flavor)""",
    # U1 U2 U3 U4
    "word_class_union": lambda d: f"SELECT p_type AS w FROM {d.t('part')} WHERE p_size > 25 UNION SELECT c_mktsegment FROM {d.t('customer')}",
    "union_batches": lambda d: f"SELECT vec_id, label, 'even' AS part FROM {d.t('embeddings')} WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label, 'odd' FROM {d.t('embeddings')} WHERE vec_id % 2 = 1",
    "unknown_sources": lambda d: f"SELECT DISTINCT source FROM {d.t('documents')} EXCEPT SELECT source FROM {d.t('documents')} WHERE lang = 'es' AND n_chars > 4000",
    # A21
    "variance_ratio": lambda d: f"""
        SELECT round(between_var / within_var, 9) AS ratio FROM (
            SELECT sum(n * (m - g) * (m - g)) / sum(n) AS between_var, sum(n * v) / sum(n) AS within_var FROM (
                SELECT cluster, count(*) AS n, avg(rate) AS m, var_pop(rate) AS v FROM ({rates(d)}) r GROUP BY cluster) c CROSS JOIN (SELECT avg(rate) AS g FROM ({rates(d)}) r2) t) z""",
    # A14
    "threshold_sweep": lambda d: f"""
        SELECT threshold, count(*) AS clusters, round(CAST(100 AS DOUBLE) * max(n) / sum(n), 4) AS largest_pct, {d.when('CAST(100 AS DOUBLE) * n > total')} AS over_one_pct
        FROM (SELECT threshold, bucket, count(*) AS n, sum(count(*)) OVER (PARTITION BY threshold) AS total
              FROM (SELECT threshold, floor(rate / threshold) AS bucket FROM ({rates(d)}) r CROSS JOIN {d.each(d.array(50, 100, 200, 400), 'threshold')} s) b GROUP BY threshold, bucket) g GROUP BY threshold""",
}

QUERIES, ORACLE = catalogue(TEXTS)
