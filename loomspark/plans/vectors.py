"""Vectors: unit length, cosine pairs, centroids, nearest centroid, neighbourhoods, separation.

Pair statistics are defined on a subsample without replacement: ``SAMPLE_ROWS`` vectors in the order of
a hash of the id (all of them where there are fewer), so pairs do not grow with the table.
"""

from __future__ import annotations

import uuid

from ..functions.dialect import Dialect, catalogue
from ..operators.clustering import upper_pairs

SAMPLE_ROWS = 6000
RADIUS = 0.3
#: A neighbourhood of fewer vectors is no core (30 is usual; the small tables have none so dense).
LEAST_CORE = 5


def sample(d: Dialect) -> str:
    return f"SELECT vec_id, embedding, label FROM {d.t('embeddings')} ORDER BY (vec_id * 1103515245 + 12345) % 2147483648, vec_id LIMIT {SAMPLE_ROWS}"


def pairs(d: Dialect) -> str:
    """Upper-triangle cosines of the sample; the vectors are unit length."""
    if d.session is not None:
        if "pairs" not in d.fits:
            d.fits["pairs"] = f"loomspark_pairs_{uuid.uuid4().hex}"
            upper_pairs(d.session.sql(sample(d)), SAMPLE_ROWS).createOrReplaceTempView(d.fits["pairs"])
        return f"SELECT * FROM {d.fits['pairs']}"
    return f"SELECT a.vec_id AS u, b.vec_id AS v, a.label AS la, b.label AS lb, {d.dot('a.embedding', 'b.embedding')} AS cosine FROM ({sample(d)}) a JOIN ({sample(d)}) b ON a.vec_id < b.vec_id"


def _cuts(d: Dialect, qs) -> str:
    """One row: ps, the percentiles of the sample's cosines."""
    fitted = d.fitted(pairs(d), "cosine", qs)
    return f"SELECT {fitted} AS ps" if fitted else f"SELECT {d.pcts('cosine', qs)} AS ps FROM ({pairs(d)}) p"


def components(d: Dialect) -> str:
    """label, pos (from 0), x: one row per component."""
    if d.spark:
        return f"SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {d.t('embeddings')} LATERAL VIEW posexplode(embedding) e AS pos, x"
    return "SELECT vec_id, label, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) s(pos)"


def centroids(d: Dialect) -> str:
    """label, c: the L2-normalised mean vector of each label."""
    mean = f"SELECT label, pos, avg(x) AS m FROM ({components(d)}) x GROUP BY label, pos"
    if d.spark:
        ordered = f"SELECT label, transform(array_sort(collect_list(struct(pos, m))), s -> s.m) AS c FROM ({mean}) m GROUP BY label"
        return f"SELECT label, transform(c, x -> x / (sqrt({d.dot('c', 'c')}) + 1e-9)) AS c FROM ({ordered}) o"
    ordered = f"SELECT label, list(m ORDER BY pos) AS c FROM ({mean}) m GROUP BY label"
    return f"SELECT label, list_transform(c, lambda x: x / (sqrt(n) + 1e-9)) AS c FROM (SELECT label, c, {d.dot('c', 'c')} AS n FROM ({ordered}) o) p"


def whole_centroid(d: Dialect) -> str:
    """c: the L2-normalised mean of all vectors, one row."""
    mean = f"SELECT pos, avg(x) AS m FROM ({components(d)}) x GROUP BY pos"
    if d.spark:
        return f"SELECT transform(c, x -> x / (sqrt({d.dot('c', 'c')}) + 1e-9)) AS c FROM (SELECT transform(array_sort(collect_list(struct(pos, m))), s -> s.m) AS c FROM ({mean}) m) o"
    return f"SELECT list_transform(c, lambda x: x / (sqrt(n) + 1e-9)) AS c FROM (SELECT c, {d.dot('c', 'c')} AS n FROM (SELECT list(m ORDER BY pos) AS c FROM ({mean}) m) o) p"


def rates(d: Dialect) -> str:
    """vec_id, rate: letters a word of the vector's document, a trait that the vectors have not seen."""
    words = f"(length(text) - length(replace(text, ' ', '')) + 1)"
    return f"SELECT vec_id, CAST(length(text) AS DOUBLE) / {words} AS rate FROM {d.t('embeddings')} JOIN {d.t('documents')} ON vec_id = doc_id"


def core(d: Dialect) -> str:
    """spot, radius: the neighbours of the vector that has most within the radius, the 99.5th percentile of the pairs."""
    near = f"SELECT u, v, radius FROM ({pairs(d)}) p CROSS JOIN (SELECT {d.at('ps', '1')} AS radius FROM ({_cuts(d, (0.995,))}) c) r WHERE cosine > radius"
    both = f"SELECT u AS seed, v AS spot, radius FROM ({near}) n UNION ALL SELECT v, u, radius FROM ({near}) m"
    return f"SELECT spot, radius FROM ({both}) b JOIN (SELECT seed FROM (SELECT seed, count(*) AS n FROM ({both}) b2 GROUP BY seed) g ORDER BY n DESC, seed LIMIT 1) s USING (seed)"


def _spread(d: Dialect) -> str:
    """iqr_all: the interquartile range of all rates."""
    fitted = d.fitted(rates(d), "rate", (0.25, 0.75))
    return f"SELECT ({fitted})[1] - ({fitted})[0] AS iqr_all" if fitted else f"SELECT {d.pct('rate', 0.75)} - {d.pct('rate', 0.25)} AS iqr_all FROM ({rates(d)}) r"


def scores(d: Dialect) -> str:
    return f"SELECT e.vec_id, e.label AS own, c.label, {d.dot('e.embedding', 'c.c')} AS cosine FROM {d.t('embeddings')} e CROSS JOIN ({centroids(d)}) c"


TEXTS = {
    # C1
    "unit_vectors": lambda d: f"SELECT vec_id, round(sqrt({d.dot('embedding', 'embedding')}), 5) AS norm FROM {d.t('embeddings')}",
    # J8 C2
    "cosine_pairs": lambda d: f"SELECT u, v, round(cosine, 6) AS cosine FROM ({pairs(d)}) p",
    # A15 A16
    "pair_percentiles": lambda d: "SELECT " + ", ".join(f"round({d.at('ps', str(i + 1))}, 6) AS p{q}" for i, q in enumerate((1, 5, 25, 50, 75, 95, 99))) + f" FROM ({_cuts(d, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))}) s",
    "derived_thresholds": lambda d: f"""
        SELECT DISTINCT round(1 - x, 3) AS threshold FROM (
            SELECT {'explode' if d.spark else 'unnest'}(ps) AS x FROM ({_cuts(d, (0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995))}) s) t""",
    # A17
    "centroids": lambda d: f"SELECT label, round({d.dot('c', 'c')}, 6) AS norm, round({d.at('c', '1')}, 6) AS first_x, round({d.at('c', '64')}, 6) AS last_x FROM ({centroids(d)}) k",
    # A18
    "centroid_cosine": lambda d: f"SELECT label, round(avg(cosine), 6) AS mean_cosine, count(*) AS n FROM ({scores(d)}) s WHERE own = label GROUP BY label",
    # J9 C4 O4
    "nearest_centroid": lambda d: f"""
        SELECT vec_id, best.label AS label, round(best.cosine, 6) AS confidence
        FROM (SELECT vec_id, max({'named_struct(' + "'cosine', cosine, 'last', -label, 'label', label)" if d.spark else "{'cosine': cosine, 'last': -label, 'label': label}"}) AS best FROM ({scores(d)}) s GROUP BY vec_id) r""",
    # J10 O4
    "neighbour_counts": lambda d: f"""
        SELECT vec_id, count(spot) AS n FROM ({sample(d)}) s LEFT JOIN (
            SELECT {'explode' if d.spark else 'unnest'}({d.array('u', 'v')}) AS spot FROM ({pairs(d)}) p WHERE cosine > {RADIUS}) e ON vec_id = spot GROUP BY vec_id""",
    # Rates within the densest neighbourhood against all
    "core_tightening": lambda d: f"""
        SELECT round(radius, 4) AS radius, n, round(iqr_core, 6) AS iqr_core, round(iqr_all, 6) AS iqr_all, round(100 * (1 - iqr_core / iqr_all), 4) AS tightening
        FROM (SELECT count(*) AS n, max(radius) AS radius, CASE WHEN count(*) >= {LEAST_CORE} THEN {d.pct('rate', 0.75)} - {d.pct('rate', 0.25)} END AS iqr_core FROM ({core(d)}) c JOIN ({rates(d)}) r ON spot = vec_id) x
        CROSS JOIN ({_spread(d)}) y""",
    # How far the cloud spreads, pairs within and between labels, and percentiles of pairs
    "separation_report": lambda d: f"""
        SELECT round(within_mean, 6) AS within_mean, round(between_mean, 6) AS between_mean, n, dim, round(spread, 6) AS centroid_cosine, {", ".join(f"round({d.at('ps', str(i + 1))}, 6) AS p{q}" for i, q in enumerate((1, 5, 25, 50, 75, 95)))}
        FROM (SELECT avg(CASE WHEN la = lb THEN cosine END) AS within_mean, avg(CASE WHEN la <> lb THEN cosine END) AS between_mean, count(*) AS n FROM ({pairs(d)}) p) a
        CROSS JOIN (SELECT avg({d.dot('e.embedding', 'm.c')}) AS spread, max({d.size('e.embedding')}) AS dim FROM {d.t('embeddings')} e CROSS JOIN ({whole_centroid(d)}) m) b
        CROSS JOIN ({_cuts(d, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95))}) s""",
}

QUERIES, ORACLE = catalogue(TEXTS)
