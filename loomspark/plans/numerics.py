"""Closed-form numerics: mel scale and filters, losses, masks, length regulation, bins."""

from __future__ import annotations

from ..functions.dialect import Dialect, catalogue

# Slaney's scale: linear below 1000 Hz, logarithmic above.
STEP, KNEE, KNEE_MEL, LOG_STEP = 200.0 / 3, 1000.0, 15.0, 0.06875177742094912


def mel(f: str) -> str:
    return f"(CASE WHEN {f} >= {KNEE} THEN {KNEE_MEL} + ln({f} / {KNEE}) / {LOG_STEP} ELSE {f} / {STEP} END)"


def hertz(m: str) -> str:
    return f"(CASE WHEN {m} >= {KNEE_MEL} THEN {KNEE} * exp({LOG_STEP} * ({m} - {KNEE_MEL})) ELSE {STEP} * {m} END)"


def _number(d: Dialect, low: int, high: int, name: str) -> str:
    return d.each(d.sequence(str(low), str(high)), name)


def filterbank(d: Dialect, rate: int = 22050, n_fft: int = 1024, bands: int = 20) -> str:
    """band, bin, weight: triangles between mel-spaced edges, of unit area."""
    top = mel(f"CAST({rate / 2} AS DOUBLE)")
    edge = lambda k: hertz(f"({top} * ({k}) / {bands + 1})")
    return f"""
        SELECT band, bin, greatest(CAST(0 AS DOUBLE), least((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) AS weight FROM (
            SELECT band, bin, bin * {rate / n_fft} AS f, {edge('band')} AS lo, {edge('band + 1')} AS mid, {edge('band + 2')} AS hi
            FROM {_number(d, 0, bands - 1, 'band')} b CROSS JOIN {_number(d, 0, n_fft // 2, 'bin')} k) x"""


def _durations(d: Dialect) -> str:
    return f"""
        SELECT l_orderkey, l_linenumber, l_quantity AS frames, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM {d.t('lineitem')}"""


TEXTS = {
    # X1
    "mel_scale": lambda d: f"SELECT p_partkey, round({mel('(p_retailprice * 4)')}, 6) AS mel, round({hertz(mel('(p_retailprice * 4)'))}, 4) AS hz FROM {d.t('part')}",
    # X2
    "mel_filterbank": lambda d: f"SELECT CAST(band AS BIGINT) AS band, CAST(bin AS BIGINT) AS bin, round(weight, 9) AS weight FROM ({filterbank(d)}) w WHERE weight > 0",
    # X3
    "log_compress": lambda d: f"SELECT l_orderkey, l_linenumber, round(ln(greatest(l_discount, 0.00001)), 6) AS logged, round(exp(ln(greatest(l_discount, 0.00001))), 9) AS back FROM {d.t('lineitem')}",
    # Spans of frames from durations
    "length_regulation": lambda d: f"SELECT l_orderkey, CAST(place AS BIGINT) AS place, upto - frames AS from_frame, upto AS to_frame FROM ({_durations(d)}) s",
    # X7
    "lsgan_loss": lambda d: f"""
        SELECT event_type, round(avg((1 - x) * (1 - x)) + avg(y * y), 6) AS discriminator, round(avg((1 - y) * (1 - y)), 6) AS generator, round(avg(abs(x - y)), 6) AS feature,
               round(sum(CASE WHEN event_id % 3 > 0 THEN x * y END) / count(CASE WHEN event_id % 3 > 0 THEN 1 END), 6) AS masked
        FROM (SELECT event_type, event_id, value / 100 AS x, (event_id % 10) / CAST(10 AS DOUBLE) AS y FROM {d.t('events')}) v GROUP BY event_type""",
    # Divergence of a posterior from a prior, at a sample, over the frames of a mask
    "kl_loss": lambda d: f"""
        SELECT user_id, round(sum(CASE WHEN event_id % 5 > 0 THEN logs_p - logs_q - 0.5 + 0.5 * (z - m) * (z - m) * exp(-2 * logs_p) END) / count(CASE WHEN event_id % 5 > 0 THEN 1 END), 6) AS kl
        FROM (SELECT user_id, event_id, value / 100 AS z, CAST(event_id % 10 AS DOUBLE) / 10 AS m, -CAST(event_id % 7 AS DOUBLE) / 7 AS logs_q, CAST(event_id % 3 AS DOUBLE) / 3 AS logs_p FROM {d.t('events')}) v GROUP BY user_id""",
    # X5 X6 X9
    "length_masks": lambda d: f"""
        SELECT n_nationkey, {d.join(d.map(d.sequence('1', '8'), 'k', "CASE WHEN k <= n_nationkey % 9 THEN '1' ELSE '0' END"), '')} AS mask, CAST(floor(n_nationkey * 37 / CAST(16 AS DOUBLE)) * 16 AS BIGINT) AS trimmed,
               substring(n_name, 2, 4) AS segment FROM {d.t('nation')}""",
    # X10
    "grad_norm": lambda d: f"SELECT l_suppkey, round(sqrt(sum(l_discount * l_discount)), 6) AS norm, round(least(CAST(1 AS DOUBLE), 1 / sqrt(sum(l_discount * l_discount))), 6) AS factor FROM {d.t('lineitem')} GROUP BY l_suppkey",
    # X11
    "bin_lookup": lambda d: f"SELECT l_orderkey, l_linenumber, {d.size(d.keep(d.array(0, 5, 10, 20, 30, 45), 'e', 'l_quantity >= e'))} - 1 AS bin FROM {d.t('lineitem')}",
}

QUERIES, ORACLE = catalogue(TEXTS)
