"""Ordered metric streams: windows, streaks, guards, budgets, schedules.

``events`` is the stream: event_type names the metric and (ts, event_id) orders it. A value whose
event id is divisible by 97 stands for a non-finite one.
"""

from __future__ import annotations

from ..functions.dialect import Dialect, catalogue
from ..functions.persian import timeout_minutes
from ..streaming.guard import Rules

LOG_EVERY = 50
USD_PER_HOUR, CEILING = 0.8, 100.0
HALTS = (("click", 0, ">", 99.0), ("error", 100, ">", 95.0), ("view", 200, "<", 0.5))


def steps(d: Dialect) -> str:
    """metric, step (from 1), value (null where not finite), bad, bad_rank (bad rows up to here).

    Ranks are taken within an hour and shifted by prefix counts of the hours before, so that no metric,
    however long, is ranked by one task.
    """
    base = f"SELECT event_type AS metric, event_id, ts, date_trunc('hour', ts) AS slot, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value, event_id % 97 = 0 OR event_id % 89 = 1 AS bad FROM {d.t('events')}"
    one = "CASE WHEN bad THEN 1 ELSE 0 END"
    before = "OVER (PARTITION BY metric ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    slots = f"SELECT metric, slot, sum(n) {before} - n AS n_before, sum(n_bad) {before} - n_bad AS bad_before FROM (SELECT metric, slot, count(*) AS n, sum({one}) AS n_bad FROM ({base}) b GROUP BY metric, slot) c"
    within = "OVER (PARTITION BY metric, slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
        SELECT r.metric, {d.long('n_before + k')} AS step, event_id, value, bad, {d.long('bad_before + k_bad')} AS bad_rank
        FROM (SELECT *, count(*) {within} AS k, sum({one}) {within} AS k_bad FROM ({base}) b) r JOIN ({slots}) s ON r.metric = s.metric AND r.slot = s.slot"""


def _violations(d: Dialect) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS rule, metric, step, value FROM ({steps(d)}) s WHERE metric = '{m}' AND step > {warm} AND value {op} {bound}" for k, (m, warm, op, bound) in enumerate(HALTS))


#: The guard of a user's own stream: an error is a gradient norm, non-finite where its event id is even.
GUARD = Rules(warm_up=3, patience=1, watched="error", targets={"view": [6, 80.0]}, floors={"click": 4.0}, ceilings={"error": 90.0})


def _guard(d: Dialect) -> str:
    """user_id, step, reason of each user's first halt: streaks as islands of steps, bounds as rows, the least of both."""
    base = f"SELECT user_id, event_id, ts, event_type, value, date_trunc('day', ts) AS slot, event_type = '{GUARD.watched}' AND event_id % 2 = 0 AS bad FROM {d.t('events')}"
    one = "CASE WHEN bad THEN 1 ELSE 0 END"
    before = "OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    slots = f"SELECT user_id, slot, sum(n) {before} - n AS n_before, sum(n_bad) {before} - n_bad AS bad_before FROM (SELECT user_id, slot, count(*) AS n, sum({one}) AS n_bad FROM ({base}) b GROUP BY user_id, slot) c"
    within = "OVER (PARTITION BY user_id, slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    steps = f"""SELECT r.user_id, {d.long('n_before + k')} AS step, event_type, value, bad, {d.long('bad_before + k_bad')} AS bad_rank
        FROM (SELECT *, count(*) {within} AS k, sum({one}) {within} AS k_bad FROM ({base}) b) r JOIN ({slots}) s ON r.user_id = s.user_id AND r.slot = s.slot"""
    streaks = f"SELECT user_id, min(step) + {GUARD.patience} AS step, 0 AS place FROM ({steps}) s WHERE bad GROUP BY user_id, step - bad_rank HAVING count(*) > {GUARD.patience}"
    bounds = " UNION ALL ".join(
        f"SELECT user_id, step, {k} AS place FROM ({steps}) s WHERE NOT bad AND event_type = '{m}' AND step >= {max(since, GUARD.warm_up)} AND value {'>' if side == 'above' else '<'} {bound}"
        for k, (m, since, side, bound) in enumerate(GUARD.bounds(), 1)
    )
    reasons = " ".join(f"WHEN {k} THEN '{m} {side} {bound}'" for k, (m, since, side, bound) in enumerate(GUARD.bounds(), 1))
    return f"""
        SELECT user_id, {d.long('floor(code / CAST(8 AS DOUBLE))')} AS step, CASE code % 8 WHEN 0 THEN 'non-finite for {GUARD.patience + 1} steps' {reasons} END AS reason
        FROM (SELECT user_id, min(step * 8 + place) AS code FROM ({streaks} UNION ALL {bounds}) v GROUP BY user_id) f"""


TEXTS = {
    # The whole guard, per user
    "metric_guard": _guard,
    # The trailing partial block is dropped
    "metric_windows": lambda d: f"""
        SELECT metric, {d.long(f'floor((step - 1) / CAST({LOG_EVERY} AS DOUBLE))')} AS block, round(avg(value), 6) AS mean, count(value) AS finite FROM ({steps(d)}) s
        GROUP BY metric, {d.long(f'floor((step - 1) / CAST({LOG_EVERY} AS DOUBLE))')} HAVING count(*) = {LOG_EVERY}""",
    # W3
    "nonfinite_streak": lambda d: f"""
        SELECT metric, max(n) AS longest, count(*) AS islands FROM (
            SELECT metric, step - bad_rank AS island, count(*) AS n FROM ({steps(d)}) s WHERE bad GROUP BY metric, step - bad_rank) g GROUP BY metric""",
    # The first violation wins; within a step, rule order
    "guard_first_trip": lambda d: f"SELECT rule, metric, step, value FROM ({_violations(d)}) v ORDER BY step, rule LIMIT 1",
    # M3
    "finite_metrics": lambda d: f"SELECT metric, count(value) AS n, round(avg(value), 6) AS mean FROM ({steps(d)}) s GROUP BY metric",
    # M1 W7
    "budget_crossing": lambda d: f"""
        SELECT min(event_id) AS halted_at, count(*) AS after FROM (
            SELECT event_id, (hours_before + sum(value) OVER (PARTITION BY e.slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 3600 * {USD_PER_HOUR} AS spent
            FROM (SELECT event_id, ts, value, date_trunc('hour', ts) AS slot FROM {d.t('events')}) e
            JOIN (SELECT slot, sum(v) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - v AS hours_before
                  FROM (SELECT date_trunc('hour', ts) AS slot, sum(value) AS v FROM {d.t('events')} GROUP BY date_trunc('hour', ts)) h) b ON e.slot = b.slot) r WHERE spent >= {CEILING}""",
    # M12
    "budget_report": lambda d: f"""
        SELECT event_type, round(sum(value) / 3600, 6) AS hours, round(sum(value) / 3600 * {USD_PER_HOUR}, 6) AS spent,
               CASE WHEN event_type = 'view' THEN NULL ELSE round(greatest(0, 20 - sum(value) / 3600 * {USD_PER_HOUR}), 6) END AS remaining FROM {d.t('events')} GROUP BY event_type""",
    # M6: a run without a second event has no end, so no cost
    "job_cost": lambda d: f"""
        SELECT user_id, CASE WHEN n < 2 THEN NULL ELSE round((stop - start) / CAST(3600000000 AS DOUBLE) * {USD_PER_HOUR}, 6) END AS cost
        FROM (SELECT user_id, count(*) AS n, {d.micros('min(ts)')} AS start, {d.micros('max(ts)')} AS stop FROM {d.t('events')} GROUP BY user_id) e""",
    # M7: the time limit at the rate of the machine
    "worst_case_cost": lambda d: f"""
        SELECT flavor, round({timeout_minutes(d, 'time_limit')} / 60 * usd, 6) AS worst FROM (SELECT * FROM (VALUES ('cpu', '30m', CAST(0.03 AS DOUBLE)), ('l4', '2h', CAST(0.8 AS DOUBLE)), ('a100', '1d', CAST(2.5 AS DOUBLE)), ('t4', '90', CAST(0.4 AS DOUBLE))) v(flavor, time_limit, usd)) c""",
    # M5
    "lr_schedule": lambda d: f"SELECT o_orderkey AS step, round(0.0002 * power(0.999875, o_orderkey), 12) AS lr, round(greatest(CAST(0 AS DOUBLE), 0.01 - 0.000002 * o_orderkey), 9) AS noise FROM {d.t('orders')}",
    # M4: entropy of the distribution of event types, per user, over log n
    "alignment_entropy": lambda d: f"""
        SELECT user_id, round(-sum(p * ln(p + 1e-8)) / ln(5), 6) AS entropy FROM (
            SELECT user_id, event_type, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM {d.t('events')} GROUP BY user_id, event_type) x GROUP BY user_id""",
    # O5 M10
    "latest_checkpoint": lambda d: f"""
        SELECT name, {d.long(d.extract('name', 'step_([0-9]+)', 1))} AS step FROM (SELECT concat('step_', CAST(o_orderkey * 7 % 4099 AS VARCHAR(20)), '.pth') AS name FROM {d.t('orders')}) n ORDER BY step DESC LIMIT 1""",
    # M11
    "history_tail": lambda d: f"SELECT event_id, value FROM {d.t('events')} ORDER BY ts DESC, event_id DESC LIMIT 500",
    # W5
    "look_around": lambda d: f"""
        SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS next_1, lead(role, 2) OVER w AS next_2 FROM {d.t('conversations')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    # The JSON column of the stream
    "json_props": lambda d: f"SELECT event_id, {d.long('get_json_object(props, ' + chr(39) + '$.k' + chr(39) + ')' if d.spark else 'json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')')} AS k FROM {d.t('events')}",
}

QUERIES, ORACLE = catalogue(TEXTS)
