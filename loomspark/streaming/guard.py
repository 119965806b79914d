"""Guards over a stream of metric records: each rule fires once, on its first violation in step order.

Batch and stream share ``GuardState``. In a stream the state of a run (one key) is a few numbers;
records of one micro-batch are ordered by step before they are applied.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Rules:
    """Bounds on metrics. A missing or non-finite value is not judged by them.

    ``targets``: metric -> [step, most], from that step on; ``floors`` and ``ceilings``: metric -> bound, at
    every step. They are tried in this order, and none before ``warm_up``. ``watched`` is the metric
    whose non-finite values in a row are borne up to ``patience`` times, from the first step on.
    """

    warm_up: int = 0
    patience: int = 3
    watched: str = "grad_norm"
    targets: dict = field(default_factory=dict)
    floors: dict = field(default_factory=dict)
    ceilings: dict = field(default_factory=dict)
    usd_per_hour: float = 0.0
    budget: float | None = None

    def bounds(self) -> list[tuple[str, int, str, float]]:
        """metric, step from which it is judged, side on which it must not be, bound: in order of trial."""
        return (
            [(m, since, "above", most) for m, (since, most) in self.targets.items()]
            + [(m, self.warm_up, "below", least) for m, least in self.floors.items()]
            + [(m, self.warm_up, "above", most) for m, most in self.ceilings.items()]
        )


@dataclass
class GuardState:
    streak: int = 0
    fired: str | None = None

    def apply(self, rules: Rules, step: int, metrics: dict, hours: float = 0.0) -> str | None:
        """The reason to halt, once; later records are silent."""
        if self.fired is None:
            self.fired = self._judge(rules, step, metrics, hours)
            return self.fired
        return None

    def _judge(self, rules: Rules, step: int, metrics: dict, hours: float) -> str | None:
        if rules.budget is not None and hours * rules.usd_per_hour >= rules.budget:
            return "budget"
        watched = metrics.get(rules.watched)
        self.streak = self.streak + 1 if watched is not None and not math.isfinite(watched) else 0
        if self.streak:  # such a step says nothing about other metrics
            return f"non-finite for {self.streak} steps" if self.streak > rules.patience else None
        for metric, since, side, bound in rules.bounds() if step >= rules.warm_up else ():
            value = metrics.get(metric)
            if step >= since and value is not None and math.isfinite(value) and (value > bound if side == "above" else value < bound):
                return f"{metric} {side} {bound}"
        return None


def guard_stream(records: DataFrame, rules: Rules, key: str = "run") -> DataFrame:
    """run, step, reason from a (streaming) frame of run, step, hours and metrics (map of string to double)."""
    plain = json.dumps(asdict(rules))

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = GuardState(*state.get) if state.exists else GuardState()
        own = Rules(**json.loads(plain))
        out = []
        rows = pd.concat(list(parts)).sort_values("step", kind="stable")
        for r in rows.itertuples(index=False):
            reason = held.apply(own, int(r.step), dict(r.metrics), float(r.hours))
            if reason:
                out.append((group[0], int(r.step), reason))
        state.update((held.streak, held.fired))
        yield pd.DataFrame(out, columns=["run", "step", "reason"])

    return records.groupBy(key).applyInPandasWithState(run, "run string, step long, reason string", "streak int, fired string", "append", GroupStateTimeout.NoTimeout)


def windowed_means(records: DataFrame, every: int, key: str = "metric") -> DataFrame:
    """Mean of each whole block of ``every`` steps; an unfinished block is left out."""
    block = F.floor((F.col("step") - 1) / every).alias("block")
    return records.groupBy(key, block).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == every).drop("n")
