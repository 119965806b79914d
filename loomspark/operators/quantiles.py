"""Exact interpolated quantiles that no single task has to sort.

The built-in exact percentile keeps every distinct value in one aggregate. Here a sketch brackets
each wanted rank, one pass counts the rows under every bracket, and brackets shrink by further
sketches until few rows are left in each; those rows alone are ordered. What reaches the driver is
bounded by ``SETTLED`` rows a quantile, whatever the input holds.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bracket that are ordered outright.
SETTLED = 20_000
ERROR = 1e-3


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float]) -> list[float] | None:
    """Linear interpolation between order statistics; nulls are skipped; None for no rows.

    Four passes serve all quantiles whose brackets hold at most ``SETTLED`` rows; others go on alone.
    """
    # The column alone is kept over the passes: what computes it can cost far more than reading it again.
    values = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _all(values, quantiles)
    finally:
        values.unpersist()


def column_report(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, tuple[list[float] | None, float, float, float]]:
    """Exact quantiles, mean, least and largest value of several columns, whose rows are computed once."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        plain = held.agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]).first()
        return {c: (_all(held.select(F.col(c).alias("x")).filter("x IS NOT NULL"), quantiles), plain[f"mean_{c}"], plain[f"least_{c}"], plain[f"most_{c}"]) for c in columns}
    finally:
        held.unpersist()


def _all(values: DataFrame, quantiles: list[float]) -> list[float] | None:
    total = values.count()
    if not total:
        return None
    places = [(total - 1) * q for q in quantiles]
    if total <= SETTLED:
        return _settle(values, 0, places)
    asked = [p for q in quantiles for p in (max(0.0, q - 2 * ERROR), min(1.0, q + 2 * ERROR))]
    cuts = values.agg(F.percentile_approx("x", asked, int(1 / ERROR)).alias("p")).first().p
    brackets = list(zip(cuts[::2], cuts[1::2]))
    inside = [F.col("x").between(low, high) for low, high in brackets]
    counts = values.agg(*[F.count_if(F.col("x") < low).alias(f"b{i}") for i, (low, _) in enumerate(brackets)], *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)]).first()
    small = [i for i, p in enumerate(places) if counts[f"n{i}"] <= SETTLED and counts[f"b{i}"] <= math.floor(p) and min(math.floor(p) + 1, total - 1) < counts[f"b{i}"] + counts[f"n{i}"]]
    held = sorted(r.x for r in values.filter(reduce(or_, [inside[i] for i in small])).collect()) if small else []
    out = []
    for i, (q, place) in enumerate(zip(quantiles, places)):
        if i not in small:
            out.append(_one(values, total, q))
            continue
        first = bisect_left(held, brackets[i][0]) + math.floor(place) - counts[f"b{i}"]
        low, high = held[first], held[min(first + 1, len(held) - 1)]
        out.append(low + (high - low) * (place - math.floor(place)))
    return out


def _settle(rows: DataFrame, below: int, places: list[float]) -> list[float]:
    held = [r.x for r in rows.orderBy("x").collect()]
    out = []
    for place in places:
        k = math.floor(place)
        low, high = held[k - below], held[min(k + 1 - below, len(held) - 1)]
        out.append(low + (high - low) * (place - k))
    return out


def _one(values: DataFrame, total: int, q: float) -> float:
    place = (total - 1) * q
    first, last = math.floor(place), min(math.floor(place) + 1, total - 1)
    rows, below, size = values, 0, total
    while size > SETTLED:
        at = (first - below) / size
        low, high = rows.agg(F.percentile_approx("x", [max(0.0, at - 2 * ERROR), min(1.0, at + 2 * ERROR)], int(1 / ERROR)).alias("p")).first().p
        part = values.filter((F.col("x") >= low) & (F.col("x") <= high))
        count = values.agg(F.count_if(F.col("x") < low).alias("below"), F.count_if((F.col("x") >= low) & (F.col("x") <= high)).alias("size")).first()
        if low == high and count["below"] <= first and last < count["below"] + count["size"]:
            return low  # one value holds both places
        if not (count["below"] <= first and last < count["below"] + count["size"]) or count["size"] == size:
            # The sketch's bracket missed, or ties leave nothing to shed: ordered distinct values with counts.
            return _by_counts(rows, below, place)
        rows, below, size = part, count["below"], count["size"]
    return _settle(rows, below, [place])[0]


def _by_counts(rows: DataFrame, below: int, place: float) -> float:
    """Through counts of distinct values, in range order."""
    counts = rows.groupBy("x").count()
    found, seen, k = [], below, math.floor(place)
    for r in counts.orderBy("x").toLocalIterator():
        seen += r["count"]
        while len(found) < 2 and seen > k + len(found):
            found.append(r.x)
        if len(found) == 2:
            break
    low, high = found[0], found[-1]
    return low + (high - low) * (place - k)


def _by_group(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of the same ``g``; null is a group like others."""
    return one.join(two.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).drop("h")


def grouped_quantiles(df: DataFrame, group: str, column: str, quantiles: list[float], out: str = "ps") -> DataFrame:
    """``group`` and an array of exact interpolated quantiles of each group; nulls are skipped, groups without a value go.

    A sketch of each group brackets the wanted ranks, counts tell what stands below, and only values
    within the brackets are put in order, each distinct one once. No aggregate holds a group's values.
    """
    spans = range(len(quantiles))
    values = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    asked = [p for q in quantiles for p in (max(0.0, q - 2 * ERROR), min(1.0, q + 2 * ERROR))]
    cuts = values.groupBy("g").agg(F.percentile_approx("x", asked, int(1 / ERROR)).alias("c"))
    met = _by_group(values, cuts)
    low, high = (lambda k: F.col("c")[2 * k]), (lambda k: F.col("c")[2 * k + 1])
    x = F.col("x")
    counts = met.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(x < low(k)).alias(f"below{k}") for k in spans],
        *[F.max(F.when(x < low(k), x)).alias(f"prior{k}") for k in spans],
        *[F.min(F.when(x > high(k), x)).alias(f"next{k}") for k in spans],
    )
    # k, x and how often x stands in the k-th bracket; then the place of its last row from the bracket's first.
    inside = met.select("g", "x", F.explode(F.filter(F.array(*[F.when(x.between(low(k), high(k)), k) for k in spans]), lambda k: k.isNotNull())).alias("k"))
    upto = F.sum("m").over(Window.partitionBy("g", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.groupBy("g", "k", "x").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", upto)
    need = counts.select("g", *[F.struct(F.floor((F.col("n") - 1) * q).alias("first"), F.least(F.floor((F.col("n") - 1) * q) + 1, F.col("n") - 1).alias("second"), F.col(f"below{k}").alias("below")).alias(f"p{k}") for k, q in zip(spans, quantiles)])
    at = lambda k, side: F.min(F.when((F.col("k") == k) & (F.col("upto") > F.col(f"p{k}.{side}") - F.col(f"p{k}.below")), F.col("x"))).alias(f"{side}{k}")
    found = _by_group(ranked, need).groupBy("g").agg(*[at(k, side) for k in spans for side in ("first", "second")])
    both = _by_group(counts, found)

    def value(k: int, q: float):
        place = (F.col("n") - 1) * q
        first = F.when(F.floor(place) < F.col(f"below{k}"), F.col(f"prior{k}")).otherwise(F.coalesce(f"first{k}", f"next{k}"))
        second = F.coalesce(f"second{k}", f"next{k}", first)
        return first + (second - first) * (place - F.floor(place))

    return both.select(F.col("g").alias(group), F.array(*[value(k, q) for k, q in zip(spans, quantiles)]).alias(out))
