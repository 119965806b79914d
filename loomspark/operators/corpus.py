"""Corpus operators over DataFrames: window fit, tiers, speaker-disjoint split with its leak check, sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: Bytes of text that are counted at once; a longer text alone.
COUNT_BYTES = 1 << 20
_LETTER, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_BLANK[[*b" \t\n"]] = True


class LeakError(ValueError):
    """A speaker stands on both sides of a split."""


def mos_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("mos_")]


def fit_window(df: DataFrame, rate: str = "rate", low: float = 0.02, high: float = 0.98) -> tuple[float, float] | None:
    """The percentiles of the positive, finite rates."""
    x = F.col(rate)
    found = exact_quantiles(df.filter((x > 0) & ~F.isnan(x) & (x < float("inf"))), rate, [low, high])
    return tuple(found) if found else None


def tier(mos: str, least: float, duration: str, shortest: float, longest: float, rate: str, window: tuple[float, float]) -> Column:
    """Inclusive bounds; a missing MOS fails."""
    return (F.coalesce(F.nanvl(F.col(mos), F.lit(-1.0)), F.lit(-1.0)) >= least) & F.col(duration).between(shortest, longest) & F.col(rate).between(*window)


def align(left: DataFrame, right: DataFrame, key: str = "idx") -> DataFrame:
    """One-to-one join; tables of different sizes are refused."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"tables differ in length: {a} and {b}")
    return left.join(right, key)


def hold_out(clusters: DataFrame, clips: int, speakers: int, seed: int = 1234) -> DataFrame:
    """Clusters (cluster, n) in hash order until the clips or the speakers suffice.

    Prefix sums run over one row per cluster in one task: the cluster list is bounded by speakers.
    """
    order = Window.orderBy(F.xxhash64("cluster", F.lit(seed)), "cluster")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = clusters.withColumn("_before", before).withColumn("_k", F.row_number().over(order))
    return ranked.filter((F.col("_before") < clips) & (F.col("_k") <= speakers)).drop("_before", "_k")


def check_leak(train: DataFrame, held: DataFrame, speaker: str = "cluster") -> None:
    shared = train.select(speaker).intersect(held.select(speaker)).limit(5).collect()
    if shared:
        raise LeakError(f"speakers on both sides: {[r[0] for r in shared]}")


def write_packed(df: DataFrame, path: str, rows_per_file: int = 4000) -> None:
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_lexicon(df: DataFrame, path: str) -> None:
    """Keys sorted, readings in order, tab separated."""
    df.orderBy("key").select(F.concat_ws("\t", "key", F.concat_ws("\t", "readings")).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document of all columns a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def count_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters (A-Z, a-z, À-Ö, Ø-ö, ø-ÿ) and words (runs of no space, tab or line feed) of each text, from its bytes in UTF-8."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    n = len(texts)
    letters, words = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n or data is None:
        return letters, words
    ends = np.frombuffer(ends, dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = np.frombuffer(data, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + COUNT_BYTES, side="right")) - 1)
        edges = ends[first : last + 1] - ends[first]
        part = data[ends[first] : ends[last]]
        upto = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum(_LETTER[part], out=upto[1:])
        # The letters above ASCII are two bytes, of which the first is C3; so are the signs of multiplication and division.
        accented = np.flatnonzero(part[:-1] == 0xC3)
        accented = accented[(part[accented + 1] != 0x97) & (part[accented + 1] != 0xB7)]
        letters[first:last] = np.diff(upto[edges]) + np.diff(np.searchsorted(accented, edges))
        blank = _BLANK[part]
        start = ~blank
        start[1:] &= blank[:-1]
        heads = edges[:-1][np.diff(edges) > 0]
        start[heads] = ~blank[heads]
        words[first:last] = np.diff(np.searchsorted(np.flatnonzero(start), edges))
        first = last
    return letters, words


def register_text_counts(spark: SparkSession) -> str:
    """The name of a function of Spark SQL: ``letters`` and ``words`` of a text that is not null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in count_text(texts)], ["letters", "words"])

    spark.udf.register("loomspark_text_counts", F.arrow_udf(run, "letters long, words long"))
    return "loomspark_text_counts"
