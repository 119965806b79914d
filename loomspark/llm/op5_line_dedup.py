"""Line removal by site-relative frequency, natively.

Documents are grouped by host; a line's frequency is the number of the host's pages that hold it,
divided by the host's pages. Lines over the boilerplate ratio are dropped from every page of that
host. Lines compare by their text without outer spaces; a page counts a line once. Lines that are
empty after trimming are neither counted nor dropped.

Counting runs on 64-bit hashes first: a (host, hash) pair under the ratio can hold no line over
it, as collisions only add. The survivors are counted again by their full text, so the result is
exact. Both counts combine before their shuffle, so a line on a third of all pages costs one row
per task. A host has at most (mean distinct lines per page) / ratio lines over the ratio, so the
set carried to its pages is bounded by the ratio, not by the corpus. The sets are broadcast if those
of all hosts are small. Otherwise pages and sets meet by shuffle, and a host of over ``SALT_PAGES``
pages is dealt in parts, each with a copy of the host's set.

Edge cases: a null text stays null and counts as a page without lines; a null host is a host of
its own; hosts with fewer than ``min_pages`` pages holding the line keep it; a page whose lines
all go has an empty text; repeated rows are pages of their own; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, durable

#: Share of a host's pages beyond which a line is boilerplate.
MAX_RATIO = 0.05
#: A line on fewer pages of its host than this stays, whatever the ratio.
MIN_PAGES = 5
#: Pages of a host beyond which its pages are dealt in parts, if they have to be shuffled.
SALT_PAGES = 200_000


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The lines to drop: host (as __loom_host), line, pages, host_pages."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("__loom_host"), F.col(text).alias("_text"))
    totals = durable(pages.groupBy("__loom_host").agg(F.count(F.lit(1)).alias("host_pages")), "host-pages")
    over = (F.col("pages") >= min_pages) & (F.col("pages") > F.col("host_pages") * max_ratio)
    lines = F.filter(F.array_distinct(F.transform(F.split("_text", "\n"), lambda x: F.trim(x))), lambda x: x != "")
    each = pages.select("__loom_host", F.explode(lines).alias("line")).withColumn("__loom_hash", F.xxhash64("line"))
    # A pair of pages * ratio < min_pages cannot pass, so the first count needs no totals to shed nearly all pairs.
    hashes = each.groupBy("__loom_host", "__loom_hash").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    maybe = durable(hashes.join(broadcast_if_small(totals, totals.count(), 64), "__loom_host").filter(over).select("__loom_host", "__loom_hash", "host_pages"), "boilerplate-hashes")
    exact = each.join(broadcast_if_small(maybe, maybe.count(), 48), ["__loom_host", "__loom_hash"])
    return exact.groupBy("__loom_host", "line").agg(F.count(F.lit(1)).alias("pages"), F.first("host_pages").alias("host_pages")).filter(over)


def _salted(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pages with the set of their host, by a shuffle in which no host's pages meet in one place."""
    sets = sets.withColumn("__loom_parts", F.ceil(F.col("__loom_pages") / SALT_PAGES).cast("int"))
    crowded = sets.filter("__loom_parts > 1").select("__loom_host", "__loom_parts")
    dealt = keyed.join(broadcast_if_small(crowded, crowded.count(), 64), "__loom_host", "left")
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__loom_parts")).cast("int"), F.lit(0))
    copies = sets.select("__loom_host", "__loom_drop", F.explode(F.expr("sequence(0, __loom_parts - 1)")).alias("__loom_part"))
    return dealt.withColumn("__loom_part", part).join(copies, ["__loom_host", "__loom_part"], "left")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, count: str = "n_dropped") -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, and their number as ``count``, which replaces a column of that name."""
    sets = boilerplate(docs, host, text, max_ratio, min_pages).groupBy("__loom_host").agg(F.collect_set("line").alias("__loom_drop"), F.sum(F.octet_length("line")).alias("__loom_bytes"), F.max("host_pages").alias("__loom_pages"))
    sets = durable(sets, "boilerplate-lines")
    size = sets.agg(F.coalesce(F.sum("__loom_bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    size = size["b"] + 64 * size["n"]
    columns = [c for c in docs.columns if c != count]
    keyed = docs.withColumn("__loom_host", F.coalesce(F.col(host).cast("string"), F.lit("\x00")))
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(sets.select("__loom_host", "__loom_drop")), "__loom_host", "left")
    else:
        joined = _salted(keyed, sets)
    # One interpreted pass over the lines: a page without a set, or without text, is left as it is.
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("__loom_drop"), F.trim(x)))
    touched = F.col("__loom_drop").isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn("__loom_kept", F.when(touched, kept))
    cleaned = F.when(touched, F.array_join("__loom_kept", "\n")).otherwise(F.col(text))
    dropped = F.when(touched, F.size(F.split(text, "\n")) - F.size("__loom_kept")).otherwise(F.lit(0))
    return out.withColumn(count, dropped).withColumn(text, cleaned).select(*columns, count)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "text", F.col("n_dropped").cast("int").alias("n_dropped"))


ORACLE_SQL = f"""
WITH line AS (
    SELECT DISTINCT coalesce(source, chr(0)) AS host, doc_id, trim(x) AS line
    FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''),
total AS (SELECT coalesce(source, chr(0)) AS host, count(*) AS host_pages FROM documents GROUP BY 1),
boiler AS (
    SELECT host, line FROM line JOIN total USING (host) GROUP BY host, line, host_pages
    HAVING count(*) >= {MIN_PAGES} AND count(*) > host_pages * {MAX_RATIO}::DOUBLE),
sets AS (SELECT host, list(line) AS gone FROM boiler GROUP BY host),
cut AS (
    SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(gone, trim(x)), false)) AS kept,
           len(string_split(text, chr(10))) AS n
    FROM documents LEFT JOIN sets ON coalesce(source, chr(0)) = host)
SELECT doc_id, source, CASE WHEN len(kept) = n THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text, (n - len(kept))::INT AS n_dropped FROM cut"""
