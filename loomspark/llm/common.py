"""Helpers shared by the corpus operators: durable tables, size checks, samples, lean Python functions."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its rows, at the stated width, stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows that a Python function over Arrow batches works on, and gives back, at once.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset a local one is set, but only if driver and executors are one process.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Tables written by this driver and not yet swept.
_made: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the tables ``durable`` wrote, once the results that read them are stored; returns how many went."""
    count = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def durable(df: DataFrame, name: str, parted_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in parts by columns if wanted, and read it back.

    This cuts the lineage, so lost executors cost a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=parted_by)
    _made.append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.loom_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more: all that came of them is written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.loom_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(table.loom_path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is within bounds; else leave a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batches):
    """The rows of ``batches`` in batches of at most ``SLICE_ROWS``, so that what comes of them is small on both sides."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def lean(run):
    """``run`` over Arrow batches; when it ends the worker returns the memory it freed to the machine.

    Workers serve task after task, and without this each holds on to the most it ever took.
    """

    @functools.wraps(run)
    def returning(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return returning


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sent_text(docs: DataFrame, columns: list[str]) -> tuple[list, str]:
    """What to send to a function that reads ``text`` and returns ``columns`` of ``docs``, and the name of the text there.

    A text that is returned is not sent twice; nulls in it are the function's to read as empty.
    """
    if "text" in columns and dict(docs.dtypes)["text"] == "string":
        return columns, "text"
    return [*columns, text_or_empty().alias("__loom_text")], "__loom_text"


def id_crc(column: str = "doc_id"):
    """crc32 of the id written in decimal; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, size: int) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled documents of each class, of ``size`` bytes together at most.

    They come in an order fixed by a hash of the id; texts of over a hundredth of ``size`` are left
    out. ``keep`` is a predicate on ``doc_id`` (which folds may be learned from). An id labelled both
    ways counts as 1; an id on several rows stands for its least text. The id list is bounded by
    ``2 * rows``, so it is safe to broadcast against the documents.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).select("doc_id", F.col(label).alias("y"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    parts = [known.filter(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).filter(F.col("n") <= size // 100).join(F.broadcast(ids), "doc_id")
    # At most two rows of numbers for each labelled page that learning may read.
    found = sizes.groupBy("doc_id", "y").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(*order).collect()
    left, chosen = {0: size, 1: size}, []
    for r in found:
        left[r["y"]] -= r["n"]
        if left[r["y"]] >= 0:
            chosen.append((r["doc_id"], r["y"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # From an Arrow table: a list would be sent through Python workers of a second kind on the executors.
    learned = docs.sparkSession.createDataFrame(pa.table({"doc_id": [i for i, _ in chosen], "y": [y for _, y in chosen]}), f"doc_id {kind}, y int")
    picked = texts.filter(F.octet_length("text") <= size // 100).join(F.broadcast(learned), "doc_id")
    return picked.groupBy("doc_id", "y").agg(F.min("text").alias("text")) if any(r["rows"] > 1 for r in found) else picked
