"""Following a source: new lines as they come, a table kept up at an interval, and an end by the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the lines of new files in a folder; what has been read is remembered by the query's checkpoint."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).load(folder)


def kept_up(rows: DataFrame, out: str, checkpoint: str, minutes: float = 10.0) -> StreamingQuery:
    """A Parquet table that a stream is written to at an interval; a restart with the same checkpoint goes on where it ended."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes * 60:g} seconds").start()


def until(query: StreamingQuery, minutes: float) -> bool:
    """Let a query run so long at most; what it has written by then stays. Whether it ended by itself."""
    ended = query.awaitTermination(timeout=max(0.001, minutes * 60))
    if not ended:
        query.stop()
    return bool(ended)
