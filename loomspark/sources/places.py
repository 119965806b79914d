"""Paths: of any file system that Spark reads, or within a named store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system its scheme names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def resolve(spark: SparkSession, path: str, stores: dict[str, str] | None = None) -> str:
    """A path as it stands if it is there, else ``name:path`` within a store of that name; neither raises."""
    name, colon, inner = path.partition(":")
    known = colon and (stores or {}).get(name)
    found = f"{known.rstrip('/')}/{inner.lstrip('/')}" if known else path
    if not exists(spark, found):
        raise FileNotFoundError(path)
    return found
