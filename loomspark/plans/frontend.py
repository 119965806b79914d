"""Queries that SQL cannot express (rows only), and parses and round trips with an oracle."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import g2p
from ..operators import clustering, corpus, sequence
from ..operators.quantiles import exact_quantiles
from ..sources import files
from .language import PHRASES, SENTENCES, rows

LEXICON = "کتاب\tketAb\n# a comment\n\nخانه\txAne\nکتاب\tketAb\tketeb\n مرد\tmard\tmord"


def _phrases(spark: SparkSession) -> DataFrame:
    return spark.sql(rows(PHRASES))


def frontend_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text, tokens, linker flags, phonemes and ids."""
    return g2p.frontend(_phrases(spark), "s")


def word_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words spoken once, joined back."""
    return g2p.phonemes_of(_phrases(spark).select("id", F.explode(F.split("s", " ")).alias("word")))


def sentence_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sentences to tokens and phonemes, with readings by context, called names and doors."""
    return g2p.spoken(spark.sql(rows(SENTENCES[:8])), "s").select("id", F.array_join("tokens", "/").alias("tokens"), "phonemes")


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sequence.sentence_chunks(docs).select("doc_id", F.size("chunks").alias("n_chunks"), F.array_max(F.transform("chunks", F.length)).alias("longest"))


def monotonic_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix per order, rows by line, frames by sine of the keys."""
    # Dealt by order at once, so that its lines and then its matrix are gathered where they are; cells are made inside the array.
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey")
    lines = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    orders = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "q")).alias("lines"))
    frames = F.sequence(F.lit(0), F.lit(9))
    cells = F.transform("lines", lambda x: F.transform(frames, lambda k: F.struct(x["l_linenumber"].alias("row"), k.alias("frame"), F.sin(x["q"] * (k + 1)).alias("value"))))
    return sequence.align_collected(orders.select("l_orderkey", F.flatten(cells).alias("cells")), "l_orderkey", "cells")


def agglomerative_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of a bounded sample, then every row to its nearest."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return clustering.assign(vectors, clustering.fit_clusters(vectors, 0.6))


def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, their sizes and mean confidence at each threshold."""
    return clustering.sweep(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), (0.5, 0.6, 0.7, 0.8))


def effective_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return spark.createDataFrame([(clustering.effective_dimensions(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),)], "dims int")


def exact_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 without a single task that holds every distinct value."""
    rate = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))
    low, high = exact_quantiles(rate, "rate", [0.02, 0.98]) or (None, None)
    return spark.createDataFrame([(low, high)], "lo double, hi double").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6"""
    return files.with_shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id", "shard")


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx and WAV bytes: a tone per nation."""

    def tone(n):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            x = np.sin(np.arange(400 + 40 * n) * 0.1) * 9000
            w.writeframes(struct.pack(f"<{len(x)}h", *x.astype(int)))
        return out.getvalue()

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")

    def draw(keys: pd.Series) -> pd.Series:
        return keys.map(tone)

    tones = F.pandas_udf(draw, "binary")
    return nations.select(F.col("n_nationkey").cast("long").alias("idx"), tones("n_nationkey").alias("audio"))


def wav_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13"""
    return files.wav_header(_tones(spark, sf_dir)).drop("audio")


def audio_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: how many clips there are of each format and rate."""
    return files.wav_header(_tones(spark, sf_dir)).groupBy("format", "sample_rate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 6).alias("seconds"))


def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14"""
    return files.wav_samples(_tones(spark, sf_dir), 8000).select("idx", F.size("samples").alias("n"), F.round(F.array_max("samples").cast("double"), 4).alias("peak"))


def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of up to twice the range, written as WAV bytes and read again."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("idx"))
    loud = nations.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k - 5) * F.col("idx") / 60))
    back = files.wav_samples(files.wav_bytes(loud, 8000), 8000)
    return back.select("idx", F.size("samples").alias("n"), F.round(F.array_max(F.transform("samples", F.abs)).cast("double"), 3).alias("peak"))


def ezafe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left-to-right recurrence as a fold: a turn counts if its length is even and the turn before did not count."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    fold = F.aggregate("t", F.expr("cast(array() AS array<boolean>)"), lambda acc, x: F.concat(acc, F.array((x["n"] % 2 == 0) & ~F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(False)))))
    return turns.select("conv_id", F.array_join(F.transform(fold, lambda x: x.cast("int").cast("string")), "").alias("flags"))


def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6"""
    return sequence.shuffled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), 1234, "doc_id")


def conjugation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of our own verbs."""
    forms = [(v[0], k, *f) for v in g2p.VERBS for k, f in enumerate(g2p.conjugate(*v))]
    return spark.createDataFrame(forms, "verb string, place int, form string, phonemes string, stress int")


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; a local one only where none is set and all is one process."""
    import tempfile
    import uuid

    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 K3"""
    path = _folder(spark, "jsonl")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.json(path)
    return files.json_lines(spark, path, "doc_id long, quality int, toxic int")


def packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 K2 S4"""
    path = _folder(spark, "packed")
    corpus.write_packed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), path, 500)
    return files.parquet_folder(spark, path, ["o_orderkey", "o_totalprice", "absent"])


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4"""
    path = _folder(spark, "report")
    corpus.write_report(spark.read.parquet(f"{sf_dir}/region.parquet"), path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and labels keyed instead of positional."""
    path = _folder(spark, "vectors")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


def lexicon_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read, merged, deduplicated in order."""
    path = _folder(spark, "lexicon")
    spark.createDataFrame([(LEXICON,)], "value string").coalesce(1).write.text(path)
    return files.lexicon(spark, path).select(F.col("key").alias("word_key"), F.array_join("readings", "/").alias("readings"))


def lexicon_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines parted by white space of any kind."""
    path = _folder(spark, "lexicon")
    spark.createDataFrame([(LEXICON.replace("\t", "  \t"),)], "value string").coalesce(1).write.text(path)
    return files.lexicon(spark, path, r"\s+").select(F.col("key").alias("word_key"), F.array_join("readings", "/").alias("readings"))


def golden_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11"""
    path = _folder(spark, "golden")
    spark.createDataFrame([("# note\n1\tezafe\tکتاب من\tket1Ab- man\n\n?2\tzwnj\tمی‌روم\tm1iravam",)], "value string").coalesce(1).write.text(path)
    return files.golden(spark, path)


ORACLE = {
    "sentence_phonemes": """SELECT * FROM (VALUES
        (0, 'کتاب/من/روی/میز/است', 'ket1Ab- m1an r1uy- m1iz 1ast'), (1, 'مرد/را/دید', 'm1ard rA d1id'), (2, 'او/دیروز/مرد', '1u dir1uz m1ord'), (3, 'این/کتاب/خوب', '1in ket1Ab x1ub'),
        (4, 'ساعت/نه/صبح', 'sAQ1at n1oh- s1obh'), (5, 'نه/شما', 'n1ay- shom1A'), (6, 'پر/از/گل', 'p1or az g1ol'), (7, 'علی/به/تهران/رفت', 'Qal1i be tehr1An r1aft')) v(id, tokens, phonemes)""".replace("Q", "''"),
    "wav_roundtrip": "SELECT n_nationkey::BIGINT AS idx, 10 AS n, round(floor(least(1, n_nationkey * 5 / 60.0) * 32767) / 32768, 3)::DOUBLE AS peak FROM nation",
    "wav_decode": "SELECT n_nationkey::BIGINT AS idx, (400 + 40 * n_nationkey)::INT AS n, round(max(floor(sin(i * 0.1) * 9000)) / 32768, 4) AS peak FROM nation, generate_series(0, 2000) s(i) WHERE i < 400 + 40 * n_nationkey GROUP BY n_nationkey",
    "source_file": "SELECT doc_id, 'documents.parquet' AS shard FROM documents",
    "wav_header": "SELECT n_nationkey::BIGINT AS idx, ((400 + 40 * n_nationkey) / 8000.0)::DOUBLE AS duration, 8000 AS sample_rate, 'WAV' AS format FROM nation",
    "ezafe_fold": """
        WITH RECURSIVE t AS (SELECT conv_id, length(text) % 2 = 0 AS even, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
        f AS (SELECT conv_id, k, even AS flag FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, t.even AND NOT f.flag FROM t JOIN f ON t.conv_id = f.conv_id AND t.k = f.k + 1)
        SELECT conv_id, string_agg(flag::INT, '' ORDER BY k) AS flags FROM f GROUP BY conv_id""",
    "exact_rate_window": "SELECT round(quantile_cont(r, 0.02), 6) AS lo, round(quantile_cont(r, 0.98), 6) AS hi FROM (SELECT l_extendedprice / l_quantity AS r FROM lineitem) x",
    "jsonl_roundtrip": "SELECT doc_id, quality, toxic FROM labels",
    "packed_roundtrip": "SELECT o_orderkey, o_totalprice FROM orders",
    "report_roundtrip": "SELECT r_regionkey, r_name FROM region",
    "vectors_roundtrip": "SELECT vec_id, label, len(embedding) AS dim FROM embeddings",
    "lexicon_parse": "SELECT * FROM (VALUES ('کتاب', 'ketAb/keteb'), ('خانه', 'xAne'), ('مرد', 'mard/mord')) v(word_key, readings)",
    "lexicon_spaces": "SELECT * FROM (VALUES ('کتاب', 'ketAb/keteb'), ('خانه', 'xAne'), ('مرد', 'mard/mord')) v(word_key, readings)",
    "audio_counters": "SELECT 'WAV' AS format, 8000 AS sample_rate, count(*) AS n, round(sum((400 + 40 * n_nationkey) / 8000.0), 6)::DOUBLE AS seconds FROM nation",
    "golden_parse": "SELECT * FROM (VALUES ('1', 'ezafe', 'کتاب من', 'ket1Ab- man', true), ('2', 'zwnj', 'می‌روم', 'm1iravam', false)) v(id, category, text, phonemes, reviewed)",
}
QUERIES = {
    f.__name__: f
    for f in (
        frontend_ids, word_phonemes, sentence_phonemes, sentence_chunks, monotonic_path, agglomerative_clusters, cluster_sweep, effective_dims, exact_rate_window, source_file, wav_header, audio_counters, wav_decode, wav_roundtrip,
        ezafe_fold, shuffle_buffer, conjugation, jsonl_roundtrip, packed_roundtrip, report_roundtrip, vectors_roundtrip, lexicon_parse, lexicon_spaces, golden_parse,
    )
}
