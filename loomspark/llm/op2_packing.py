"""Best-fit packing of token sequences.

The plan is best-fit decreasing over the *whole* corpus. Pieces of equal length are
interchangeable, so the driver needs the histogram of lengths alone (at most ``capacity``
rows, whatever the corpus holds): it packs runs of equal pieces into runs of equal bins, a
segment tree over remaining capacities naming the tightest open bin in logarithmic time.
The runs, whose number depends on the number of distinct lengths and not on the corpus, are
shipped back, and every piece finds its bin from its rank among pieces of its length. Ranks
are taken in hash buckets of bounded size with prefix counts, so no length, however common,
meets in one task.

Edge cases: a null text is empty and packs as its end token alone; very long texts are cut;
repeated rows are packed once each; an empty table gives no rows; columns of the input other
than those named are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, lean, slices

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Pieces of one length ranked by one task.
BUCKET_ROWS = 250
BUCKET, BEFORE, RANK = "__loom_bucket", "__loom_before", "__loom_rank"

# Where both libraries' character classes are known to agree, the rank file's faster encoder serves.
_PLAIN = re.compile("[\t\n\r -~À-ÿ]*")


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(json_path), fast


def encode_text(text: str, json_path: str, ranks_path: str) -> list[int]:
    """Ids of a whole text, as the tokenizer file's own library gives them."""
    whole, fast = _encoders(json_path, ranks_path)
    if _PLAIN.fullmatch(text) and SPECIAL not in text:
        return fast.encode_ordinary(text)
    return whole.encode(text, add_special_tokens=False).ids


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit)."""
    json_path, ranks_path = paths or default_paths()

    @lean
    def run(batches):
        for batch in slices(batches):
            out = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode_text(text.as_py() or "", json_path, ranks_path), END_ID], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc, k, a, b - a, ids[a:b].tobytes())):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class CapacityTree:
    """Segment tree over remaining capacities: which is the least one of at least ``need`` that has an open bin?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, there: bool) -> None:
        at += self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        at = need + self.size
        while not self.any[at]:
            while at & 1:  # a right child has nothing to its right under this parent
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at *= 2
            if not self.any[at]:
                at += 1
        return at - self.size


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Returns rows (length, first rank, ranks, pieces per bin, first bin, offset of the first piece).
    A bin of remaining r that takes a piece of length l and still holds another such piece is the
    tightest bin for the next one, so bins are filled r // l pieces at a time: exactly the order in
    which best fit would take them one by one.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def keep(left: int, first: int, count: int) -> None:
        if left and count:
            open_bins.setdefault(left, []).append((first, count))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, per = capacity, capacity // length
                first, count = bins, -(-todo // per)
                bins += count
            else:
                per = left // length
                first, count = open_bins[left].pop()
                if not open_bins[left]:
                    tree.set(left, False)
            full = min(count, todo // per)
            if full:
                runs.append((length, rank, full * per, per, first, capacity - left))
                keep(left - per * length, first, full)
                rank, todo, first, count = rank + full * per, todo - full * per, first + full, count - full
            if count and 0 < todo < per:
                runs.append((length, rank, todo, todo, first, capacity - left))
                keep(left - todo * length, first, 1)
                rank, todo, first, count = rank + todo, 0, first + 1, count - 1
            keep(left, first, count)
    return np.array(runs, dtype="int64").reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (doc_id, piece, length, any others).

    ``pieces`` is read three times; pass a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(plan_runs(histogram, capacity))
    buckets = [max(1, -(-histogram.get(n, 0) // BUCKET_ROWS)) for n in range(1, capacity + 1)]
    key = [c for c in ("doc_id", "piece") if c in pieces.columns] + [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    dealt = pieces.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(buckets), F.col("length").cast("int"))))
    before = (
        dealt.groupBy("length", BUCKET).count()
        .select("length", BUCKET, (F.sum("count").over(Window.partitionBy("length").orderBy(BUCKET)) - F.col("count")).alias(BEFORE))
    )
    ranked = dealt.withColumn(RANK, F.row_number().over(Window.partitionBy("length", BUCKET).orderBy(*key)))
    ranked = ranked.join(broadcast_if_small(before, sum(buckets), 24), ["length", BUCKET])
    columns = pieces.columns

    @lean
    def place(batches):
        table = runs.value
        stride = int(table[:, 2].sum()) + 1
        starts = table[:, 0] * stride + table[:, 1]
        order = np.argsort(starts)
        table, starts = table[order], starts[order]
        for batch in batches:
            rank = batch.column(RANK).to_numpy(zero_copy_only=False) - 1
            length = batch.column("length").to_numpy(zero_copy_only=False)
            run = table[np.searchsorted(starts, length * stride + rank, side="right") - 1]
            k = rank - run[:, 1]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(run[:, 4] + k // run[:, 3]), pa.array(run[:, 5] + k % run[:, 3] * length)], [*columns, "sequence_id", "offset"])

    ranked = ranked.select(*columns, (F.col(RANK) + F.col(BEFORE)).alias(RANK))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def assemble(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids, n_tokens and ids (binary), pieces in order of offset.

    A sequence holds at most the capacity in tokens, so a group is bounded.
    """
    whole = packed.select("doc_id", "piece", "sequence_id", "offset", "length").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    row = F.struct("offset", "doc_id", "piece", "ids")
    return whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", F.col("rows.doc_id").alias("doc_ids"), "n_tokens", F.expr("aggregate(rows.ids, X'', (a, b) -> concat(a, b))").alias("ids")
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(durable(pieces, "pieces"))
