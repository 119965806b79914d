"""Nearest neighbours by a block matrix join of int8 tiles.

Every vector is rounded once to int8, with a scale and with the norms of what was kept and what was
lost, and only that is read by the join: the queries pass in chunks of bounded bytes, sent to all
tasks, while each task holds one block of candidates at a time. Candidates are never copied for the
queries, nor shuffled. In a tile the integer products (exact in single precision) give each inner
product to within ``|a'| |eb| + |ea| |b|``, ea and eb being what rounding lost. A pair survives if its
upper bound reaches the query's k-th best lower bound, first of the task, then of all tasks. Survivors
alone are computed again in double precision from the original vectors, and heaps merge them.
Nothing that could be among the k nearest is dropped, so recall is that of brute force.

A query is a row, and so is a candidate: of an id on several rows each row is searched for and found,
and only the query's own row is left out. ``query_row`` tells the queries of one id apart.

Edge cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no
part, nor do rows without an id; vectors meet those of equal length only; ties go to the smaller id,
then to the earlier row; with fewer candidates than k all are returned; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable

NEIGHBOURS = 20
QUERY_STEP = 20
#: Candidates of a block and of a task, about; queries of a tile multiplied at once.
BLOCK_ROWS, TASK_ROWS, TILE_ROWS = 4096, 1 << 18, 512
#: Bytes of a chunk of queries that is sent to all tasks, and its rows, at most.
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 1 << 16
#: Survivors held before those that later blocks have ruled out go.
HELD_ROWS = 1 << 21

BOUNDS = "query long, cand long, lower double, upper double"
CODES = "row long, dim int, code binary, scale double, kept double, lost double"


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and vector (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    named = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    return named.filter(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")


def few_equals(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without those that k + 1 rows of an equal vector and smaller id precede.

    Of equal vectors only the first k and one more, which may be the query itself, can be among k
    nearest. Vectors are told apart by 96 bits of hashes; only rows of crowded ones are put in order.
    """
    marked = rows.withColumns({"h": F.xxhash64("vector"), "g": F.hash("vector")})
    crowded = durable(marked.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("h", "g"), "crowded-vectors")
    crowded = broadcast_if_small(crowded, crowded.count(), 24)
    first = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id", "row"))
    many = marked.join(crowded, ["h", "g"], "left_semi").withColumn("at", first).filter(F.col("at") <= k + 1)
    return marked.join(crowded, ["h", "g"], "left_anti").select(rows.columns).unionByName(many.select(rows.columns))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the rounded vectors, and norms of what rounding lost."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; slices of 1024 columns keep single precision exact."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def encode(rows: DataFrame) -> DataFrame:
    """``CODES`` of ``rows`` (row, vector)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes, scale, kept, lost = quantise(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(at)), pa.array(dims[at].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(kept), pa.array(lost)],
                    ["row", "dim", "code", "scale", "kept", "lost"],
                )

    return rows.select("row", "vector").mapInArrow(run, CODES)


class Side:
    """Codes of one length, with their scales and norms."""

    def __init__(self, row, code: bytes, scale, kept, lost):
        self.row, self.scale, self.kept, self.lost = row, scale, kept, lost
        self.code = np.frombuffer(code, np.int8).reshape(len(row), -1)


def tile(query: Side, part: slice, cand: Side) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of some queries and a block; a query's own row has none above minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = products(query.code[part], cand.code) * query.scale[part, None] * cand.scale
        whole = cand.kept + cand.lost
        error = query.kept[part, None] * cand.lost + query.lost[part, None] * whole + 1e-12 * (query.kept[part] + query.lost[part])[:, None] * whole
        lower, upper = np.nan_to_num(near - error, nan=-np.inf), np.nan_to_num(near + error, nan=np.inf, posinf=np.inf, neginf=-np.inf)
    order = np.argsort(cand.row)
    place = np.minimum(np.searchsorted(cand.row, query.row[part], sorter=order), len(order) - 1)
    own = np.flatnonzero(cand.row[order[place]] == query.row[part])
    lower[own, order[place[own]]] = upper[own, order[place[own]]] = -np.inf
    return lower, upper


def bounded(query: Side, blocks, k: int):
    """Arrays query, candidate (rows), lower and upper of the pairs that can be among a query's k nearest in ``blocks``."""
    best = np.full((len(query.row), k), -np.inf)  # the k largest lower bounds so far
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def pruned():
        q, c, lower, upper = (np.concatenate(x) for x in zip(*held))
        ok = upper >= best[q].min(axis=1)
        return q[ok], c[ok], lower[ok], upper[ok]

    for cand in blocks:
        for at in range(0, len(query.row), TILE_ROWS):
            part = slice(at, min(at + TILE_ROWS, len(query.row)))
            lower, upper = tile(query, part, cand)
            both = np.concatenate([best[part], lower], axis=1)
            best[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            row, col = np.nonzero((upper >= best[part].min(axis=1)[:, None]) & (upper > -np.inf))
            held.append((row + at, cand.row[col], lower[row, col], upper[row, col]))
            count += len(row)
            if count > HELD_ROWS:
                held = [pruned()]
                if len(held[0][0]) > HELD_ROWS // 2:  # nearly all are ties: they go out as they are
                    q, *rest = held.pop()
                    yield query.row[q], *rest
                count = sum(len(h[0]) for h in held)
    if held:
        q, *rest = pruned()
        yield query.row[q], *rest


def passed(codes: DataFrame, chunk: list, k: int, path: str) -> None:
    """Add the pairs query, cand, lower and upper of one chunk of queries against all of ``codes`` to a table."""
    dim = chunk[0]["dim"]
    columns = [np.array([r[c] for r in chunk]) for c in ("row", "scale", "kept", "lost")]
    sent = codes.sparkSession.sparkContext.broadcast((columns, b"".join(bytes(r["code"]) for r in chunk)))

    def run(batches):
        (row, *rest), code = sent.value

        def blocks():
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    yield Side(part.column(0).to_numpy(), b"".join(part.column(1).to_pylist()), *(part.column(c).to_numpy() for c in (2, 3, 4)))

        for out in bounded(Side(row, code, *rest), blocks(), k):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query", "cand", "lower", "upper"])

    pairs = codes.filter(F.col("dim") == dim).select("row", "code", "scale", "kept", "lost").mapInArrow(run, BOUNDS)
    pairs.write.mode("append").parquet(path)
    sent.destroy()  # the next chunk takes its place


def rescored(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, query_id, vec_id, cand and score of the k best of each task's ``pairs`` (query, cand), in double precision."""
    cand = rows.select(F.col("row").alias("cand"), "vec_id", F.col("vector").alias("c"))
    query = rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    both = pairs.select("query", "cand").join(cand, "cand").join(query, "query").select("query", "query_id", "vec_id", "cand", "q", "c")

    def run(batches):
        heaps: dict[tuple[int, int], list[tuple[float, int, int]]] = {}

        def emit():
            out = [(*q, -i, -r, s) for q, heap in heaps.items() for s, i, r in heap]
            heaps.clear()
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "query_id", "vec_id", "cand", "score"])

        for batch in batches:
            q, c = (batch.column(n) for n in ("q", "c"))
            product = q.flatten().to_numpy(zero_copy_only=False) * c.flatten().to_numpy(zero_copy_only=False)
            dims = q.value_lengths().to_numpy(zero_copy_only=False)
            score = np.add.reduceat(product, np.cumsum(dims) - dims) if len(dims) else product
            for query, name, i, r, s in zip(*(batch.column(n).to_pylist() for n in ("query", "query_id", "vec_id", "cand")), score.tolist()):
                heap = heaps.setdefault((query, name), [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i, -r))
                elif (s, -i, -r) > heap[0]:
                    heapq.heapreplace(heap, (s, -i, -r))
            if len(heaps) > CHUNK_ROWS:
                yield emit()
        yield emit()

    return both.mapInArrow(run, "query long, query_id long, vec_id long, cand long, score double")


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score, query_row of each query's k nearest; ``is_query`` is a predicate on vec_id."""
    spark = vectors.sparkSession
    rows = durable(usable(vectors).withColumn("asked", is_query), "vectors")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    codes = durable(encode(few_equals(rows, k)).repartition(tasks), "codes")
    spread = {r["dim"]: -(-r["n"] // max(1, min(CHUNK_ROWS, CHUNK_BYTES // (r["dim"] + 40)))) for r in rows.filter("asked").groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not spread:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    chunks = F.create_map(*[F.lit(x) for pair in spread.items() for x in pair])
    asked = encode(rows.filter("asked")).withColumn("chunk", F.pmod(F.xxhash64("row"), chunks[F.col("dim")]))
    asked = durable(asked, "query-codes", ["dim", "chunk"])
    found = durable(spark.createDataFrame([], BOUNDS), "bounds")
    for dim, n in sorted(spread.items()):
        for at in range(n):
            chunk = sorted(asked.filter((F.col("dim") == dim) & (F.col("chunk") == at)).select("row", "dim", "code", "scale", "kept", "lost").collect())
            if chunk:
                passed(codes, chunk, k, found.loom_path)
    found = spark.read.schema(BOUNDS).parquet(found.loom_path)
    # The k-th best lower bound over all tasks rules out most of what single tasks had to keep.
    floors = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))).filter(F.col("at") == k).select("query", F.col("lower").alias("floor"))
    left = durable(found.join(floors, "query", "left").filter("floor IS NULL OR upper >= floor").select("query", "cand"), "survivors")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "cand")
    ranked = rescored(left, rows, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.col("query").alias("query_row"))


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % QUERY_STEP == 0)
