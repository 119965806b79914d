"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints first collapse to distinct ones, each standing under its least doc_id. Two that
differ in at most two bits agree on one of three blocks of the 64 bits, so each is dealt to its
three block values; nothing is lost. A partition sorts its fingerprints by block value and Gray
rank, where neighbours share most bits, and stacks an index over them: a node holds the bits its
members all share, less those its parent already holds. Searches go down all queries at once,
adding the differing bits of each node to what the path has, and leave a whole group as soon as
the sum passes two. What is found is folded into a forest in the partition, so a dense group
yields an edge per member, not per pair; components join the forests.

A block value that holds more than ``GROUP_ROWS`` fingerprints is dealt again: of four parts of
the other bits, two at least agree, so the six pairs of parts make new keys. No group is cut.

Edge cases: null and wordless texts have fingerprint zero and link like any other; ties, repeated
rows and repeated ids give equal rows; an empty table gives no rows; a null id keeps a null
component; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints under one block value beyond which the value is dealt again by finer keys.
GROUP_ROWS = 200_000
#: Members of a node, and nodes of an upper node.
FANOUT = 8
#: Queries that go down the index together.
QUERY_ROWS = 16_384
#: Pairs of query and node held at once; more are put off, not dropped.
FRONTIER = 1 << 21
#: Rows aimed at for one partition of the search.
PARTITION_ROWS = 300_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of a whole text: the bits set in over half of its shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > size:
        ends, starts = ends[size - 1 :], starts[: len(words) - size + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends - 1).tolist())], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    out, total = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, total, 65_536):
        out += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(out * 2 > total).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Masked bit patterns over groups of fingerprints in Gray order.

    ``keys`` names the group of each fingerprint; both come sorted by (key, Gray rank).
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        # Upper levels: all-ones and all-zeros of the members below, and where the members stand.
        group, ones, zeros = keys, fps, ~fps
        while True:
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            start = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            self.levels.append((start, np.append(start[1:], len(group)), ones, zeros))
            group = group[start]
            if len(np.unique(group)) == len(group):
                break
        self.roots = group

    def links(self, query: np.ndarray, query_keys: np.ndarray, radius: int):
        """Pairs (query row, member) of one key within ``radius`` bits, found by going down all queries at once."""
        n = len(query)
        # What is still to go down: level, query rows, nodes, bits spent, bits the path has accounted for.
        todo = [(len(self.levels), np.arange(n), np.searchsorted(self.roots, query_keys), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint64))]
        while todo:
            level, row, node, spent, held = todo.pop()
            if not level:
                spent = spent + np.bitwise_count((query[row] ^ self.fps[node]) & ~held)
                near = spent <= radius
                yield row[near], node[near]
                continue
            start, end, ones, zeros = self.levels[level - 1]
            mask = ones[node] | zeros[node]
            spent = spent + np.bitwise_count((query[row] ^ ones[node]) & mask & ~held)
            go = spent <= radius
            row, node, spent, mask = row[go], node[go], spent[go], mask[go]
            for at in range(0, len(row), FRONTIER // FANOUT):
                part = slice(at, at + FRONTIER // FANOUT)
                fan = (end - start)[node[part]]
                base = np.repeat(start[node[part]] - (np.cumsum(fan) - fan), fan)
                todo.append((level - 1, np.repeat(row[part], fan), base + np.arange(int(fan.sum())), np.repeat(spent[part], fan), np.repeat(mask[part], fan)))


def fold(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of ``parent`` along the edges (a, b); every root is its tree's least row."""
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b, low, high = a[apart], b[apart], np.minimum(pa_, pb)[apart], np.maximum(pa_, pb)[apart]
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def fold_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``fold``, and which of the edges (a, b) joined two trees: they span what all of them connect."""
    joined, at = [], np.arange(len(a))
    while True:
        pa_, pb = parent[a[at]], parent[b[at]]
        apart = pa_ != pb
        if not apart.any():
            return parent, np.concatenate(joined) if joined else at[:0]
        at, low, high = at[apart], np.minimum(pa_, pb)[apart], np.maximum(pa_, pb)[apart]
        high, first = np.unique(high, return_index=True)
        parent[high] = low[first]
        joined.append(at[first])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def local_forest(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int = MAX_BITS, linked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that span the links within each key's group: from each node to its tree's root or, if ``linked``, links alone."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps, nodes = keys[order], fps[order], nodes[order]
    alone = np.ones(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    alone[1:][same] = False
    alone[:-1][same] = False
    keys, fps, nodes = keys[~alone], fps[~alone], nodes[~alone]
    parent = np.arange(len(keys))
    met = [(parent[:0], parent[:0])]
    if len(keys):
        index = GrayIndex(keys, fps)
        step = QUERY_ROWS
        for at in range(0, len(keys), step):
            for row, member in index.links(fps[at : at + step], keys[at : at + step], radius):
                later = member > row + at
                a, b = row[later] + at, member[later]
                if linked:
                    parent, edges = fold_links(parent, a, b)
                    met.append((a[edges], b[edges]))
                else:
                    parent = fold(parent, a, b)
    if linked:
        a, b = (np.concatenate(x) for x in zip(*met))
        return nodes[a], nodes[b]
    child = np.flatnonzero(parent != np.arange(len(keys)))
    return nodes[child], nodes[parent[child]]


def _block(lo: int, hi: int):
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def blocks(radius: int) -> list[tuple[int, int]]:
    """Bits [from, to) of the blocks; one more block than differing bits."""
    cuts = [-(-64 * k // (radius + 1)) for k in range(radius + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def _finer(block: int, radius: int):
    """The keys of a crowded value: pairs of parts of the bits outside the block, two more parts than differing bits."""
    rest = [b for k, b in enumerate(blocks(radius)) if k != block]
    parts = []
    for lo, hi in rest[:2]:
        mid = (lo + hi) // 2
        parts += [(lo, mid), (mid, hi)]
    parts += rest[2:]
    pairs = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))]
    return F.array(*[F.xxhash64(F.lit(n), _block(*parts[i]), _block(*parts[j])) for n, (i, j) in enumerate(pairs)])


def near_links(nodes: DataFrame, radius: int = MAX_BITS, linked: bool = False) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints of ``nodes`` (node, fp) within ``radius`` bits, two or more.

    If ``linked``, both ends of every edge are that near; else an edge may lead to another of its component.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    keys = F.array(*[F.struct(F.lit(k).alias("block"), _block(*b).alias("value")) for k, b in enumerate(blocks(radius))])
    dealt = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.block", "k.value")
    if n > GROUP_ROWS:  # with fewer, no value can be crowded
        crowded = durable(dealt.groupBy("block", "value").count().filter(F.col("count") > GROUP_ROWS).select("block", "value", F.lit(True).alias("crowded")), "crowded")
        dealt = dealt.join(broadcast_if_small(crowded, crowded.count(), 24), ["block", "value"], "left")
        finer = F.coalesce(*[F.when(F.col("block") == k, _finer(k, radius)) for k in range(radius + 1)])
        dealt = dealt.withColumn("part", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array(F.lit(0).cast("long")))))
        key = F.xxhash64("block", "value", "part")
    else:
        key = F.xxhash64("block", "value")
    dealt = dealt.select(key.alias("key"), "fp", "node")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(radius + 1) * n // PARTITION_ROWS))

    def run(batches):
        parts = [[np.asarray(b.column(c)) for c in range(3)] for b in batches]
        if parts:
            keys, fps, ids = (np.concatenate(x) for x in zip(*parts))
            u, v = local_forest(keys, fps.view(np.uint64), ids, radius, linked)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.repartition(partitions, "key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links of at most two bits reach."""
    fps = durable(fingerprints(docs, text), "fingerprints")
    nodes = durable(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    moved = components(near_links(nodes))
    # Only fingerprints whose component is not their own least id need the components.
    settled = durable(nodes.join(moved, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "fingerprint-components")
    return fps.join(settled, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
