"""Near-duplicates by similarity of word shingles: SimHash links first, an exact search for the rest.

Texts link where the Jaccard similarity of their sets of five-word shingles is 0.8 or more. At that
similarity fingerprints differ in about 10 of 64 bits and up to twice that, so no radius of
``op8_simhash`` is both lossless and selective. Its Gray-order index therefore proposes the links
within ``RADIUS`` bits, over fingerprints of five-word shingles, and a prefix filter proposes what
those leave apart: shingles stand in one global order, common ones last; sets of n and m elements that link
share one of their first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1, and at the first one shared
enough is left of both. Nothing is lost, and every pair proposed is verified on the whole sets.

Equal sets collapse first, and shingles that one set alone holds go. Three rounds follow, and none
proposes a pair that those before have joined. The first takes the SimHash links, a spanning forest
of them. The second pairs each entry of a bucket (a shingle) with the bucket's hub, the set with the
least share of shingles of its own: copies with edits of their own link to what they were made of.
That joins dense groups by a pair per entry. The third pairs all entries of every bucket whose texts
are not joined yet. The last two drop pairs that cannot link by a bound: a bitmap holds the
parity of the shingles under each of ``BITMAP`` hash values, and as many shingles at least as bits
differ stand in one set only. A bucket of over ``BUCKET_ROWS`` entries is dealt in blocks, and each
pair of blocks is a cell of its own, so no task holds an unbounded bucket.

The sample of documents that tells which shingles are common decides their order only, not the result.

A row is its id and its text (``text_key``), so rows of one id with different texts are documents of
their own.

Edge cases: words are those of ``op8_simhash`` (bytes between white space, ASCII case folded); a
text of fewer than five words is one shingle; null and wordless texts are copies of each other; a
row without an id is a document like others and stands after all ids where one is chosen; shingles
are held as 64-bit hashes; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, lean, release
from .components import components
from .op8_simhash import SEED, majority, near_links

SHINGLE = 5
#: Bits in which fingerprints differ at most that the index proposes.
RADIUS = 4
#: Bits of a set's bitmap.
BITMAP = 512
#: Documents of the sample that orders shingles: a share, a least number, and hits that make a shingle common.
SAMPLE_SHARE, SAMPLE_ROWS, COMMON_HITS, COMMON_ROWS = 0.05, 20_000, 5, 200_000
#: Rows aimed at for one partition of the search; pairs held before repeated ones go.
PARTITION_ROWS, HELD_PAIRS = 300_000, 1 << 20
#: Entries of a bucket beyond which it is dealt in blocks.
BUCKET_ROWS = 5_000


def text_key(text: str = "text"):
    """What tells texts apart: 128 bits of a column; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def hashes(text: str | None) -> np.ndarray:
    """Hashes of a whole text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > SHINGLE:
        ends, starts = ends[SHINGLE - 1 :], starts[: len(words) - SHINGLE + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends - 1).tolist())], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return np.unique(hashes(text).view(np.int64))


def _lists(held: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(h) for h in held], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and tokens of each row of ``docs`` (node, text)."""

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t.as_py()) for t in part.column(1)])], ["node", "tokens"])

    return docs.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def common_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles often met in a sample of ``docs`` (key, text), and their hits."""
    share = max(SAMPLE_SHARE, SAMPLE_ROWS / max(rows, 1))
    some = docs.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.lit(0).cast("long").alias("node"), "text")
    hits = shingle_sets(some).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = hits.filter(F.col("n") >= COMMON_HITS).orderBy(F.desc("n"), "token").limit(COMMON_ROWS).toPandas()
    order = np.argsort(top["token"].to_numpy(dtype=np.int64))
    return top["token"].to_numpy(dtype=np.int64)[order], top["n"].to_numpy(dtype=np.int64)[order]


def prefix(tokens: np.ndarray, common: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the global order that any set linked with it must meet."""
    n = len(tokens)
    if not n:
        return tokens
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, hits[at], 0)
    return tokens[np.lexsort((tokens, rank))][: n - (4 * n + 4) // 5 + 1]


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens under each of ``BITMAP`` values of their leading bits."""
    place = (tokens.view(np.uint64) >> np.uint64(65 - BITMAP.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=BITMAP) & 1).tobytes()


def prefixes(docs: DataFrame, common: np.ndarray, hits: np.ndarray) -> DataFrame:
    """doc_id, key, digest (of the set), fp (the fingerprint), n (the set's size), bits and prefix of each row of ``docs`` (doc_id, key, text)."""
    held = docs.sparkSession.sparkContext.broadcast((common, hits))

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [hashes(t.as_py()) for t in part.column(2)]
                sets = [np.unique(f.view(np.int64)) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]),
                        pa.array(np.array([majority(f) for f in found], dtype=np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bitmap(s) for s in sets], pa.binary()),
                        _lists([prefix(s, *held.value) for s in sets]),
                    ],
                    ["doc_id", "key", "digest", "fp", "n", "bits", "prefix"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, digest string, fp long, n long, bits binary, prefix array<long>")


class Entries:
    """Entries of cells as columns: cell, node, n, place, label, hub and bits."""

    def __init__(self, cell, node, n, place, label, hub, bits):
        self.columns = [cell, node, n, place, label, hub, bits]
        self.cell, self.node, self.n, self.place, self.label, self.hub, self.bits = self.columns

    def sorted(self, *by) -> Entries:
        order = np.lexsort(by)
        return Entries(*(c[order] for c in self.columns))

    def linkable(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the pairs of entries (a, b) of different labels that can have similarity 0.8, if the place where they meet is their first."""
        ok = self.label[a] != self.label[b]
        a, b = a[ok], b[ok]
        both = self.n[a] + self.n[b]
        ok = 9 * np.minimum(self.n[a] - self.place[a], self.n[b] - self.place[b]) >= 4 * both
        a, b, both = a[ok], b[ok], both[ok]
        ok = 9 * np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64) <= both
        return self.node[a[ok]], self.node[b[ok]]


def star_pairs(entries: Entries):
    """Pairs of each entry with its cell's hub, where their labels differ."""
    e = entries.sorted(entries.node, -entries.hub, entries.cell)
    at = np.arange(len(e.cell))
    for k in range(0, len(at), HELD_PAIRS):
        yield e.linkable(at[k : k + HELD_PAIRS], np.searchsorted(e.cell, e.cell[k : k + HELD_PAIRS]))


def cross_pairs(entries: Entries):
    """All pairs of entries of a cell with different labels."""
    e = entries.sorted(entries.label, entries.cell)
    rows = len(e.cell)
    new = np.concatenate(([True], (e.cell[1:] != e.cell[:-1]) | (e.label[1:] != e.label[:-1])))
    run = np.cumsum(new) - 1
    later = np.append(np.flatnonzero(new)[1:], rows)[run]  # the first entry of the next label
    end = np.searchsorted(e.cell, e.cell, side="right")
    at = np.flatnonzero(later < end)
    step = 0
    while len(at):
        for k in range(0, len(at), HELD_PAIRS):
            yield e.linkable(at[k : k + HELD_PAIRS], later[at[k : k + HELD_PAIRS]] + step)
        step += 1
        at = at[later[at] + step < end[at]]


def cells(entries: DataFrame, all_blocks: bool) -> DataFrame:
    """``entries`` (token, m, node, n, place, label, hub, bits) under the cells each stands in.

    A bucket of ``m`` entries, too many, is dealt in blocks. With ``all_blocks``, by the label, an
    entry stands in a cell for each block, so that every two blocks meet; without, by the node, in its
    own block's cell, and the hubs of the blocks in the bucket's.
    """
    columns = ["node", "n", "place", "label", "hub", "bits"]
    few = entries.filter(F.col("m") <= BUCKET_ROWS).select(F.col("token").alias("cell"), *columns)
    many = entries.filter(F.col("m") > BUCKET_ROWS).withColumn("blocks", F.ceil(F.col("m") / BUCKET_ROWS).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("label" if all_blocks else "node"), F.col("blocks")).cast("int"))
    if all_blocks:
        met = many.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return few.unionByName(met.select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), *columns))
    hubs = many.groupBy("token", "block").agg(F.max(F.struct("hub", "node", "n", "place", "label", "bits")).alias("h")).select(F.col("token").alias("cell"), *(F.col(f"h.{c}") for c in columns))
    return few.unionByName(many.select(F.xxhash64("token", "block").alias("cell"), *columns)).unionByName(hubs)


def candidates(entries: DataFrame, rows: int, pairs, all_blocks: bool) -> DataFrame:
    """Pairs (u, v), u > v, of ``entries`` that ``pairs`` finds in the cells."""
    partitions = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))

    @lean
    def run(batches):
        parts = []
        for b in batches:
            if b.num_rows:
                bits = np.frombuffer(b"".join(b.column(6).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
                parts.append([*(b.column(c).to_numpy() for c in range(6)), bits])
        if not parts:
            return
        found, held = [], 0

        def packed():
            two = np.concatenate(found, axis=1)
            two = two[:, np.lexsort(two)]
            two = two[:, np.concatenate(([True], (two[:, 1:] != two[:, :-1]).any(axis=0)))]
            return pa.RecordBatch.from_arrays([pa.array(two[0].copy()), pa.array(two[1].copy())], ["u", "v"])

        for a, b in pairs(Entries(*(np.concatenate(x) for x in zip(*parts)))):
            if len(a):
                found.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
                held += len(a)
            if held > HELD_PAIRS:
                yield packed()
                found, held = [], 0
        if held:
            yield packed()

    return cells(entries, all_blocks).repartition(partitions, "cell").mapInArrow(run, "u long, v long").distinct()


def shared_entries(lead: DataFrame) -> DataFrame:
    """token, m (its bucket's entries), node, n, place, hub and bits for the prefix shingles of ``lead`` that several sets hold."""
    entries = lead.select("node", F.posexplode("prefix").alias("place", "token"))
    buckets = durable(entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-buckets")
    met = durable(entries.join(broadcast_if_small(buckets, buckets.count(), 16), "token"), "shared-shingles")
    hubs = met.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    named = lead.join(hubs, "node").select("node", "n", "bits", (F.col("c") / F.size("prefix")).alias("hub"))
    entries = durable(met.join(named, "node").select("token", "m", "node", "n", F.col("place").cast("long").alias("place"), "hub", "bits"), "shared-entries")
    release(buckets, met)
    return entries


def simhash_links(lead: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets of ``lead`` (node, fp) whose fingerprints are within ``RADIUS`` bits."""
    nodes = durable(lead.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-nodes")
    equal = lead.select("fp", F.col("node").alias("u")).join(nodes.withColumnRenamed("node", "v"), "fp").filter("u <> v").select("u", "v")
    links = near_links(nodes, RADIUS, True).unionByName(equal)
    pairs = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-pairs")
    release(nodes)
    return pairs


def verified(pairs: DataFrame, named: DataFrame, leads: DataFrame, repeated: bool) -> DataFrame:
    """A table of those ``pairs`` (u, v) whose whole sets have similarity 0.8 or more; ``pairs`` is a table that goes.

    ``named`` has doc_id, key and text of all rows; ``leads`` (node, late, key) tells which row stands for a node.
    Where documents are ``repeated`` on several rows, one of them gives the set.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    met = durable(leads.join(ends, "node"), "pair-ends")
    rows = named.withColumn("late", F.coalesce("doc_id", F.lit(0))).join(broadcast_if_small(met, met.count(), 64), ["late", "key"])
    sets = shingle_sets(rows)
    sets = durable(sets.dropDuplicates(["node"]) if repeated else sets, "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    links = durable(both.filter(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v").distinct(), "links")
    release(pairs, met, sets)
    return links


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key, head_id and head_key of each row: the least (id, key) that links of five-word similarity 0.8 reach."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text"))
    sets = durable(prefixes(named, *common_shingles(named, named.count())), "prefixes")
    repeated = sets.count() > sets.select(F.coalesce("doc_id", F.lit(0)), "key").distinct().count()
    own = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    # Prefixes and sizes follow the set; a number for each set, fixed once written, names it from here on.
    lead = sets.groupBy("digest").agg(F.min(own).alias("head"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "bits", "prefix")))
    lead = durable(lead.withColumn("node", F.monotonically_increasing_id()), "set-leads")
    entries = shared_entries(lead)
    size = entries.count()
    leads = lead.select("node", F.coalesce("head.doc_id", F.lit(0)).alias("late"), "head.key")
    links = verified(simhash_links(lead), named, leads, repeated)
    moved = durable(components(links), "copy-components")
    for pairs, all_blocks in ((star_pairs, False), (cross_pairs, True)):
        # What earlier rounds joined has one label, and no pair of it is proposed again.
        labelled = entries.join(broadcast_if_small(moved, moved.count(), 24), "node", "left").withColumn("label", F.coalesce("component", "node"))
        more = durable(candidates(labelled, size, pairs, all_blocks), "pairs")
        release(moved)
        links = links.unionByName(verified(more, named, leads, repeated))
        moved = durable(components(links), "copy-components")
    release(entries)
    # Only sets that are linked need the head of their component.
    members = moved.unionByName(moved.select(F.col("component").alias("node"), "component").distinct())
    n = moved.count()
    heads = durable(members.join(lead.select("node", "head"), "node").groupBy("component").agg(F.min("head").alias("least")), "heads")
    settled = lead.select("digest", "node", "head").join(broadcast_if_small(moved, n, 24), "node", "left").withColumn("component", F.coalesce("component", "node"))
    settled = settled.join(broadcast_if_small(heads, heads.count(), 64), "component", "left")
    head = F.coalesce("least", "head")
    settled = durable(settled.select("digest", head["doc_id"].alias("head_id"), head["key"].alias("head_key")), "set-heads")
    return sets.select("doc_id", "key", "digest").join(broadcast_if_small(settled, settled.count(), 96), "digest").select("doc_id", "key", "head_id", "head_key")
