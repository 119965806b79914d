"""Cropped and edited copies in a media column, by local image descriptors.

Images of equal bytes collapse first. The rest get corners at several scales (Harris response,
local maxima), an orientation from the intensity centroid, and 256 binary tests turned to that
orientation. Tables keyed by fixed samples of the bits join corners of different images; a pair of
images with a corner pair within ``MAX_DISTANCE`` bits is proposed. A proposed pair is judged on all
its corners: those within that distance vote for the similarity that carries one onto the other, and
the images agree if enough corners vote for one scale, rotation and shift. Agreements and equal bytes
are joined into components.

Every bucket of a table is searched twice. First each entry meets the bucket's hub, the image with the
most shared keys, so that a dense group of copies is joined by a pair per entry; then all entries of
images not yet joined meet. A bucket of over ``BUCKET_ROWS`` entries is dealt in blocks, and each pair
of blocks is a cell of its own. Buckets of one image go first.

Two images can be linked through a third. The bit samples make the proposals approximate: a pair that
agrees has ``LEAST_VOTES`` close corners at least, of which one has to share a key. The tests measure
recall against all pairs.

Media are binary PGM or PPM up to 8 bits, and PNG of 8 bits without interlace or palette; anything
else counts as not decoded (``decoded`` is false) and is a copy of equal bytes only.

Edge cases: null or undecodable media have no corners (nulls are copies of nothing); flat images
likewise; ties take the smaller id; of an id on several rows each row is an image of its own; rows
without an id go; an empty table gives no rows; other columns of the input are ignored.

The given tables hold no images, so the query renders each row of ``embeddings`` to one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, release
from .components import components

SCALES = (1.0, 1.5, 2.25)
BITS = 256
#: Radius of the orientation patch, of the tests, and the border corners keep from the edge.
PATCH, REACH, BORDER = 7, 9, 11
#: Response of a corner, at least, as a share of the image's strongest.
LEAST_RESPONSE = 0.1
#: Bit samples (tables) and their width.
TABLES, TABLE_BITS = 6, 24
#: Full Hamming distance of a match, at most; corners that must vote for one similarity.
MAX_DISTANCE, LEAST_VOTES = 24, 4
#: Entries of a bucket beyond which it is dealt in blocks; pairs compared at once; rows aimed at for a partition.
BUCKET_ROWS, PAIR_ROWS, PARTITION_ROWS = 4_000, 1 << 18, 300_000
#: Votes fall in bins of this rotation (degrees), scale (octaves) and shift (pixels), on two grids half a bin apart.
ROTATION_BIN, SCALE_BIN, SHIFT_BIN = 30.0, 0.6, 10.0
#: Digests a task remembers, so that equal images are described once.
SEEN = 100_000


_GAP = rb"(?:\s|#[^\n]*\n)+"
_PNM = re.compile(rb"(P[56])" + _GAP + rb"(\d{1,6})" + _GAP + rb"(\d{1,6})" + _GAP + rb"(\d{1,5})\s")


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey image of a binary PGM or PPM, or of an 8-bit PNG without interlace; None for anything else."""
    try:
        if head := _PNM.match(media):
            w, h, top = (int(head[k]) for k in (2, 3, 4))
            planes = 1 if head[1] == b"P5" else 3
            pixels = np.frombuffer(media, np.uint8, w * h * planes, head.end()).reshape(h, w, planes)
            return pixels.mean(axis=2).astype(np.float32) * (255.0 / top) if 0 < top <= 255 else None
        if media[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(media)
    except (ValueError, IndexError, TypeError, struct.error, zlib.error, KeyError):
        pass
    return None


def _decode_png(media: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", media[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += media[at + 8 : at + 8 + size]
        at += size + 12
    w, h, depth, colour, _, _, interlace = head
    planes = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        return None
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * planes + 1)
    out = np.zeros((h, w * planes), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        up = out[y - 1] if y else np.zeros(w * planes, np.uint8)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        else:
            for x in range(w * planes):
                a = int(out[y, x - planes]) if x >= planes else 0
                b, c = int(up[x]), int(up[x - planes]) if x >= planes else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                out[y, x] = (int(line[x]) + p) & 255
    pixels = out.reshape(h, w, planes)
    return pixels[:, :, : 1 if planes < 3 else 3].mean(axis=2).astype(np.float32)


@lru_cache(maxsize=1)
def _pattern() -> np.ndarray:
    """Pairs of test points: 256 x 2 x (x, y), Gaussian about the corner."""
    rng = np.random.default_rng(11)
    points = rng.normal(0, REACH / 2, (4 * BITS, 2, 2))
    points = points[(np.linalg.norm(points, axis=2) <= REACH).all(axis=1) & (np.linalg.norm(points[:, 0] - points[:, 1], axis=1) > 2)]
    return points[:BITS]


@lru_cache(maxsize=1)
def _samples() -> np.ndarray:
    rng = np.random.default_rng(5)
    return np.array([np.sort(rng.choice(BITS, TABLE_BITS, replace=False)) for _ in range(TABLES)])


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        pad = np.pad(x, [(0, 0)] + [(1, 1) if a == axis else (0, 0) for a in (1, 2)], mode="edge")
        part = lambda s: np.take(pad, range(s, s + x.shape[axis]), axis=axis)
        x = (part(0) + 2 * part(1) + part(2)) / 4
    return x


def _resize(x: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1:
        return x
    for axis in (1, 2):
        n = x.shape[axis]
        at = np.clip((np.arange(int(n / factor)) + 0.5) * factor - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, part = np.minimum(low + 1, n - 1), (at - low).astype(np.float32)
        shape = [1, 1, 1]
        shape[axis] = -1
        part = part.reshape(shape)
        x = np.take(x, low, axis=axis) * (1 - part) + np.take(x, high, axis=axis) * part
    return x


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of the local maxima of the Harris response, clear of the border."""
    dy, dx = np.gradient(x, axis=(1, 2))
    a, b, c = (_blur(_blur(p)) for p in (dx * dx, dy * dy, dx * dy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    best = response
    for axis in (1, 2):
        best = np.maximum.reduce([np.roll(best, s, axis=axis) for s in (-2, -1, 0, 1, 2)])
    strong = np.maximum(response.max(axis=(1, 2), keepdims=True) * LEAST_RESPONSE, 25.0)
    found = (response == best) & (response > strong)
    found[:, :BORDER] = found[:, -BORDER:] = found[:, :, :BORDER] = found[:, :, -BORDER:] = False
    return np.nonzero(found)


def describe(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a stack of images of one shape: image, x, y, scale, angle (degrees) and bits (K x 256) of every corner."""
    out = []
    dy, dx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    inside = dx**2 + dy**2 <= PATCH**2
    dx, dy = dx[inside], dy[inside]
    first = _blur(images.astype(np.float32))
    for scale in SCALES:
        x = _resize(first, scale)
        if min(x.shape[1:]) <= 2 * BORDER:
            break
        x = _blur(x)
        n, r, c = corners(x)
        for s in range(0, len(n), 4096):
            i, y0, x0 = n[s : s + 4096], r[s : s + 4096], c[s : s + 4096]
            patch = x[i[:, None], y0[:, None] + dy, x0[:, None] + dx]
            angle = np.arctan2(patch @ dy.astype(np.float32), patch @ dx.astype(np.float32))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px, py = _pattern()[None, :, :, 0], _pattern()[None, :, :, 1]
            tx = np.rint(x0[:, None, None] + px * cos - py * sin).astype(int)
            ty = np.rint(y0[:, None, None] + px * sin + py * cos).astype(int)
            tests = x[i[:, None, None], ty, tx]
            out.append((i, (x0 + 0.5) * scale, (y0 + 0.5) * scale, np.full(len(i), scale), np.degrees(angle), tests[:, :, 0] < tests[:, :, 1]))
    if not out:
        return tuple(np.zeros((0, BITS) if k == 5 else 0) for k in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


#: One row for each row of media. n: corners, -1 if not decoded, null if the task has described equal bytes before.
DESCRIBED = "media_id long, digest binary, n int, spots binary, desc binary, keys array<int>"


def described(media: DataFrame) -> DataFrame:
    """``DESCRIBED`` of ``media`` (media_id, media): x, y, scale and angle (float) of each corner, its bits and its keys."""

    def run(batches):
        seen: OrderedDict[bytes, None] = OrderedDict()

        def row(blob, digest):
            if blob is None:
                return 0, None
            if digest in seen:
                seen.move_to_end(digest)
                return None, None
            seen[digest] = None
            if len(seen) > SEEN:
                seen.popitem(last=False)
            image = decode(blob)
            return (-1, None) if image is None or not image.size else (0, image)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                blobs = part.column(1).to_pylist()
                digests = [None if b is None else hashlib.sha256(b).digest() for b in blobs]
                out = [[None if d is None else d, *row(b, d), b"", b"", []] for b, d in zip(blobs, digests)]
                shapes: dict[tuple, list[int]] = {}
                for i, r in enumerate(out):
                    if r[2] is not None:
                        shapes.setdefault(r[2].shape, []).append(i)
                for held in shapes.values():
                    n, x, y, scale, angle, bits = describe(np.stack([out[i][2] for i in held]))
                    spots = np.stack([x, y, scale, angle], axis=1).astype(np.float32)
                    keys = np.stack([bits[:, s] @ (1 << np.arange(TABLE_BITS)) + (k << TABLE_BITS) for k, s in enumerate(_samples())], axis=1).astype(np.int32) if len(n) else np.zeros((0, TABLES), np.int32)
                    packed = np.packbits(bits.astype(bool), axis=1)
                    for k, i in enumerate(held):
                        mine = np.flatnonzero(n == k)
                        out[i][1], out[i][3:] = len(mine), [spots[mine].tobytes(), packed[mine].tobytes(), keys[mine].ravel()]
                columns = [part.column(0), *(pa.array([r[k] for r in out], t) for k, t in ((0, pa.binary()), (1, pa.int32()), (3, pa.binary()), (4, pa.binary()), (5, pa.list_(pa.int32()))))]
                yield pa.RecordBatch.from_arrays(columns, ["media_id", "digest", "n", "spots", "desc", "keys"])

    return media.select("media_id", "media").mapInArrow(run, DESCRIBED)


class Entries:
    """Corners under the cells they stand in, as columns: cell, node, corner, label, hub and bits."""

    def __init__(self, cell, node, corner, label, hub, bits):
        self.columns = [cell, node, corner, label, hub, bits]
        self.cell, self.node, self.corner, self.label, self.hub, self.bits = self.columns

    def sorted(self, *by) -> Entries:
        order = np.lexsort(by)
        return Entries(*(c[order] for c in self.columns))

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the pairs of entries (a, b) of different images within ``MAX_DISTANCE``."""
        near = (self.node[a] != self.node[b]) & (np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64) <= MAX_DISTANCE)
        return self.node[a[near]], self.node[b[near]]


def star_pairs(entries: Entries):
    """Pairs of each entry with the hub of its cell."""
    e = entries.sorted(entries.node, -entries.hub, entries.cell)
    at = np.arange(len(e.cell))
    for k in range(0, len(at), PAIR_ROWS):
        yield e.close(at[k : k + PAIR_ROWS], np.searchsorted(e.cell, e.cell[k : k + PAIR_ROWS]))


def cross_pairs(entries: Entries):
    """All pairs of entries of a cell with different labels."""
    e = entries.sorted(entries.label, entries.cell)
    new = np.concatenate(([True], (e.cell[1:] != e.cell[:-1]) | (e.label[1:] != e.label[:-1])))
    later = np.append(np.flatnonzero(new)[1:], len(e.cell))[np.cumsum(new) - 1]  # the first entry of the next label
    end = np.searchsorted(e.cell, e.cell, side="right")
    at, step = np.flatnonzero(later < end), 0
    while len(at):
        for k in range(0, len(at), PAIR_ROWS):
            yield e.close(at[k : k + PAIR_ROWS], later[at[k : k + PAIR_ROWS]] + step)
        step += 1
        at = at[later[at] + step < end[at]]


def cells(entries: DataFrame, all_blocks: bool) -> DataFrame:
    """``entries`` (key, m, node, corner, label, hub, desc) under the cells each stands in.

    A bucket of ``m`` entries, too many, is dealt in blocks by the label. With ``all_blocks`` an entry
    stands in a cell for each block, so that every two blocks meet; without, in its own block's cell,
    and the hubs of the blocks in the bucket's.
    """
    columns = ["node", "corner", "label", "hub", "desc"]
    few = entries.filter(F.col("m") <= BUCKET_ROWS).select(F.col("key").cast("long").alias("cell"), *columns)
    many = entries.filter(F.col("m") > BUCKET_ROWS).withColumn("blocks", F.ceil(F.col("m") / BUCKET_ROWS).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int"))
    if all_blocks:
        met = many.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return few.unionByName(met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), *columns))
    hubs = many.groupBy("key", "block").agg(F.max(F.struct("hub", "node", "corner", "label", "desc")).alias("h")).select(F.col("key").cast("long").alias("cell"), *(F.col(f"h.{c}") for c in columns))
    return few.unionByName(many.select(F.xxhash64("key", "block").alias("cell"), *columns)).unionByName(hubs)


def proposals(entries: DataFrame, rows: int, pairs, all_blocks: bool) -> DataFrame:
    """Pairs (u, v), u > v, of images with a close pair of corners that ``pairs`` finds in the cells."""
    partitions = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))

    def run(batches):
        parts = []
        for b in batches:
            if b.num_rows:
                bits = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
                parts.append([*(b.column(c).to_numpy() for c in range(5)), bits])
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
            if held > PAIR_ROWS:
                yield packed()
                found, held = [], 0
        if held:
            yield packed()

    return cells(entries, all_blocks).repartition(partitions, "cell").mapInArrow(run, "u long, v long").distinct()


def few_partners(pairs: DataFrame) -> DataFrame:
    """Of an image's pairs with hubs at most three, which join a dense group as well; whatever that leaves apart meets again in the second search."""
    chosen = pairs.groupBy("u").agg(F.array_distinct(F.array(F.min("v"), F.max("v"), F.min_by("v", F.xxhash64("u", "v")))).alias("v"))
    return chosen.select("u", F.explode("v").alias("v"))


def agree(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether enough corners of two images (spots, bits) vote for one similarity."""
    (p, x), (q, y) = a, b
    if not len(x) or not len(y):
        return False
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2, dtype=np.int64) <= MAX_DISTANCE)
    if len(i) < LEAST_VOTES:
        return False
    p, q = p[i].astype(np.float64), q[j].astype(np.float64)
    turn, grow = np.mod(q[:, 3] - p[:, 3], 360.0), q[:, 2] / p[:, 2]
    cos, sin = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    shift_x = q[:, 0] - grow * (cos * p[:, 0] - sin * p[:, 1])
    shift_y = q[:, 1] - grow * (sin * p[:, 0] + cos * p[:, 1])
    for g in (0.0, 0.5):
        bins = np.stack([np.mod(np.floor(turn / ROTATION_BIN + g), round(360 / ROTATION_BIN)), np.floor(np.log2(grow) / SCALE_BIN + 0.5 + g), np.floor(shift_x / SHIFT_BIN + g), np.floor(shift_y / SHIFT_BIN + g)], axis=1)
        _, which = np.unique(bins, axis=0, return_inverse=True)
        which = which.ravel()
        # A corner votes once in a bin, on either side.
        votes = [np.bincount(np.unique(np.stack([which, side]), axis=1)[0], minlength=which.max() + 1) for side in (i, j)]
        if np.minimum(*votes).max() >= LEAST_VOTES:
            return True
    return False


def agreements(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """A table of those ``pairs`` (u, v) of images that agree; ``pairs`` is a table that goes."""
    own = classes.select("node", F.struct("spots", "desc").alias("image"))
    both = pairs.join(own.withColumnsRenamed({"node": "u", "image": "one"}), "u").join(own.withColumnsRenamed({"node": "v", "image": "two"}), "v")

    def image(spots, desc):
        return np.frombuffer(spots, np.float32).reshape(-1, 4), np.frombuffer(desc, np.uint64).reshape(-1, BITS // 64)

    def run(batches):
        for batch in batches:
            sides = [[image(s, d) for s, d in zip(*(batch.column(c).field(k).to_pylist() for k in (0, 1)))] for c in ("one", "two")]
            yield batch.select(["u", "v"]).filter(pa.array([agree(a, b) for a, b in zip(*sides)], pa.bool_()))

    links = durable(both.select("u", "v", "one", "two").mapInArrow(run, "u long, v long"), "agreements")
    release(pairs)
    return links


def shared_entries(classes: DataFrame) -> DataFrame:
    """key, m (its bucket's entries), node, corner, hub and desc of the corners of ``classes`` under keys of several images."""
    entries = classes.select("node", F.posexplode("keys").alias("at", "key")).select("key", "node", (F.col("at") / TABLES).cast("int").alias("corner"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    buckets = durable(buckets.select("key", "m"), "buckets")
    shared = durable(entries.join(broadcast_if_small(buckets, buckets.count(), 16), "key"), "shared-keys")
    hubs = shared.groupBy("node").agg(F.count(F.lit(1)).alias("hub"))
    named = hubs.join(classes.select("node", "desc"), "node")
    width = BITS // 8
    bits = F.expr(f"substring(desc, corner * {width} + 1, {width})")
    out = durable(shared.join(named, "node").select("key", "m", "node", "corner", "hub", bits.alias("desc")), "shared-corners")
    release(buckets, shared)
    return out


def find_copies(media: DataFrame) -> DataFrame:
    """media_id, decoded, n_corners, n_links (agreements found of its class with others), component_id for each row of ``media`` (media_id, media)."""
    named = media.filter("media_id IS NOT NULL").select(F.col("media_id").cast("long").alias("media_id"), "media")
    rows = durable(described(named).withColumn("class", F.coalesce("digest", F.concat(F.lit("null/"), F.col("media_id").cast("string")).cast("binary"))), "described")
    told = rows.groupBy("class").agg(F.min("media_id").alias("head"), F.max("n").alias("n"), *(F.max_by(c, F.coalesce("n", F.lit(-2))).alias(c) for c in ("spots", "desc", "keys")))
    classes = durable(told.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = shared_entries(classes.filter("n > 0"))
    size = entries.count()
    star = few_partners(proposals(entries.withColumn("label", F.col("node")), size, star_pairs, False))
    links = agreements(durable(star, "first-proposals"), classes)
    moved = durable(components(links), "first-components")
    labelled = entries.join(broadcast_if_small(moved, moved.count(), 24), "node", "left").withColumn("label", F.coalesce("component", "node"))
    rest = durable(proposals(labelled, size, cross_pairs, True), "proposals")
    release(entries)
    links = links.unionByName(agreements(rest, classes))
    moved = durable(components(links), "components")
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("class", "head", "n", "node")
    members = moved.unionByName(moved.select(F.col("component").alias("node"), "component").distinct())
    heads = durable(members.join(named, "node").groupBy("component").agg(F.min("head").alias("least")), "heads")
    settled = named.join(broadcast_if_small(moved, moved.count(), 24), "node", "left").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node"))
    settled = settled.join(broadcast_if_small(heads, heads.count(), 24), "component", "left")
    settled = settled.select("class", (F.col("n") >= 0).alias("decoded"), F.greatest("n", F.lit(0)).alias("n_corners"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "head").alias("component_id"))
    settled = durable(settled, "settled")
    out = rows.select("media_id", "digest", "class").join(broadcast_if_small(settled, settled.count(), 80), "class")
    return out.select("media_id", (F.col("decoded") & F.col("digest").isNotNull()).alias("decoded"), F.col("n_corners").cast("long").alias("n_corners"), "n_links", "component_id")


SIDE = 64


@lru_cache(maxsize=4)
def _basis(width: int) -> np.ndarray:
    """One smooth fixed pattern for each component."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(width, SIDE, SIDE)).astype(np.float32)
    for _ in range(3):
        x = _blur(x)
    return (x / x.std()).reshape(width, -1)


def render(vectors: DataFrame) -> DataFrame:
    """media_id and media (a binary PGM of 64 x 64) from vec_id and embedding; null where the vector cannot be drawn."""

    def draw(v) -> bytes | None:
        if not v or any(x is None for x in v):
            return None
        x = np.array(v, dtype=np.float64)
        if not np.isfinite(x).all() or not x.any():
            return None
        x = (x / np.linalg.norm(x)) @ _basis(len(x))
        return b"P5\n%d %d\n255\n" % (SIDE, SIDE) + np.clip(128 + 45 * x, 0, 255).astype(np.uint8).tobytes()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([draw(v) for v in part.column(1).to_pylist()], pa.binary())], ["media_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "media_id long, media binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return find_copies(render(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
