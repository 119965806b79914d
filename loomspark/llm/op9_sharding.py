"""Sharding by a hierarchical weighted hash tree, natively.

A row descends region, rack and shard; at each level every child draws ``ln(u) / weight`` from a
hash of the row's id and the child's name, and the greatest draw wins. A child's draw depends on
nothing but itself, so a changed weight moves rows only into or out of that child's subtree. A
tree grows by a region of its own for the new shard: no other draw changes, so rows move into
the new shard alone.

The law is ``key``: the id and the number of shards decide. Rows of equal text therefore need not
meet in one shard; rows of equal id always do.

Slots are gapless from 0 within a shard. They are taken in hash buckets with prefix counts, so
that no shard is ranked by one task; the table of prefix counts has shards * buckets rows,
whatever the input holds.

Edge cases: a null text has size 1 and the CRC of the empty string; a null id draws like the
empty string; repeated rows share a shard and get slots of their own; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, text_or_empty

N_SHARDS = 16
BUCKETS = 1024
_UNIT = float(1 << 52)


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and a weight; other nodes weigh what their children do."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(n_shards: int, base: int = N_SHARDS, per_rack: int = 4, racks: int = 2) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards for the first ``base`` shards; a region each for those beyond."""
    shards = [Node(f"s{i}", shard=i) for i in range(n_shards)]
    held = [shards[i : i + per_rack] for i in range(0, min(n_shards, base), per_rack)]
    nodes = [Node(f"k{i}", tuple(x)) for i, x in enumerate(held)]
    regions = [Node(f"r{i // racks}", tuple(nodes[i : i + racks])) for i in range(0, len(nodes), racks)]
    extra = [Node(f"r+{s.shard}", (Node(f"k+{s.shard}", (s,)),)) for s in shards[base:]]
    return Node("root", (*regions, *extra))


def _draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{node.name}")).cast("binary")), 1, 13)
    return F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(_UNIT)) / F.lit(float(node.weight))


def descend(df: DataFrame, top: Node, name: str, key: str = "_key") -> DataFrame:
    """Add the shard of ``key`` (a string column) as ``name``, level by level so that each draw is made once."""
    level, at = [((), top)], f"_{name}_at"
    df = df.withColumn(at, F.lit("")).withColumn(name, F.lit(-1))
    while any(n.children for _, n in level):
        chosen: Column = F.col(at)
        shard: Column = F.col(name)
        below = []
        for path, node in level:
            here = F.col(at) == "".join(f"{i}." for i in path)
            if not node.children:
                continue
            draws = [F.struct(_draw(F.col(key), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
            best = (F.greatest(*draws) if len(draws) > 1 else draws[0])["i"]
            chosen = F.when(here, F.concat(F.col(at), best.cast("string"), F.lit("."))).otherwise(chosen)
            below += [((*path, i), c) for i, c in enumerate(node.children)]
        df = df.withColumn(at, chosen)
        for path, node in below:
            if not node.children:
                shard = F.when(F.col(at) == "".join(f"{i}." for i in path), F.lit(node.shard)).otherwise(shard)
        df = df.withColumn(name, shard)
        level = below
    return df.drop(at)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (where the row goes with one more shard)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = descend(rows, tree(n_shards), "shard")
    rows = descend(rows, tree(n_shards + 1), "grown_shard")
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("bucket/"), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("shard", "_bucket").count()
    before = counts.select("shard", "_bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(broadcast_if_small(before, n_shards * buckets, 24), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_rank") + F.col("_before")).alias("slot"), "grown_shard"
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle_descent(source: str, top: Node, name: str) -> str:
    """DuckDB: the same descent, a level a subquery; the place of the greatest draw among a node's children."""
    level, sql = [("", top)], f"SELECT *, '' AS spot FROM ({source}) s0"
    while any(n.children for _, n in level):
        cases, below = [], []
        for path, node in level:
            if not node.children:
                continue
            draws = ", ".join(f"ln((('0x' || substr(md5(k || '/{c.name}'), 1, 13))::BIGINT + 0.5) / {_UNIT}) / {float(c.weight)}" for c in node.children)
            cases.append(f"WHEN spot = '{path}' THEN spot || (list_position([{draws}], list_max([{draws}])) - 1) || '.'")
            below += [(f"{path}{i}.", c) for i, c in enumerate(node.children)]
        sql = f"SELECT * EXCLUDE (spot), CASE {' '.join(cases)} ELSE spot END AS spot FROM ({sql}) s"
        level = below + [(p, n) for p, n in level if not n.children]
    leaves = " ".join(f"WHEN '{p}' THEN {n.shard}" for p, n in level)
    return f"SELECT * EXCLUDE (spot), CASE spot {leaves} END AS {name} FROM ({sql}) t"


# CRC-32 over UTF-8 bytes: the byte table comes from the polynomial.
_ORACLE_ROWS = """
    SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(coalesce(text, '')), (2 * i + 1)::INT, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM documents, (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))) AS tbl) p"""

ORACLE_SQL = f"""
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('bucket/' || k), 1, 8))::BIGINT % {BUCKETS}, doc_id, text_crc32, size) - 1 AS slot
FROM ({_oracle_descent(_oracle_descent(_ORACLE_ROWS, tree(N_SHARDS), "shard"), tree(N_SHARDS + 1), "grown_shard")}) r"""
