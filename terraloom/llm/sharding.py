"""Operator 3: a hierarchical weighted hash tree deals rows to shards.

Every row draws, at each level of the tree (region, rack, shard), one exponential variate per
child, from a hash of the row's key and the child's name, over the child's weight. The
smallest draw wins, so a child gets rows in proportion to its weight, and a changed weight moves rows only into or
out of the subtrees whose weights changed. Work per row is the sum of the fan-outs on its way.
Slots are numbered without a global sort: rows are ranked in small hashed blocks, and each
block starts at the running total of the blocks before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import UNIT_SQL, durable, let, unit_hash

SHARDS = 40
RACK_SHARDS = 4
REGION_RACKS = 2
OVERHEAD_BYTES = 16
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """Weights of the shards, and how many shards a rack and racks a region hold."""

    weights: tuple[float, ...]
    rack_shards: int = RACK_SHARDS
    region_racks: int = REGION_RACKS

    @classmethod
    def even(cls, shards: int, **kw: int) -> Tree:
        return cls((1.0,) * shards, **kw)

    def levels(self) -> list[list[list[tuple[int, float]]]]:
        """For each level, for each parent, its children as (id, weight)."""
        shards = list(enumerate(map(float, self.weights)))
        racks = [shards[i : i + self.rack_shards] for i in range(0, len(shards), self.rack_shards)]
        sums = [(k, sum(w for _, w in x)) for k, x in enumerate(racks)]
        regions = [sums[i : i + self.region_racks] for i in range(0, len(sums), self.region_racks)]
        return [[[(r, sum(w for _, w in x)) for r, x in enumerate(regions)]], regions, racks]


def _children(parents: list[list[tuple[int, float]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("w")) for i, w in x]) for x in parents])


def _draw(key: Column, level: int, child: Column) -> Column:
    """An exponential variate of rate child.w, from a hash of key, level and child.id."""
    return -F.log(unit_hash(key, str(level), child["id"])) / child["w"]


def place(key: Column, tree: Tree) -> Column:
    """The shard (int) of a row. A child of weight 0 gets none. A null key is a key like others."""
    key = F.coalesce(key.cast("string"), F.lit("\x00"))

    def descend(level: int, parents: list[list[tuple[int, float]]], at: Column) -> Column:
        live = F.filter(F.get(_children(parents), at), lambda c: c["w"] > 0)
        return F.array_min(F.transform(live, lambda c: F.struct(_draw(key, level, c).alias("draw"), c["id"].alias("id"))))["id"]

    regions, racks, shards = tree.levels()
    return let(let(descend(0, regions, F.lit(0)), lambda r: descend(1, racks, r)), lambda k: descend(2, shards, k)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", weights: tuple[float, ...] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row.

    size is the UTF-8 bytes of the text (null: 0) plus 16; text_crc32 of a null text is that
    of the empty one. law is `key`: key and shard count decide. grown_shard is where the row
    lies with one more shard of weight 1, which is in a region or rack of its own as soon as
    the ones before it are full (as at 40), and then takes rows only into itself; in a rack
    that has shards already, rows move only within and into the subtrees it belongs to.
    Repeated rows get slots of their own, in any order among themselves.
    """
    tree = Tree(weights or (1.0,) * shards)
    grown = Tree((*tree.weights, 1.0))
    known = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(known) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(known).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col(key), tree).alias("shard"),
        place(F.col(key), grown).alias("grown_shard"),
    )
    rows = durable(rows)
    blocks = max(1, -(-rows.count() // (len(tree.weights) * BLOCK_ROWS)))
    rows = rows.withColumn("block", F.floor(unit_hash(F.col("id"), "block", F.col("text_crc32")) * blocks).cast("int"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")) - 1)
    starts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    return ranked.join(starts, ["shard", "block"]).select(F.col("id").alias(key), "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def oracle(shards: int = SHARDS) -> str:
    """SQL of shard() with even weights: the same tree as tables of children, and CRC-32 byte by byte."""

    def children(tree: Tree) -> list[str]:
        regions, racks, leaves = tree.levels()
        rows = [", ".join(f"({p}, {i}, {w})" for p, group in enumerate(level) for i, w in group) for level in (regions, racks, leaves)]
        return [f"(SELECT * FROM (VALUES {r}) AS t(parent, id, w))" for r in rows]

    def descend(name: str, tree: Tree) -> str:
        steps, above = [], "(SELECT n, key, 0 AS spot FROM d)"
        for level, table in enumerate(children(tree)):
            hashed = UNIT_SQL.format(f"key || '|{level}|' || id")
            draw = f"-ln({hashed}) / w"
            steps.append(f"{name}{level} AS (SELECT n, key, arg_min(id, {draw}) AS spot FROM {above} JOIN {table} ON parent = spot GROUP BY n, key)")
            above = f"{name}{level}"
        return ", ".join(steps)

    return f"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS key, coalesce(text, '') AS t FROM documents),
sums AS (SELECT n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, crc),
{descend("old", Tree.even(shards))}, {descend("new", Tree.even(shards + 1))},
total AS (SELECT greatest(1, CAST(ceil(count(*) / ({shards} * {BLOCK_ROWS})) AS BIGINT)) AS blocks FROM d),
placed AS (SELECT doc_id, d.key, strlen(t) + 16 AS size, text_crc32, old2.spot AS shard, new2.spot AS grown_shard FROM d JOIN sums USING (n) JOIN old2 USING (n) JOIN new2 USING (n)),
dealt AS (SELECT *, floor({UNIT_SQL.format("key || '|block|' || text_crc32")} * blocks) AS block FROM placed, total)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM dealt"""


ORACLE = oracle()
