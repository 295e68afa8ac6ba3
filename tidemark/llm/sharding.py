"""A hierarchical weighted hash tree: regions hold racks, racks hold shards.

Every node has a draw of its own for a key, from a hash of the key and the node's path, as an exponential variable of the
node's weight; a key descends to the child with the smallest draw. A level looks at the children of one node alone, and a
change of weights alters the draws of the nodes above the change and no others: keys move only into a subtree that has
gained weight, or out of one that has lost some.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table, text_of

#: Rows that one task numbers at most, about.
RUN_ROWS = 4096


@dataclass(frozen=True)
class Leaf:
    """A shard at its place in the tree. The weight of a rack or region is the sum of its shards' weights."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """``shards`` shards: dealt over ``regions`` x ``racks`` until racks are full, then each in a region of its own. The
    place of a shard depends on its number alone."""
    full = regions * racks * per_rack
    return [Leaf(i % regions, i // regions % racks, i) if i < full else Leaf(i, 0, i) for i in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``leaves`` and one shard more, which opens a region: no draw of the others changes, so keys move into it alone."""
    region, shard = max(x.region for x in leaves) + 1, max(x.shard for x in leaves) + 1
    return [*leaves, Leaf(max(region, shard), 0, shard, weight)]


def _nodes(leaves: list[Leaf], levels: tuple[str, ...] = ("region", "rack", "shard")) -> Column:
    """The tree as one constant: an array of (n, w, kids) per level; (n, w) at the last."""
    groups: dict[int, list[Leaf]] = {}
    for x in leaves:
        groups.setdefault(getattr(x, levels[0]), []).append(x)
    fields = lambda n, own: [F.lit(n).alias("n"), F.lit(float(sum(x.weight for x in own))).alias("w")]
    return F.array(*[F.struct(*fields(n, own), *([_nodes(own, levels[1:]).alias("kids")] if len(levels) > 1 else [])) for n, own in sorted(groups.items())])


def _draw(path: Column, node: Column) -> Column:
    """-ln(u) / weight of a child, with u in (0, 1] from 53 bits of a hash of the path to it."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(path, F.lit("/"), node["n"].cast("string"))), 11).cast("double")
    return -F.log((bits + 1.0) / float(1 << 53)) / node["w"]


def _least(path: Column, kids: Column) -> Column:
    """The child with the smallest draw; among equal ones that of smaller number."""
    return F.array_min(F.transform(kids, lambda k: F.struct(_draw(path, k).alias("d"), k["n"].alias("n"), k.alias("node"))))["node"]


def assign(df: DataFrame, key: Column, trees: dict[str, list[Leaf]]) -> DataFrame:
    """``df`` with one column per tree: the shard (int) of ``key``. A null key is a key of its own.

    Equal keys go to equal shards. Shards of weight 0 get nothing; a tree needs a positive weight. Other columns of any
    name stay as they are; an empty table gives no rows.
    """
    path, node = fresh([*df.columns, *trees], "path", "node")
    out = df
    for name, leaves in trees.items():
        leaves = [x for x in leaves if x.weight > 0]
        if not leaves:
            raise ValueError(f"no shard of tree {name!r} has any weight")
        kids = _nodes(leaves)
        out = out.withColumn(path, F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")))
        for level in range(3):
            out = out.withColumn(node, _least(F.col(path), kids if level == 0 else F.col(node)["kids"]))
            out = out.withColumn(path, F.concat(F.col(path), F.lit("/"), F.col(node)["n"].cast("string")))
        out = out.withColumn(name, F.col(node)["n"]).drop(path, node)
    return out


def slots(written: DataFrame, shard: str, rows: int, shards: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """``written`` with ``slot``: a number from 0 without gaps within each shard, by the rows' places in the table.

    A shard is cut into runs, stretches of the table that are dealt by a hash; runs are counted, their offsets summed, and
    rows numbered within runs. So no task holds a shard, nor all rows of one key. ``written`` must be a table that has
    been written (see :func:`cut`): the places of its rows do not change.
    """
    place, run, before, count, row = fresh(written.columns, "place", "run", "before", "count", "row")
    runs = max(1, -(-rows // (shards * run_rows)))
    placed = written.withColumn(place, F.monotonically_increasing_id())
    placed = placed.withColumn(run, F.pmod(F.xxhash64(F.shiftright(place, 8)), F.lit(runs)))
    within = Window.partitionBy(shard, run).orderBy(place)
    counted = placed.groupBy(shard, run).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(shard).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(shard, run, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    numbered = placed.withColumn(row, F.row_number().over(within) - 1)
    return numbered.join(offsets, [shard, run]).withColumn("slot", F.col(row) + F.col(before)).drop(place, run, row, before)


def op2_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in ``shards`` shards under the law ``key``, and where each goes with one shard more.

    A null doc_id is a key; repeated doc_ids go to one shard; null and empty texts have size 1 and checksum 0; an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of()).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    docs = docs.withColumn("size", F.col("size") + 1)
    placed = cut(assign(docs, F.col("doc_id"), {"shard": tree(shards), "grown_shard": grown(tree(shards))}))
    done = slots(placed, "shard", placed.count(), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
