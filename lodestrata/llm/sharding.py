"""Shards of near-equal size by k-d tree partitioning, with DataFrame operations only.

The tree is grown level by level for all nodes at once. A node that has to hold k leaves is
cut along its widest metadata dimension at the weighted quantile (k // 2) / k, found by a
radix search: each round sums sizes by node and by the next 12 bits of a 36-bit key (20 bits
of the dimension's place in its range, 16 bits of a hash that breaks ties), so that any
number of equal values can be cut. What reaches the driver is a few numbers per node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, shuffle_partitions, stored

PLACE_BITS, TIE_BITS, ROUND_BITS = 20, 16, 12
ROW_OVERHEAD = 16


@dataclass
class Node:
    """A cell of the tree: its number, how many leaves it holds, and its cut once it has one."""

    number: int
    leaves: int
    dimension: int = 0
    threshold: int = -1
    low: Node | None = None
    high: Node | None = None

    def tree(self) -> list[Node]:
        return [self, *(self.low.tree() if self.low else []), *(self.high.tree() if self.high else [])]


def _lookup(values: list, index: Column) -> Column:
    """The value at the row's own index: one literal array, however many nodes there are."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _place(root: Node, depth: int) -> Column:
    """The number of the cell that a row is in: one step down the tree for each level; a leaf stays."""
    nodes = sorted(root.tree(), key=lambda x: x.number)
    dims = [x.dimension + 1 for x in nodes]
    cuts = [x.threshold for x in nodes]
    low = [x.low.number if x.low else x.number for x in nodes]
    high = [x.high.number if x.high else x.number for x in nodes]

    def step(at: Column, _: Column) -> Column:
        below = F.element_at("ks", _lookup(dims, at)) <= _lookup(cuts, at)
        return F.when(below, _lookup(low, at)).otherwise(_lookup(high, at))

    return F.aggregate(F.array(*[F.lit(i) for i in range(max(1, depth))]), F.lit(0), step)


def _cut(rows: DataFrame, root: Node, depth: int, open_nodes: list[Node], dims: int) -> None:
    """Give each open node its dimension and threshold."""
    total = max(x.number for x in root.tree()) + 1

    def per_node(values: dict, default) -> Column:
        return _lookup([values.get(i, default) for i in range(total)], F.col("node"))

    at = rows.withColumn("node", _place(root, depth)).filter(per_node({n.number: True for n in open_nodes}, False))
    spread = [F.max(F.col("ks")[d]) - F.min(F.col("ks")[d]) for d in range(dims)]
    stats = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("size"), *[s.alias(f"s{d}") for d, s in enumerate(spread)]).collect()}
    live = [n for n in open_nodes if n.number in stats]
    goal, below, found = {}, {}, {}
    for n in live:
        widths = [stats[n.number][f"s{d}"] for d in range(dims)]
        n.dimension = widths.index(max(widths))
        goal[n.number] = stats[n.number]["size"] * (n.leaves // 2) / n.leaves
        below[n.number], found[n.number] = 0, 0
    keyed = at.select("node", "size", F.element_at("ks", per_node({n.number: n.dimension + 1 for n in live}, 1)).alias("key"))
    for shift in range(PLACE_BITS + TIE_BITS - ROUND_BITS, -1, -ROUND_BITS):
        sums = (
            keyed.filter(F.shiftright("key", shift + ROUND_BITS) == per_node(found, -1))
            .groupBy("node", F.shiftright("key", shift).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)).alias("bin"))
            .agg(F.sum("size").alias("size"))
        )
        running = F.sum("size").over(Window.partitionBy("node").orderBy("bin"))
        reached = sums.select("node", "bin", "size", running.alias("upto")).filter(
            F.col("upto").cast("double") + per_node(below, 0).cast("double") >= per_node(goal, 0.0)
        )
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "size", "upto")).alias("b")).collect():
            n, b = r["node"], r["b"]
            below[n] += b["upto"] - b["size"]
            found[n] = (found[n] << ROUND_BITS) | b["bin"]
            if shift == 0 and goal[n] - below[n] < below[n] + b["size"] - goal[n]:
                found[n] -= 1  # the last key goes to the side that leaves the smaller error
    for n in open_nodes:
        n.threshold = found.get(n.number, -1)


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """For each row: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 16; a null text has none. Shards are the leaves of the
    tree: `shards` of them, or as many as bring a leaf to target_bytes. The dimensions are the
    text's length, the identifier and the named columns: a number by its value, anything else
    by the CRC-32 of its text; a null lies at the low end. A dimension column that the table
    lacks is left out. slot counts from 0 without gaps within a shard, by identifier within
    hashed chunks. Repeated rows, of one identifier and text, are separate rows that any cut can part. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    kinds = dict(docs.dtypes)
    numeric = lambda c: kinds[c].startswith(("decimal",)) or kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    value = lambda c: col(c).cast("double") if numeric(c) else F.crc32(col(c).cast("string").cast("binary")).cast("double")
    dims = [F.octet_length(text).cast("double"), *[value(c) for c in (id_col, *dimensions) if c in docs.columns]]
    base = docs.select(
        col(id_col).alias("id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
        *[d.alias(f"d{i}") for i, d in enumerate(dims)],
    )
    base = stored(base, "kd-rows")
    # By the number that a row was written with: repeated rows can be cut as well as any.
    base = base.withColumn("tie", F.xxhash64("row").bitwiseAND(F.lit((1 << TIE_BITS) - 1)))
    n = len(dims)
    whole = base.agg(
        F.sum("size").alias("size"), *[f(f"d{i}").alias(f"{w}{i}") for i in range(n) for w, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    if shards is None:
        shards = max(1, -(-(whole["size"] or 0) // (target_bytes or 1 << 30)))

    def key(i: int) -> Column:
        lo, hi = whole[f"lo{i}"], whole[f"hi{i}"]
        if lo is None or hi <= lo:
            place = F.lit(0).cast("long")
        else:
            share = F.coalesce((F.col(f"d{i}") - lo) / (hi - lo), F.lit(0.0))
            place = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(share, F.lit(0.0)))) * ((1 << PLACE_BITS) - 1)).cast("long")
        return F.shiftleft(place, TIE_BITS).bitwiseOR(F.col("tie")).alias(f"k{i}")

    rows = base.select("row", "id", "size", "crc", F.array(*[key(i) for i in range(n)]).alias("ks"))
    root = Node(0, shards)
    level, depth, count = [root], 0, 1
    while level := [x for x in level if x.leaves > 1]:
        _cut(rows, root, depth, level, n)
        depth += 1
        for x in level:
            x.low, x.high = Node(count, x.leaves // 2), Node(count + 1, x.leaves - x.leaves // 2)
            count += 2
        level = [y for x in level for y in (x.low, x.high)]
    order = {x.number: i for i, x in enumerate(x for x in root.tree() if x.low is None)}
    names = [order.get(i, -1) for i in range(count)]
    chunks = shuffle_partitions(spark)
    placed = rows.select("row", "id", "size", "crc", _lookup(names, _place(root, depth)).cast("int").alias("shard"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).alias("chunk"))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # shards x chunks rows at most
    out = placed.join(F.broadcast(starts), ["shard", "chunk"])
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.col("id").asc_nulls_last(), "row"))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + nth - 1).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", **kw) -> None:
    """Write the rows as one folder per shard. Identifiers have to be unique and not null."""
    placed = kd_shards(docs, shards, id_col=id_col, **kw).select(id_col, "shard")
    docs.drop("shard").join(placed, id_col).repartition("shard", F.pmod(F.xxhash64(col(id_col)), F.lit(16))).write.partitionBy("shard").parquet(path)
