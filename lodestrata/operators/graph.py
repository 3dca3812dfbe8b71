"""Property-graph operators over edge frames (src, dst, ...).

Traversals are loops of equi joins, one for each hop, with paths or frontiers as columns; the
number of hops is a parameter. A path never uses an edge twice. Each hop of a search keeps only
vertices that are new, so its size is bounded by the vertices, not by the paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.relational import undirected
from lodestrata.sources.scratch import stored

# Association types and their inverses; the others are their own inverse.
INVERSE = {"causes": "caused_by", "caused_by": "causes", "implies": "implied_by", "implied_by": "implies", "part_of": "has_part", "has_part": "part_of", "example": "exemplified_by", "exemplified_by": "example"}
TYPES = (*INVERSE, "similar", "related", "opposite", "sequence")


def paths(edges: DataFrame, start: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """start_key, vertex, depth, path (array of vertices) for every path of 1 to `hops` edges.

    start has one column of vertices. A path may meet a vertex again, but not by the same edge.
    """
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    name = start.columns[0]
    front = start.select(F.col(name).alias("start_key"), F.col(name).alias("vertex"), F.array(F.col(name)).alias("path"))
    found = []
    for depth in range(1, hops + 1):
        step = front.join(e, F.col("vertex") == F.col("_s"))
        pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("b"))
        again = F.exists(pairs, lambda p: (p["a"] == F.col("_s")) & (p["b"] == F.col("_d")))
        front = step.filter(~again).select("start_key", F.col("_d").alias("vertex"), F.array_append("path", F.col("_d")).alias("path"))
        found.append(front.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found)


def distances(edges: DataFrame, start: DataFrame, hops: int, src: str = "src", dst: str = "dst", strength: str | None = None) -> DataFrame:
    """start_key, vertex, depth, path: the fewest hops, up to a limit, the start itself at zero; of
    equally short paths the first in order. With strength also strengths, those of its edges.

    Each frontier is written to the shared scratch folder, so a hop neither repeats earlier ones nor
    grows the plan by more than one table; an empty one ends the search.
    """
    along = [F.col(strength).alias("_w")] if strength else []
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), *along).distinct()
    name = start.columns[0]
    none = [F.array().cast("array<double>").alias("strengths")] if strength else []
    front = start.select(F.col(name).alias("start_key"), F.col(name).alias("vertex")).distinct().select("*", F.lit(0).alias("depth"), F.array("vertex").alias("path"), *none)
    seen = front = stored(front, "frontier")
    for depth in range(1, hops + 1):
        more = {"strengths": F.array_append("strengths", F.col("_w").cast("double"))} if strength else {}
        step = front.join(e, F.col("vertex") == F.col("_s")).withColumns({"path": F.array_append("path", F.col("_d")), **more})
        ways = F.min(F.struct("path", *(["strengths"] if strength else []))).alias("way")
        near = step.groupBy("start_key", F.col("_d").alias("vertex")).agg(ways)
        new = near.join(seen.select("start_key", "vertex"), ["start_key", "vertex"], "left_anti")
        front = stored(new.select("start_key", "vertex", F.lit(depth).alias("depth"), "way.*"), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, pairs: DataFrame, hops: int, least: float | None = None) -> DataFrame:
    """For each pair (a, b) over edges in either direction: distance, vertices and edges (source and
    target, in walking order) of the shortest path, the first in order of equally short ones, and the
    mean strength of its edges. Without a path of at most `hops` the distance is -1 and the arrays are
    empty. Only edges of at least the strength `least` count; of parallel ones the strongest.

    Searched from both ends, whose frontiers take turns and meet: each goes half the hops, and a
    pair that has met is searched no further. Of the paths through the vertices where two frontiers
    meet, each made of the first way to there and the first way on, the first in order is taken.
    """
    e = edges if least is None else edges.filter(F.col("strength") >= least)
    both = e.select("src", "dst", "strength").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))
    strongest = stored(both.groupBy("src", "dst").agg(F.max("strength").cast("double").alias("strength")), "strongest")
    asked = pairs.select("a", "b").distinct()
    kind = strongest.schema["src"].dataType.simpleString()
    start = lambda c: stored(asked.select("a", "b", F.col(c).cast(kind).alias("vertex"), F.array(F.col(c).cast(kind)).alias("path"), F.array().cast("array<double>").alias("strengths")), "frontier")
    ahead, behind = start("a"), start("b")
    seen = [ahead.select("a", "b", "vertex"), behind.select("a", "b", "vertex")]
    met, way = [], ["a", "b", "vertex"]
    for depth in range(hops + 1):
        if depth:
            forward = depth % 2 == 1
            front = ahead if forward else behind
            step = front.join(strongest, F.col("vertex") == F.col("src"))
            joined = (F.array_append("path", F.col("dst")), F.array_append("strengths", F.col("strength"))) if forward else (F.array_prepend("path", F.col("dst")), F.array_prepend("strengths", F.col("strength")))
            step = step.select("a", "b", F.col("dst").alias("vertex"), F.struct(joined[0].alias("path"), joined[1].alias("strengths")).alias("way"))
            known = seen[0] if forward else seen[1]
            new = step.groupBy(*way).agg(F.min("way").alias("way")).join(known, way, "left_anti")
            front = stored(new.select(*way, "way.*"), "frontier")
            ahead, behind = (front, behind) if forward else (ahead, front)
            seen[0 if forward else 1] = known.unionByName(front.select(*way))
        other = behind.select(*way, F.col("path").alias("rest"), F.col("strengths").alias("more"))
        here = ahead.join(other, way)
        path = F.concat("path", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))
        best = F.min(F.struct(path.alias("path"), F.concat("strengths", "more").alias("strengths"))).alias("way")
        found = stored(here.groupBy("a", "b").agg(best).select("a", "b", F.lit(depth).alias("depth"), "way.*"), "met")
        met.append(found)
        ahead, behind = (x.join(found.select("a", "b"), ["a", "b"], "left_anti") for x in (ahead, behind))
        if ahead.isEmpty() or behind.isEmpty():
            break
    reached = reduce(DataFrame.unionByName, met)
    out = pairs.join(reached, ["a", "b"], "left")
    path = F.coalesce("path", F.array().cast(reached.schema["path"].dataType))
    steps = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("src"), y.alias("dst")))
    mean = F.aggregate("strengths", F.lit(0.0), lambda t, w: t + w) / F.nullif(F.size("strengths"), F.lit(0))
    return out.select("a", "b", F.coalesce("depth", F.lit(-1)).alias("distance"), path.alias("vertices"), steps.alias("edges"), mean.alias("strength"))


def neighbourhoods(edges: DataFrame, hops: int, least_size: int) -> DataFrame:
    """seed, size, internal, strength: for every vertex with an outgoing edge the distinct vertices
    within `hops`, the edges inside that set and their mean strength. Sets overlap; a seed is in
    its own set only through a cycle."""
    e = edges.select("src", "dst")
    reach = front = e.select(F.col("src").alias("seed"), F.col("dst").alias("vertex")).distinct()
    for _ in range(hops - 1):
        front = front.join(e, F.col("vertex") == F.col("src")).select("seed", F.col("dst").alias("vertex")).distinct().join(reach, ["seed", "vertex"], "left_anti")
        reach = reach.unionByName(front)
    sizes = reach.groupBy("seed").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_size)
    inside = reach.join(sizes, "seed")
    other = inside.select(F.col("seed").alias("_seed"), F.col("vertex").alias("_other"))
    within = inside.join(edges, F.col("vertex") == F.col("src")).join(other, (F.col("seed") == F.col("_seed")) & (F.col("dst") == F.col("_other")))
    out = within.groupBy("seed", "size").agg(F.count(F.lit(1)).alias("internal"), F.avg("strength").alias("strength"))
    return out.filter(F.col("internal") >= F.col("size") - 1)


def common_neighbours(edges: DataFrame, vertices: list) -> DataFrame:
    """Vertices that an edge in either direction joins to every one of the given ones."""
    near = undirected(edges.select("src", "dst")).filter(F.col("src").isin(vertices)).distinct()
    return near.groupBy(F.col("dst").alias("vertex")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(vertices))).select("vertex")


def inverse_type(kind):
    out = kind
    for a, b in INVERSE.items():
        out = F.when(kind == a, F.lit(b)).otherwise(out)
    return out


def with_inverse(edges: DataFrame) -> DataFrame:
    """Edges and their inverses, types turned by the inverse table."""
    turned = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) if c != "type" else inverse_type(F.col("type")).alias("type") for c in edges.columns])
    return edges.unionByName(turned)


def upsert_edges(edges: DataFrame, new: DataFrame, vertices: DataFrame, key: list[str], both_ways: bool = False) -> DataFrame:
    """edges with new ones put in or replaced by key; edges to unknown vertices are refused."""
    v = vertices.columns[0]
    ok = new.join(vertices.select(F.col(v).alias("src")), "src", "left_semi").join(vertices.select(F.col(v).alias("dst")), "dst", "left_semi").select(*new.columns)
    ok = with_inverse(ok) if both_ways else ok
    ok = ok.dropDuplicates(key)
    return edges.join(ok.select(*key), key, "left_anti").select(*edges.columns).unionByName(ok.select(*edges.columns))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without the given (src, dst, type) and their inverses."""
    return edges.join(with_inverse(gone.select("src", "dst", "type")), ["src", "dst", "type"], "left_anti").select(*edges.columns)


def prune_edges(edges: DataFrame, least: float, before=None) -> DataFrame:
    """edges without weak ones; with a date, without those that are weak and older. No strength is weak."""
    weak = F.col("strength").isNull() | (F.col("strength") < least)
    gone = weak if before is None else weak & (F.col("created") < before)
    return edges.filter(~F.coalesce(gone, F.lit(False)))


def nearest_edges(vectors: DataFrame, key: str, vector: str, k: int, least: float, rows: int = 4096) -> DataFrame:
    """src, dst, strength: each vector's k best cosines of at least `least`, by matrix products.

    Vectors are cut into blocks by a hash of the key, of about `rows`, more in large tables. Every two
    blocks meet once, in one task, which gives at most k rows for each of its vectors. Of B
    blocks in a ring, block x meets those up to half the ring on, so a vector is shuffled about B times.
    """
    import numpy as np
    import pyarrow as pa

    from lodestrata.operators.relational import first_n
    from lodestrata.operators.vector_index import SCORES, Best, best_of_rows, blocks_of, unit_table

    blocks = blocks_of(vectors.count(), rows)
    kind = dict(vectors.dtypes)[key]
    v = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    v = v.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(blocks // 2))))
    before = F.pmod(F.col("block") - F.col("d"), F.lit(blocks))
    cells = v.withColumn("x", F.explode(F.when(F.col("d") == 0, F.array("block")).otherwise(F.array(F.col("block"), before))))
    cells = cells.filter((F.col("d") * 2 < blocks) | (F.col("x") * 2 < blocks))  # opposite blocks would meet twice

    def match(table: pa.Table) -> pa.Table:
        table, apart = table.sort_by("id"), table.column("d")[0].as_py()
        unit, ids = unit_table(table.column("v")), table.column("id").combine_chunks()
        left = table.column("block").to_numpy() == table.column("x").to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left) if apart else np.flatnonzero(left)
        name = ids.dictionary_encode().indices.to_numpy()
        best, step, y = Best(k), max(1, SCORES // max(1, len(b))), np.ascontiguousarray(unit[b].T)
        for own in (a[i : i + step] for i in range(0, len(a), step)):
            score = unit[own] @ y
            if not apart:
                score[name[own][:, None] == name[b]] = -2
            i, j = best_of_rows(score, k, least)
            best.add(own[i], b[j], score[i, j])
            if apart:
                j, i = best_of_rows(score.T, k, least)
                best.add(b[j], own[i], score[i, j])
        row, other, strength = best.all()
        return pa.table({"src": ids.take(pa.array(row)), "dst": ids.take(pa.array(other)), "strength": strength})

    cells = cells.select("id", "v", "block", "d", "x").repartition(max(1, blocks * (blocks // 2 + 1)), "x", "d")
    pairs = cells.groupBy("x", "d").applyInArrow(match, f"src {kind}, dst {kind}, strength double")
    return first_n(pairs, "src", [F.desc("strength"), F.col("dst")], k)
