"""Graph queries over the property graph and part associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.operators import relational as P
from lodestrata.operators.vector_index import recall_of
from lodestrata.plans.entities import frame, vector_index, with_sql

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None, *more: tuple[str, str]):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = with_sql(sql, *more)
        return f

    return add


VERTEX = "src_collection || '/' || src_key AS src, dst_collection || '/' || dst_key AS dst"


def _property(s, d):
    e = frame(s, d, "property_edges")
    return e.select(F.concat_ws("/", "src_collection", "src_key").alias("src"), F.concat_ws("/", "dst_collection", "dst_key").alias("dst"), "relationship_type")


@query(
    "g01_outbound_traversal",
    "SELECT start_key, vertex, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM walk WHERE depth > 0",
    ("e", f"SELECT {VERTEX} FROM {{property_edges}}"),
    ("walk", "SELECT 'orders/' || o_orderkey AS start_key, 'orders/' || o_orderkey AS vertex, 0 AS depth, ['orders/' || o_orderkey] AS path FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT start_key, e.dst, depth + 1, list_append(path, e.dst) FROM walk JOIN e ON walk.vertex = e.src WHERE depth < 3"),
)
def g01(s, d):
    start = frame(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("orders/"), "o_orderkey").alias("k"))
    return G.paths(_property(s, d), start, 3).select("start_key", "vertex", "depth", F.array_join("path", ">").alias("path"))


@query(
    "g02_typed_traversal",
    "SELECT DISTINCT start_key, vertex, CAST(depth AS INTEGER) AS depth FROM walk WHERE depth > 0",
    ("e", "SELECT DISTINCT src, dst FROM {associations} WHERE strength >= 0.98 AND type IN ('causes', 'part_of')"),
    ("walk", "SELECT DISTINCT src AS start_key, src AS vertex, 0 AS depth, CAST([] AS VARCHAR[]) AS used FROM e UNION ALL SELECT start_key, e.dst, depth + 1, list_append(used, e.src || '>' || e.dst) FROM walk JOIN e ON walk.vertex = e.src WHERE depth < 3 AND NOT list_contains(used, e.src || '>' || e.dst)"),
)
def g02(s, d):
    e = frame(s, d, "associations").filter(F.col("strength") >= 0.98).filter(F.col("type").isin("causes", "part_of"))
    return G.paths(e, e.select("src").distinct(), 3).select("start_key", "vertex", "depth").distinct()


PAIRS = ("pairs", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey * 7 + 3 AS BIGINT) AS b FROM {nation}")


def _path_sql(edges: str, hops: int) -> str:
    """One expression for each hop: the first of the shortest paths to every new vertex."""
    parts = [PAIRS, ("e", f"SELECT src, dst, max(strength) AS w FROM (SELECT src, dst, strength FROM {edges} UNION ALL SELECT dst, src, strength FROM {edges}) GROUP BY src, dst")]
    parts.append(("f0", "SELECT DISTINCT a AS s, a AS v, 0 AS depth, [a] AS path, CAST([] AS DOUBLE[]) AS ws FROM pairs"))
    for h in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT s, v FROM f{i}" for i in range(h))
        parts.append((f"f{h}", f"SELECT s, v, {h} AS depth, path, ws FROM (SELECT s, e.dst AS v, list_append(path, e.dst) AS path, list_append(ws, e.w) AS ws, row_number() OVER (PARTITION BY s, e.dst ORDER BY list_append(path, e.dst)) AS r FROM f{h - 1} JOIN e ON v = e.src) WHERE r = 1 AND (s, v) NOT IN ({known})"))
    reached = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(hops + 1))
    return with_sql(f"""SELECT a, b, CAST(coalesce(depth, -1) AS INTEGER) AS distance, coalesce(array_to_string(path, '>'), '') AS vertices,
      coalesce(array_to_string(list_transform(range(1, len(path)), lambda i: CAST(path[i] AS VARCHAR) || '-' || CAST(path[i + 1] AS VARCHAR)), ','), '') AS edges, round(list_avg(ws), 6) AS strength
      FROM pairs LEFT JOIN ({reached}) ON a = s AND b = v""", *parts)


def _pairs(s, d):
    return frame(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") * 7 + 3).cast("long").alias("b"))


def _shown(paths):
    edges = F.transform("edges", lambda x: F.concat_ws("-", x["src"], x["dst"]))
    return paths.select("a", "b", "distance", F.array_join(F.col("vertices").cast("array<string>"), ">").alias("vertices"), F.array_join(edges, ",").alias("edges"), F.round("strength", 6).alias("strength"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if not sql.startswith("WITH RECURSIVE") else sql


@query("g03_shortest_path")
def g03(s, d):
    return _shown(G.shortest_path(frame(s, d, "strong_edges"), _pairs(s, d), 4))


@query("g04_strong_shortest_path")
def g04(s, d):
    return _shown(G.shortest_path(frame(s, d, "associations"), _pairs(s, d), 3, least=0.95))


O["g03_shortest_path"] = _path_sql("{strong_edges}", 4)
O["g04_strong_shortest_path"] = _path_sql("(SELECT src, dst, strength FROM {associations} WHERE strength >= 0.95)", 3)


@query(
    "g05_neighbourhoods",
    "SELECT seed, size, internal, round(strength, 6) AS strength FROM (SELECT seed, size, count(*) AS internal, avg(e.strength) AS strength FROM sized JOIN {strong_edges} e ON vertex = e.src JOIN reach r2 ON sized.seed = r2.seed2 AND e.dst = r2.vertex2 GROUP BY seed, size) WHERE internal >= size - 1",
    ("reach1", "SELECT DISTINCT src AS seed, dst AS vertex FROM {strong_edges}"),
    ("reach2", "SELECT seed, vertex FROM reach1 UNION SELECT seed, dst FROM reach1 JOIN {strong_edges} ON vertex = src"),
    ("reach3", "SELECT seed, vertex FROM reach2 UNION SELECT seed, dst FROM reach2 JOIN {strong_edges} ON vertex = src"),
    ("reach", "SELECT seed AS seed2, vertex AS vertex2 FROM reach3"),
    ("sized", "SELECT * FROM (SELECT seed, vertex, count(*) OVER (PARTITION BY seed) AS size FROM reach3) WHERE size >= 3"),
)
def g05(s, d):
    return G.neighbourhoods(frame(s, d, "strong_edges"), 3, 3).select("seed", "size", "internal", F.round("strength", 6).alias("strength"))


@query("g06_common_neighbours", "SELECT v AS vertex FROM (SELECT DISTINCT src AS k, dst AS v FROM {associations} WHERE src IN (3, 4) UNION SELECT DISTINCT dst, src FROM {associations} WHERE dst IN (3, 4)) GROUP BY v HAVING count(*) = 2")
def g06(s, d):
    return G.common_neighbours(frame(s, d, "associations"), [3, 4])


@query("g07_direct_associations", """SELECT 'out' AS way, src AS k, dst AS other, type, p_name FROM {associations} JOIN part ON dst = p_partkey WHERE src <= 20 UNION ALL
  SELECT 'in', dst, src, type, p_name FROM {associations} JOIN part ON src = p_partkey WHERE dst <= 20""")
def g07(s, d):
    e, p = frame(s, d, "associations"), frame(s, d, "part")
    way = lambda name, a, b: e.filter(F.col(a) <= 20).join(p, F.col(b) == F.col("p_partkey")).select(F.lit(name).alias("way"), F.col(a).alias("k"), F.col(b).alias("other"), "type", "p_name")
    return way("out", "src", "dst").unionByName(way("in", "dst", "src"))


@query("g08_one_hop_any", "SELECT k, other, p_name FROM (SELECT src AS k, dst AS other, strength, type FROM {associations} UNION ALL SELECT dst, src, strength, type FROM {associations}) JOIN part ON other = p_partkey WHERE k = 5 AND strength >= 0.5 AND type IN ('causes', 'related')")
def g08(s, d):
    e = P.undirected(frame(s, d, "associations")).filter("src = 5 AND strength >= 0.5").filter(F.col("type").isin("causes", "related"))
    return e.join(frame(s, d, "part"), F.col("dst") == F.col("p_partkey")).select(F.col("src").alias("k"), F.col("dst").alias("other"), "p_name")


@query("g09_star", """SELECT 'part' AS part, p_partkey AS k, p_name AS label FROM part WHERE p_partkey = 9 UNION ALL SELECT 'causes', dst, type FROM {associations} WHERE src = 9 AND type = 'causes'
  UNION ALL SELECT 'related', dst, type FROM {associations} WHERE src = 9 AND type = 'related' UNION ALL SELECT 'used_by', src, type FROM {associations} WHERE dst = 9
  UNION ALL SELECT 'supplier', l_suppkey, l_returnflag FROM lineitem WHERE l_partkey = 9""")
def g09(s, d):
    e = frame(s, d, "associations")
    arm = lambda name, df, k, label: df.select(F.lit(name).alias("part"), F.col(k).alias("k"), F.col(label).alias("label"))
    out = arm("part", frame(s, d, "part").filter("p_partkey = 9"), "p_partkey", "p_name")
    for name, df, k, label in (
        ("causes", e.filter("src = 9 AND type = 'causes'"), "dst", "type"), ("related", e.filter("src = 9 AND type = 'related'"), "dst", "type"),
        ("used_by", e.filter("dst = 9"), "src", "type"), ("supplier", frame(s, d, "lineitem").filter("l_partkey = 9"), "l_suppkey", "l_returnflag"),
    ):
        out = out.unionByName(arm(name, df, k, label))
    return out


@query("g10_recommendation", """SELECT 'neighbour' AS kind, p.p_partkey AS rule, e.dst AS k, e.strength FROM part p JOIN {associations} e ON p.p_partkey = e.src WHERE p.p_name LIKE 'red r%' AND e.strength >= 0.9 UNION ALL
  SELECT 'supplier', p.p_partkey, l.l_suppkey, l.l_quantity / 50 FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE p.p_name LIKE 'red r%' AND l.l_quantity >= 45""")
def g10(s, d):
    rules = frame(s, d, "part").filter(F.col("p_name").like("red r%")).select(F.col("p_partkey").alias("rule"))
    near = rules.join(frame(s, d, "associations").filter("strength >= 0.9"), F.col("rule") == F.col("src")).select(F.lit("neighbour").alias("kind"), "rule", F.col("dst").alias("k"), "strength")
    lines = rules.join(frame(s, d, "lineitem").filter("l_quantity >= 45"), F.col("rule") == F.col("l_partkey"))
    return near.unionByName(lines.select(F.lit("supplier").alias("kind"), "rule", F.col("l_suppkey").alias("k"), (F.col("l_quantity") / 50).alias("strength")))


@query("g11_by_edge_attribute", "SELECT DISTINCT src, p_name FROM {associations} JOIN part ON src = p_partkey WHERE type = 'part_of' AND strength = 1")
def g11(s, d):
    return frame(s, d, "associations").filter("type = 'part_of' AND strength = 1").join(frame(s, d, "part"), F.col("src") == F.col("p_partkey")).select("src", "p_name").distinct()


INV = "CASE type WHEN 'causes' THEN 'caused_by' WHEN 'part_of' THEN 'has_part' ELSE type END"
EDGES = "SELECT src, dst, type, max(strength) AS strength FROM {associations} GROUP BY src, dst, type"
NEW = "SELECT n_nationkey AS src, n_nationkey + 100 AS dst, 'causes' AS type, 0.5 AS strength FROM nation WHERE n_nationkey + 100 IN (SELECT p_partkey FROM part) AND n_nationkey IN (SELECT p_partkey FROM part)"


def _edges(s, d):
    return frame(s, d, "associations").groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"))


def _new(s, d):
    n = F.col("n_nationkey").cast("long")
    return frame(s, d, "nation").select(n.alias("src"), (n + 100).alias("dst"), F.lit("causes").alias("type"), F.lit(0.5).alias("strength"))


@query(
    "g12_upsert_with_inverse", "SELECT * FROM added UNION ALL SELECT src, dst, type, strength FROM old WHERE NOT EXISTS (SELECT 1 FROM added a WHERE a.src = old.src AND a.dst = old.dst AND a.type = old.type)",
    ("old", EDGES), ("new1", NEW), ("added", f"SELECT src, dst, type, CAST(strength AS DOUBLE) AS strength FROM new1 UNION SELECT dst, src, {INV}, CAST(strength AS DOUBLE) FROM new1"),
)
def g12(s, d):
    return G.upsert_edges(_edges(s, d), _new(s, d), frame(s, d, "part").select("p_partkey"), ["src", "dst", "type"], both_ways=True)


@query(
    "g13_upsert_by_ends", "SELECT src, dst, type, CAST(strength AS DOUBLE) AS strength FROM new1 UNION ALL SELECT src, dst, type, strength FROM old WHERE NOT EXISTS (SELECT 1 FROM new1 a WHERE a.src = old.src AND a.dst = old.dst)",
    ("old", EDGES), ("new1", NEW),
)
def g13(s, d):
    return G.upsert_edges(_edges(s, d), _new(s, d), frame(s, d, "part").select("p_partkey"), ["src", "dst"])


@query("g14_edge_of_two_rows", "SELECT a.p_partkey AS src, b.p_partkey AS dst, 'related' AS type FROM (SELECT min(p_partkey) AS p_partkey FROM part WHERE p_name = 'red widget') a CROSS JOIN (SELECT min(p_partkey) AS p_partkey FROM part WHERE p_name = 'blue bolt') b")
def g14(s, d):
    one = lambda name, out: frame(s, d, "part").filter(F.col("p_name") == name).agg(F.min("p_partkey").alias(out))
    return one("red widget", "src").crossJoin(one("blue bolt", "dst")).select("src", "dst", F.lit("related").alias("type"))


@query("g15_delete_with_inverse", "SELECT src, dst, type, strength FROM old WHERE NOT (src IN (1, 2) AND type = 'causes') AND NOT (dst IN (1, 2) AND type = 'caused_by')", ("old", f"SELECT * FROM ({EDGES}) UNION ALL SELECT dst, src, {INV}, strength FROM ({EDGES}) WHERE type <> 'related'"))
def g15(s, d):
    e = _edges(s, d)
    turned = e.filter("type <> 'related'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), G.inverse_type(F.col("type")).alias("type"), "strength")
    both = e.unionByName(turned)
    return G.delete_edges(both, both.filter("src IN (1, 2) AND type = 'causes'"))


@query("g16_prune", "SELECT src, dst, type, strength FROM {associations} WHERE NOT (strength < 0.5 AND created < DATE '1998-01-01')")
def g16(s, d):
    return G.prune_edges(frame(s, d, "associations"), 0.5, F.lit("1998-01-01").cast("date")).select("src", "dst", "type", "strength")


@query("g17_strengthen", "SELECT src, dst, type, round(CASE WHEN type = 'causes' THEN least(strength + 0.1, 1.0) ELSE strength END, 6) AS strength FROM {associations}")
def g17(s, d):
    more = F.when(F.col("type") == "causes", F.least(F.col("strength") + 0.1, F.lit(1.0))).otherwise(F.col("strength"))
    return frame(s, d, "associations").select("src", "dst", "type", F.round(more, 6).alias("strength"))


@query(
    "g18_nearest_edges", "SELECT src, dst, round(strength, 5) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS r FROM c) WHERE r <= 5",
    ("v", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}"),
    ("c", "SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS strength FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE strength >= 0.35"),
)
def g18(s, d):
    return G.nearest_edges(frame(s, d, "embeddings"), "vec_id", "embedding", 5, 0.35).select("src", "dst", F.round("strength", 5).alias("strength"))


@query("g18_clustered_edges")
def g18_clustered(s, d):
    """As g18, from the lists that each vector probes instead of all vectors."""
    found = vector_index(s, d).neighbours(frame(s, d, "embeddings"), "vec_id", "embedding", 5, 0.35, same=False)
    return found.select(F.col("query").alias("src"), F.col("vec_id").alias("dst"), F.round("similarity", 5).alias("strength"))


@query("g18_recall")
def g18_recall(s, d):
    """How many of the exact edges the lists give, and pairs compared of all."""
    index, e = vector_index(s, d), frame(s, d, "embeddings")
    exact = G.nearest_edges(e, "vec_id", "embedding", 5, 0.35).select(F.col("src").alias("query"), F.col("dst").alias("vec_id"))
    report = recall_of(index.neighbours(e, "vec_id", "embedding", 5, 0.35, same=False), exact, "query", "vec_id")
    return report.select("wanted", "found", F.round("recall", 4).alias("recall"), F.lit(index.compared(e, "vec_id", "embedding")).cast("long").alias("compared"), F.lit(int(index.sizes.sum()) ** 2).cast("long").alias("pairs"))


@query(
    "g19_inbound_traversal", "SELECT DISTINCT start_key, vertex, CAST(depth AS INTEGER) AS depth FROM walk WHERE depth > 0",
    ("e", f"SELECT {VERTEX} FROM {{property_edges}}"),
    ("walk", "SELECT 'region/1' AS start_key, 'region/1' AS vertex, 0 AS depth UNION ALL SELECT start_key, e.src, depth + 1 FROM walk JOIN e ON walk.vertex = e.dst WHERE depth < 2"),
)
def g19(s, d):
    start = s.createDataFrame([("region/1",)], "k string")
    return G.paths(_property(s, d), start, 2, src="dst", dst="src").select("start_key", "vertex", "depth").distinct()


@query(
    "g20_two_hops_any", "SELECT vertex, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT dst AS vertex, 1 AS depth FROM e WHERE src = 8 UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 8) WHERE vertex <> 8 GROUP BY vertex",
    ("e", "SELECT src, dst FROM {associations} WHERE strength >= 0.9 UNION SELECT dst, src FROM {associations} WHERE strength >= 0.9"),
)
def g20(s, d):
    e = P.undirected(frame(s, d, "associations").filter("strength >= 0.9").select("src", "dst"))
    return G.distances(e, s.range(8, 9).toDF("k"), 2).filter("depth > 0").select("vertex", "depth")


O["g19_inbound_traversal"] = _recursive(O["g19_inbound_traversal"])
QUERIES, ORACLES = Q, O
