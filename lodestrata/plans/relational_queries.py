"""Scans, filters, joins, aggregations, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import relational as P
from lodestrata.plans.entities import frame, with_sql

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) and its SQL."""

    def add(f):
        Q[name] = f
        if sql:
            O[name] = with_sql(sql)
        return f

    return add


@query("s01_full_scan", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def s01(s, d):
    return frame(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@query("s02_glossary_scan", "SELECT term, definition FROM {glossary}")
def s02(s, d):
    return frame(s, d, "glossary").select("term", "definition")


@query("s10_paths_by_suffix", "SELECT page_id, url FROM pages WHERE ends_with(split_part(split_part(url, '#', 1), '?', 1), '.html')")
def s10(s, d):
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return frame(s, d, "pages").filter(bare.endswith(".html")).select("page_id", "url")


@query("s11_url_parse", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS section FROM pages")
def s11(s, d):
    part = lambda p: F.regexp_extract("url", p, 1)
    return frame(s, d, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/]+)/").alias("host"), part("://[^/]+/([a-z]+)/").alias("section"))


@query("s13_sample_rows")
def s13(s, d):
    """A repeatable sample of rows: the smallest hashes of the key."""
    return frame(s, d, "part").orderBy(F.xxhash64("p_partkey", F.lit(42)), "p_partkey").limit(20).drop("p_retailprice")


@query("s14_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def s14(s, d):
    return frame(s, d, "part").filter("p_partkey = 17").limit(1).select("p_partkey", "p_name")


@query("s15_lookup_cascade", """SELECT p_partkey, p_name, lvl FROM (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = 'red widget' THEN 1 WHEN p_name = 'red widget' THEN 2 ELSE 3 END AS lvl FROM part
  WHERE CAST(p_partkey AS VARCHAR) = 'red widget' OR p_name = 'red widget' OR p_type = 'red widget') ORDER BY lvl, p_partkey LIMIT 1""")
def s15(s, d):
    want = F.lit("red widget")
    level = F.when(F.col("p_partkey").cast("string") == want, 1).when(F.col("p_name") == want, 2).when(F.col("p_type") == want, 3)
    return frame(s, d, "part").withColumn("lvl", level).filter("lvl IS NOT NULL").orderBy("lvl", "p_partkey").limit(1).select("p_partkey", "p_name", "lvl")


@query("s18_scan_by_group", "SELECT p_brand, p_name, p_partkey, p_size AS size FROM part WHERE p_brand = 'Brand#12' ORDER BY p_name")
def s18(s, d):
    return frame(s, d, "part").filter("p_brand = 'Brand#12'").select("p_brand", "p_name", "p_partkey", F.col("p_size").alias("size"))


@query("f01_equal_or", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 OR c_name = 'Customer#000000009'")
def f01(s, d):
    return frame(s, d, "customer").filter("c_custkey = 7 OR c_name = 'Customer#000000009'").select("c_custkey", "c_name")


@query("f02_computed_threshold", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) >= 80000")
def f02(s, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return frame(s, d, "lineitem").filter(net >= 80000).select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"))


def typed_edges(edges, types: list[str] | None):
    """The predicate exists only when types are given."""
    return edges.filter(F.col("type").isin(types)) if types else edges


@query("f03_optional_filter", "SELECT src, dst, type FROM {associations} WHERE type IN ('causes') AND strength >= 0.9 UNION ALL SELECT src, dst, type FROM {associations} WHERE strength >= 0.98")
def f03(s, d):
    e = frame(s, d, "associations")
    cut = lambda df, least: df.filter(F.col("strength") >= least).select("src", "dst", "type")
    return cut(typed_edges(e, ["causes"]), 0.9).unionByName(cut(typed_edges(e, None), 0.98))


@query("f04_in_array", "SELECT fact_id FROM {facts} WHERE list_contains([lang, source, tenure], 'de')")
def f04(s, d):
    return frame(s, d, "facts").filter(F.array_contains(F.array("lang", "source", "tenure"), "de")).select("fact_id")


@query("f05_first_domain", "SELECT fact_id FROM {facts} WHERE lower(lang) = lower('EN') OR lower(source) = lower('EN')")
def f05(s, d):
    wanted = ["EN", "src1"]
    return frame(s, d, "facts").filter(F.exists(F.array("lang", "source"), lambda x: F.lower(x) == wanted[0].lower())).select("fact_id")


@query("f06_any_domain", "SELECT fact_id FROM {facts} WHERE len(list_intersect([lang, source], ['es', 'src3'])) > 0")
def f06(s, d):
    return frame(s, d, "facts").filter(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("es"), F.lit("src3")))).select("fact_id")


@query("f07_any_quantifier", "SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING bool_or(l_returnflag IN ('R', 'A') AND l_quantity > 49)")
def f07(s, d):
    lines = frame(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines"))
    hit = lines.filter(F.exists("lines", lambda x: x["l_returnflag"].isin("R", "A") & (x["l_quantity"] > 49)))
    return frame(s, d, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("f08_all_quantifier", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 10)")
def f08(s, d):
    lines = frame(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return lines.filter(F.forall("q", lambda x: x >= 10)).select("l_orderkey", F.size("q").cast("long").alias("n"))


@query("f09_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%' || 'ring' || '%'")
def f09(s, d):
    return frame(s, d, "part").filter(F.col("p_name").contains("ring")).select("p_partkey")


@query("f10_substring_fallback", "SELECT fact_id, 0.5 AS score FROM {facts} WHERE contains(lower(content), lower('IDIOT')) ORDER BY importance DESC, fact_id LIMIT 10")
def f10(s, d):
    f = frame(s, d, "facts").filter(F.lower("content").contains("idiot"))
    return f.orderBy(F.desc("importance"), "fact_id").limit(10).select("fact_id", F.lit(0.5).alias("score"))


@query("f11_pattern_per_row", "SELECT DISTINCT p_name FROM part WHERE regexp_matches('a red ring and a blue bolt', '(^|[^a-z0-9])' || split_part(p_name, ' ', 2) || '([^a-z0-9]|$)')")
def f11(s, d):
    pattern = F.concat(F.lit("(^|[^a-z0-9])"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("([^a-z0-9]|$)"))
    return frame(s, d, "part").select("p_name").distinct().filter(F.regexp_like(F.lit("a red ring and a blue bolt"), pattern))


@query("f12_capital_first", "SELECT doc_id FROM {articles} WHERE substring(title, 1, 1) = upper(substring(title, 1, 1)) AND title <> ''")
def f12(s, d):
    first = F.substring("title", 1, 1)
    return frame(s, d, "articles").filter((first == F.upper(first)) & (F.col("title") != "")).select("doc_id")


def pattern_filter(df, column: str, pattern: str):
    """Rows whose text matches from its start on; a pattern that is not valid changes nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return df
    return df.filter(F.col(column).rlike(f"^(?:{pattern})"))


@query("f13_anchored_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(?:(red|blue) [b-r])')")
def f13(s, d):
    return pattern_filter(pattern_filter(frame(s, d, "part"), "p_name", "(red|blue) [b-r]"), "p_name", "(").select("p_partkey", "p_name")


@query("f14_collection_filter", "SELECT src_key, dst_key FROM {property_edges} WHERE starts_with(src_collection || '/' || src_key, 'supplier/')")
def f14(s, d):
    return frame(s, d, "property_edges").filter(F.col("src_collection") == "supplier").select("src_key", "dst_key")


@query("f15_nested_projection", "SELECT fact_id, lang AS domain, importance AS i, confidence AS c FROM {facts}")
def f15(s, d):
    doc = F.struct(F.struct(F.col("lang").alias("domain")).alias("tags"), F.struct("importance", "confidence").alias("scores"))
    return frame(s, d, "facts").select("fact_id", doc.alias("doc")).select("fact_id", "doc.tags.domain", F.col("doc.scores.importance").alias("i"), F.col("doc.scores.confidence").alias("c"))


@query("f16_merge_document", "SELECT fact_id, lang, 1.0 AS importance, 'checked' AS state FROM {facts}")
def f16(s, d):
    return frame(s, d, "facts").withColumns({"importance": F.lit(1.0), "state": F.lit("checked")}).select("fact_id", "lang", "importance", "state")


@query("f17_conditional", "SELECT fact_id, CASE WHEN ttl_days <= 0 THEN 'expired' WHEN ttl_days < 30 THEN 'soon' ELSE 'later' END AS state FROM {facts}")
def f17(s, d):
    return frame(s, d, "facts").select("fact_id", F.when(F.col("ttl_days") <= 0, "expired").when(F.col("ttl_days") < 30, "soon").otherwise("later").alias("state"))


@query("f18_vectors_valid", "SELECT bool_and(len(embedding) = 64) AS valid, count(*) AS n FROM embeddings")
def f18(s, d):
    return frame(s, d, "embeddings").agg(F.every(V.is_valid(F.col("embedding"), 64)).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("j01_key_lookups", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j01(s, d):
    o, c, n = frame(s, d, "orders"), frame(s, d, "customer"), frame(s, d, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("j02_exists_by_key", "SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) > 0 AS related")
def j02(s, d):
    hit = frame(s, d, "orders").join(frame(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("related"))


@query("j03_edge_hops", """SELECT 'out' AS way, src AS a, dst AS b FROM {strong_edges} WHERE src <= 50 UNION ALL SELECT 'in', dst, src FROM {strong_edges} WHERE dst <= 50
  UNION ALL SELECT 'any', src, dst FROM {strong_edges} WHERE src <= 20 UNION ALL SELECT 'any', dst, src FROM {strong_edges} WHERE dst <= 20""")
def j03(s, d):
    e = frame(s, d, "strong_edges")
    part = lambda way, df, a, b, most: df.filter(F.col(a) <= most).select(F.lit(way).alias("way"), F.col(a).alias("a"), F.col(b).alias("b"))
    return part("out", e, "src", "dst", 50).unionByName(part("in", e, "dst", "src", 50)).unionByName(part("any", P.undirected(e), "src", "dst", 20))


@query("j04_either_end", "SELECT p_partkey, count(*) AS n FROM part JOIN {strong_edges} ON p_partkey = src OR p_partkey = dst GROUP BY p_partkey")
def j04(s, d):
    return frame(s, d, "part").join(P.undirected(frame(s, d, "strong_edges")), F.col("p_partkey") == F.col("src")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("j05_ordered_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j05(s, d):
    a, b = (frame(s, d, "nation").select("n_regionkey", F.col("n_nationkey").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query("j06_versions", """SELECT a.test_name, a.n AS n_old, b.n AS n_new, b.n - a.n AS delta FROM (SELECT * FROM {test_runs} WHERE run_id = '2024-01-02') a JOIN (SELECT * FROM {test_runs} WHERE run_id = '2024-01-03') b ON a.test_name = b.test_name""")
def j06(s, d):
    pick = lambda day: F.max(F.when(F.col("run_id") == day, F.col("n")))
    out = frame(s, d, "test_runs").filter(F.col("run_id").isin("2024-01-02", "2024-01-03")).groupBy("test_name").agg(pick("2024-01-02").alias("n_old"), pick("2024-01-03").alias("n_new"))
    return out.filter("n_old IS NOT NULL AND n_new IS NOT NULL").withColumn("delta", F.col("n_new") - F.col("n_old"))


@query("j07_token_domain_pairs", "SELECT fact_id, CAST((CASE WHEN contains(lang, 'e') THEN 1 ELSE 0 END) + (CASE WHEN contains(source, 'e') THEN 1 ELSE 0 END) + (CASE WHEN contains(lang, 'src') THEN 1 ELSE 0 END) + (CASE WHEN contains(source, 'src') THEN 1 ELSE 0 END) AS BIGINT) AS pairs FROM {facts}")
def j07(s, d):
    tokens = F.array(F.lit("e"), F.lit("src"))
    pairs = F.flatten(F.transform(tokens, lambda t: F.filter(F.array("lang", "source"), lambda x: x.contains(t))))
    return frame(s, d, "facts").select("fact_id", F.size(pairs).cast("long").alias("pairs"))


@query("j08_dictionary", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) ON lower(o_orderpriority) = lower(p)")
def j08(s, d):
    o = frame(s, d, "orders")
    words = o.groupBy(F.lower("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(words, F.lower("o_orderpriority") == F.col("p")).select("o_orderkey", "n")


@query("j09_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM {strong_edges})")
def j09(s, d):
    return frame(s, d, "part").join(frame(s, d, "strong_edges"), F.col("p_partkey") == F.col("dst"), "left_anti").select("p_partkey")


@query("j10_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT dst FROM {strong_edges})")
def j10(s, d):
    return frame(s, d, "part").join(frame(s, d, "strong_edges"), F.col("p_partkey") == F.col("dst"), "left_semi").select("p_partkey", "p_name")


@query("j11_nested_group", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j11(s, d):
    o = frame(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = P.nested(frame(s, d, "customer"), o, "c_custkey", "orders", ["o_orderkey", "o_totalprice"])
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.round(F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2).alias("total"))


@query("j12_best_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def j12(s, d):
    best = F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))
    return frame(s, d, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("a01_first_max_max", "SELECT l_orderkey, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) % 1000000000 AS first_part, max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey")
def a01(s, d):
    return frame(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))


@query("a02_category_count", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, count(*) AS n FROM part GROUP BY 1")
def a02(s, d):
    return frame(s, d, "part").groupBy(F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("a03_unnest_share", "SELECT domain, round(avg(importance), 4) AS importance, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {facts}), 2) AS percent FROM (SELECT unnest([lang, source]) AS domain, importance FROM {facts}) GROUP BY domain")
def a03(s, d):
    f = frame(s, d, "facts")
    total = f.agg(F.count(F.lit(1)).alias("total"))
    by = f.select(F.explode(F.array("lang", "source")).alias("domain"), "importance").groupBy("domain").agg(F.round(F.avg("importance"), 4).alias("importance"), F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(total)).select("domain", "importance", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


@query("a04_buckets", """SELECT count(*) FILTER (ttl_days <= 0) AS expired, count(*) FILTER (ttl_days > 0 AND ttl_days < 7) AS critical, count(*) FILTER (ttl_days >= 7 AND ttl_days < 30) AS warning,
  count(*) FILTER (ttl_days >= 30 AND ttl_days < 90) AS stable, count(*) FILTER (ttl_days >= 90) AS lasting, count(*) AS total FROM {facts}""")
def a04(s, d):
    t = F.col("ttl_days")
    cuts = {"expired": t <= 0, "critical": (t > 0) & (t < 7), "warning": (t >= 7) & (t < 30), "stable": (t >= 30) & (t < 90), "lasting": t >= 90}
    return frame(s, d, "facts").agg(*[F.count_if(c).alias(n) for n, c in cuts.items()], F.count(F.lit(1)).alias("total"))


@query("a05_count", "SELECT count(*) AS n FROM lineitem")
def a05(s, d):
    return frame(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("a06_longest", "SELECT p_type, arg_max(p_name, printf('%04d', length(p_name)) || p_name) AS longest FROM part GROUP BY p_type")
def a06(s, d):
    return frame(s, d, "part").groupBy("p_type").agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("longest"))


@query("a07_array_average", "SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS mean FROM embeddings")
def a07(s, d):
    return frame(s, d, "embeddings").select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x) / F.size("embedding"), 6).alias("mean"))


@query("a08_cache_stats", "SELECT count(*) AS entries, round(sum(o_totalprice), 2) AS size, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders")
def a08(s, d):
    return frame(s, d, "orders").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("o_totalprice"), 2).alias("size"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


@query("a09_count_as_sort_key", "SELECT src, count(*) AS n FROM {associations} GROUP BY src ORDER BY n DESC, src LIMIT 25")
def a09(s, d):
    return frame(s, d, "associations").groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(25)


@query("a10_most_common", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 1")
def a10(s, d):
    return frame(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(1)


@query("a11_language_histogram", "SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang")
def a11(s, d):
    return P.with_share(frame(s, d, "documents"), "lang")


@query("a12_vector_stats", """SELECT vec_id, round(list_min(v), 6) AS low, round(list_max(v), 6) AS high, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 5) AS std, round(sqrt(list_dot_product(v, v)), 5) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def a12(s, d):
    r = frame(s, d, "embeddings").select("vec_id", V.statistics(F.col("embedding")).alias("x"))
    return r.select("vec_id", *[F.round(f"x.{c}", 5 if c in ("std", "norm") else 6).alias(c) for c in ("low", "high", "mean", "std", "norm")])


@query("a13_timings", "SELECT event_type AS operation, round(sum(value), 2) AS total, count(*) AS calls, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def a13(s, d):
    return frame(s, d, "events").groupBy(F.col("event_type").alias("operation")).agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 4).alias("mean"))


@query("x01_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def x01(s, d):
    return frame(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(frame(s, d, "supplier").select("s_nationkey")).distinct()


@query("x02_intersection", "SELECT fact_id, array_to_string(list_sort(list_intersect([lang, source, tenure], ['en', 'temporary', 'src2'])), ',') AS common FROM {facts}")
def x02(s, d):
    both = F.array_intersect(F.array("lang", "source", "tenure"), F.array(F.lit("en"), F.lit("temporary"), F.lit("src2")))
    return frame(s, d, "facts").select("fact_id", F.array_join(F.sort_array(both), ",").alias("common"))


@query("x04_distinct", "SELECT DISTINCT dst_collection, relationship_type FROM {property_edges}")
def x04(s, d):
    return frame(s, d, "property_edges").select("dst_collection", "relationship_type").distinct()


@query("x05_union_of_sets", "SELECT source, array_to_string(list_sort(list_distinct(flatten(list([lang, tenure])))), ',') AS domains FROM {facts} GROUP BY source")
def x05(s, d):
    many = F.array_distinct(F.flatten(F.collect_set(F.array("lang", "tenure"))))
    return frame(s, d, "facts").groupBy("source").agg(F.array_join(F.sort_array(many), ",").alias("domains"))


@query("x06_append", "SELECT fact_id, array_to_string(list_append(CASE WHEN tenure = 'temporary' THEN [lang] ELSE [] END, 'new'), ',') AS history FROM {facts}")
def x06(s, d):
    old = F.when(F.col("tenure") == "temporary", F.array("lang"))
    return frame(s, d, "facts").select("fact_id", F.array_join(F.array_append(F.coalesce(old, F.array().cast("array<string>")), F.lit("new")), ",").alias("history"))


@query("x07_ordered_distinct", """SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, p, w, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY p) AS r FROM
  (SELECT doc_id, unnest(regexp_extract_all(title, '[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(title, '[A-Za-z]+'), 1) AS p FROM {articles})) WHERE r = 1 GROUP BY doc_id""")
def x07(s, d):
    words = P.distinct_ignoring_case(F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0)))
    return frame(s, d, "articles").select("doc_id", F.array_join(words, " ").alias("words")).filter("words <> ''")


@query("l01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def l01(s, d):
    return frame(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("l02_top_per_arm", "SELECT * FROM (SELECT 'customer' AS arm, c_custkey AS k, c_acctbal AS v FROM customer ORDER BY v DESC, k LIMIT 7) UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey AS k, s_acctbal AS v FROM supplier ORDER BY v DESC, k LIMIT 7)")
def l02(s, d):
    arm = lambda t, k, v: frame(s, d, t).select(F.lit(t).alias("arm"), F.col(k).alias("k"), F.col(v).alias("v")).orderBy(F.desc("v"), "k").limit(7)
    return arm("customer", "c_custkey", "c_acctbal").unionByName(arm("supplier", "s_suppkey", "s_acctbal"))


@query("l03_many_keys", "SELECT fact_id FROM {facts} ORDER BY importance DESC, confidence DESC, fact_id LIMIT 40")
def l03(s, d):
    return frame(s, d, "facts").orderBy(F.desc("importance"), F.desc("confidence"), "fact_id").limit(40).select("fact_id")


@query("l04_priority", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 15")
def l04(s, d):
    return frame(s, d, "part").orderBy("p_size", "p_partkey").limit(15).select("p_partkey", "p_size")


@query("l05_latest_per_tag", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def l05(s, d):
    return frame(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("l06_history", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 12")
def l06(s, d):
    return frame(s, d, "events").filter("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(12).select("event_id", "event_type")


@query("l07_limit_of_nest", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def l07(s, d):
    n = frame(s, d, "nation").filter("n_regionkey = 1").join(frame(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return n.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("n_nationkey", "c_custkey")


@query("l08_token_budget", "SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM {chats}) WHERE running <= 150")
def l08(s, d):
    return P.within_budget(frame(s, d, "chats"), "conv_id", [F.desc("turn")], "tokens", 150).select("conv_id", "turn", "running")


@query("l09_first_n", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 3")
def l09(s, d):
    return P.first_n(frame(s, d, "part"), "p_brand", [F.col("p_partkey")], 3).select("p_brand", "p_partkey")


@query("l10_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def l10(s, d):
    e = frame(s, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return P.carry_forward(e, "user_id", [F.col("ts"), F.col("event_id")], "mark", "since").select("event_id", "since")


def run_sets(runs):
    """Failing tests of each run, and of the run before: fixed, new and persistent ones."""
    failing = runs.groupBy("run_id").agg(F.sort_array(F.collect_set(F.when(F.col("passed") == 0, F.col("test_name")))).alias("now"))
    before = F.lag("now").over(Window.orderBy("run_id"))  # one row for each run
    pair = failing.withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    return pair.select(
        "run_id", joined(F.array_except("before", "now")).alias("fixed"), joined(F.array_except("now", "before")).alias("broken"), joined(F.array_intersect("now", "before")).alias("lasting")
    )


@query("x03_failing_sets")
def x03(s, d):
    return run_sets(frame(s, d, "test_runs"))


O["x03_failing_sets"] = with_sql(
    """SELECT run_id, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(now, x))), ',') AS fixed, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(before, x))), ',') AS broken,
       array_to_string(list_sort(list_filter(now, lambda x: list_contains(before, x))), ',') AS lasting FROM p""",
    ("r", "SELECT run_id, coalesce(list(test_name) FILTER (passed = 0), []) AS failing FROM {test_runs} GROUP BY run_id"),
    ("p", "SELECT run_id, failing AS now, coalesce(lag(failing) OVER (ORDER BY run_id), []) AS before FROM r"),
)
QUERIES, ORACLES = Q, O
