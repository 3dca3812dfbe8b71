"""Fact-store, mutation and lifecycle queries."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT
from lodestrata.operators import memory as M
from lodestrata.operators import relational as P
from lodestrata.operators import retrieval as R
from lodestrata.operators.judging import ANALYSIS, CONFIDENCE, judged, shared_words
from lodestrata.plans.entities import frame, index, with_sql
from lodestrata.plans.retrieval_queries import SIMILAR, bm25_sql

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None, *more: tuple[str, str]):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = with_sql(sql, *more)
        return f

    return add


PROT = "(importance * 0.5 + least(access_count / 10.0, 1.0) * 0.5)"
STATUS = "CASE WHEN new_ttl <= 0 THEN 'expired' WHEN new_ttl < 0.5 * ttl_days THEN 'critical' WHEN new_ttl < 0.8 * ttl_days THEN 'decaying' ELSE 'stable' END AS status"


@query("m01_decay", f"SELECT fact_id, round(new_ttl, 6) AS new_ttl, {STATUS} FROM d", ("d", f"SELECT fact_id, ttl_days, greatest(0.0, ttl_days - days_since * (1 - {PROT})) AS new_ttl FROM {{facts}}"))
def m01(s, d):
    return M.decay(frame(s, d, "facts"), F.col("days_since")).select("fact_id", F.round("new_ttl", 6).alias("new_ttl"), "status")


@query(
    "m02_decay_domains", f"SELECT fact_id, round(prot, 6) AS protection, round(red, 6) AS reduction, round(new_ttl, 6) AS new_ttl, {STATUS} FROM e",
    ("d", f"SELECT *, {PROT} + CASE WHEN lang = 'de' THEN 0.8 WHEN tenure = 'temporary' THEN -0.5 ELSE 0 END AS prot FROM {{facts}}"),
    ("r", "SELECT *, days_since * CASE WHEN tenure = 'temporary' THEN 3.0 ELSE 1.0 END * (1 - least(prot, 0.95)) AS red FROM d"),
    ("e", "SELECT *, greatest(0.0, ttl_days - red) AS new_ttl FROM r"),
)
def m02(s, d):
    out = M.decay_by_domain(frame(s, d, "facts"), F.col("days_since"), F.array("lang", "source", "tenure"), ["de"])
    return out.select("fact_id", *[F.round(c, 6).alias(c) for c in ("protection", "reduction", "new_ttl")], "status")


@query("m03_decay_targeted", "SELECT fact_id, round(CASE WHEN lang = 'fr' THEN greatest(0.0, ttl_days - 10 * (1 - 0.5 * importance)) ELSE ttl_days END, 6) AS new_ttl FROM {facts}")
def m03(s, d):
    return M.decay_domain_only(frame(s, d, "facts"), "fr", F.array("lang", "source"), 10.0).select("fact_id", F.round("new_ttl", 6).alias("new_ttl"))


@query("m04_boost", "SELECT fact_id, contains(lower(content), 'idiot') AS boosted, CASE WHEN contains(lower(content), 'idiot') THEN ttl_days + 30 ELSE ttl_days END AS new_ttl, CASE WHEN contains(lower(content), 'idiot') THEN round(least(1.0, importance + 0.1), 6) ELSE importance END AS new_importance FROM {facts}")
def m04(s, d):
    return M.boost(frame(s, d, "facts"), F.lower("content").contains("idiot")).select("fact_id", "boosted", "new_ttl", F.round("new_importance", 6).alias("new_importance"))


@query("m05_decay_statistics", """SELECT lang, count(*) AS n, count(*) FILTER (ttl_days <= 0) AS expired, count(*) FILTER (ttl_days > 0 AND ttl_days < 30) AS short, round(avg(ttl_days), 4) AS mean_ttl FROM {facts} GROUP BY lang""")
def m05(s, d):
    t = F.col("ttl_days")
    return frame(s, d, "facts").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(t <= 0).alias("expired"), F.count_if((t > 0) & (t < 30)).alias("short"), F.round(F.avg(t), 4).alias("mean_ttl"))


@query("m06_similar_facts", "SELECT fact_id, round(similarity, 6) AS similarity FROM {facts} JOIN near ON fact_id = vec_id WHERE near.similarity >= 0.25 ORDER BY near.similarity DESC, fact_id LIMIT 5", SIMILAR)
def m06(s, d):
    e = frame(s, d, "embeddings")
    near = R.similar_to(e, e.filter("vec_id = 0")).filter("similarity >= 0.25")
    out = frame(s, d, "facts").join(near, F.col("fact_id") == F.col("vec_id"))
    return R.top(out, "similarity", "fact_id", 5).select("fact_id", F.round("similarity", 6).alias("similarity"))


@query("m07_knowledge_update", """SELECT fact_id, CASE WHEN nc IS NULL THEN 'kept' WHEN nc >= confidence THEN 'replaced' ELSE 'alternative' END AS action, round(CASE WHEN nc >= confidence THEN least(1.0, importance + 0.05) ELSE importance END, 6) AS importance,
  n_alternatives + CASE WHEN nc < confidence THEN 1 ELSE 0 END AS n_alternatives, greatest(confidence, nc) AS confidence FROM (SELECT f.*, n.nc FROM {facts} f LEFT JOIN (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 0.95 ELSE 0.1 END AS nc FROM benchmark) n ON f.fact_id = n.item_id)""")
def m07(s, d):
    news = frame(s, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("content"), F.when(F.col("item_id") % 2 == 0, 0.95).otherwise(0.1).alias("confidence"))
    return M.learn(frame(s, d, "facts"), news).select("fact_id", "action", F.round("importance", 6).alias("importance"), "n_alternatives", "confidence")


@query("m08_fact_history", "SELECT fact_id, coalesce(nullif(access_count, 0), 1) AS versions, coalesce(nullif(n_alternatives, 0), -1) AS alternatives, coalesce(nullif(confidence, 0), 0.5) AS confidence FROM {facts}")
def m08(s, d):
    from lodestrata.functions.nulls import truthy_or

    pick = lambda c, x: truthy_or(F.col(c), x).alias
    return frame(s, d, "facts").select("fact_id", pick("access_count", 1)("versions"), pick("n_alternatives", -1)("alternatives"), pick("confidence", 0.5)("confidence"))


@query("m09_contradictions", "SELECT fact_id, round(n_alternatives * (1 - confidence), 6) AS contradiction FROM {facts} WHERE n_alternatives > 0 ORDER BY n_alternatives * (1 - confidence) DESC, fact_id LIMIT 50")
def m09(s, d):
    return R.top(M.contradictions(frame(s, d, "facts")), "contradiction", "fact_id", 50).select("fact_id", F.round("contradiction", 6).alias("contradiction"))


@query(
    "m10_resolution", "SELECT fact_id, importance, CAST(NULL AS BIGINT) AS resolves, CASE WHEN hot THEN fact_id + 1000000 END AS resolved_by FROM h UNION ALL SELECT fact_id + 1000000, round(least(1.0, importance + 0.1), 6), fact_id, NULL FROM h WHERE hot",
    ("h", "SELECT *, n_alternatives > 0 AND n_alternatives * (1 - confidence) >= 1.15 AS hot FROM {facts}"),
)
def m10(s, d):
    return M.resolve(frame(s, d, "facts"), 1.15).withColumn("importance", F.round("importance", 6))


@query("m11_merge", "SELECT source, members, array_to_string(domains, ',') AS domains, round(least(1.0, top + 0.05), 6) AS importance, merged_into FROM (SELECT source, count(*) AS members, list_sort(list_distinct(flatten(list([lang, tenure])))) AS domains, max(importance) AS top, min(fact_id) AS merged_into FROM {facts} GROUP BY source) WHERE members >= 2")
def m11(s, d):
    return M.merge(frame(s, d, "facts"), "source").select("source", "members", F.array_join("domains", ",").alias("domains"), F.round("importance", 6).alias("importance"), "merged_into")


def evaluate(text, evidence):
    """The default judge, in place of a language model: the share of evidence words that the text has."""
    words = F.array_distinct(TEXT.tokens(evidence))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(TEXT.tokens(text), words)) / F.size(words)).otherwise(0.5)


@query("m12_confidence_evaluation")
def m12(s, d):
    f = frame(s, d, "facts").join(frame(s, d, "benchmark").withColumnRenamed("item_id", "fact_id"), "fact_id")
    return f.select("fact_id", F.round(evaluate(F.col("content"), F.col("text")), 6).alias("confidence"))


_SHARE = """SELECT fact_id, CASE WHEN len(w) = 0 THEN 0.5 ELSE len(list_intersect(c, w)) / CAST(len(w) AS DOUBLE) END AS share, len(w) = 0 AS failed FROM (SELECT f.fact_id, list_distinct(regexp_extract_all(lower(coalesce(f.content, '')), '[\\pL\\pN]+')) AS c,
  list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[\\pL\\pN]+')) AS w FROM {facts} f JOIN {benchmark} b ON f.fact_id = b.item_id)"""


@query("m12_judged", "SELECT fact_id, round(share, 6) AS confidence, failed FROM shares", ("shares", _SHARE))
def m12_judged(s, d):
    """Confidence by a judge that can be any callable, validated; a failure counts as .5."""
    f = frame(s, d, "facts").join(frame(s, d, "benchmark").withColumnRenamed("item_id", "fact_id"), "fact_id")
    out = judged(f, ["fact_id"], "content", "text", shared_words, CONFIDENCE)
    return out.select("fact_id", F.round("confidence", 6).alias("confidence"), F.col("error").isNotNull().alias("failed"))


@query("m13_judged", "SELECT fact_id, round(share, 6) AS support_score, round(CASE WHEN failed THEN 0.5 ELSE 1 - share END, 6) AS contradiction_score FROM shares", ("shares", _SHARE))
def m13_judged(s, d):
    """Support and contradiction by the same kind of judge."""
    f = frame(s, d, "facts").join(frame(s, d, "benchmark").withColumnRenamed("item_id", "fact_id"), "fact_id")
    out = judged(f, ["fact_id"], "content", "text", shared_words, ANALYSIS)
    return out.select("fact_id", *[F.round(c, 6).alias(c) for c in ANALYSIS])


@query("m13_evidence_analysis")
def m13(s, d):
    """Each item's evidence for facts of its number: supports, weakens or neither."""
    c = evaluate(F.col("content"), F.col("text"))
    f = frame(s, d, "facts").join(frame(s, d, "benchmark").withColumnRenamed("item_id", "fact_id"), "fact_id")
    return f.select("fact_id", F.when(c >= 0.3, "supports").when(c < 0.1, "weakens").otherwise("neutral").alias("verdict"))


@query("m14_confidence_update", "SELECT fact_id, round(coalesce(0.7 * confidence + 0.3 * v, confidence), 6) AS confidence FROM {facts} LEFT JOIN (SELECT user_id, avg(value) / 200 AS v FROM events GROUP BY user_id) ON fact_id = user_id")
def m14(s, d):
    judged = frame(s, d, "events").groupBy(F.col("user_id").alias("fact_id")).agg((F.avg("value") / 200).alias("v"))
    mix = 0.7 * F.col("confidence") + 0.3 * F.col("v")
    return frame(s, d, "facts").join(judged, "fact_id", "left").select("fact_id", F.round(F.coalesce(mix, F.col("confidence")), 6).alias("confidence"))


@query("m15_contradiction_evidence", "SELECT fact_id, 'alternatives: ' || n_alternatives || '; confidence: ' || CASE WHEN confidence >= 0.7 THEN 'high' ELSE 'low' END AS evidence FROM {facts} WHERE n_alternatives > 0")
def m15(s, d):
    level = F.when(F.col("confidence") >= 0.7, "high").otherwise("low")
    return frame(s, d, "facts").filter("n_alternatives > 0").select("fact_id", F.concat(F.lit("alternatives: "), "n_alternatives", F.lit("; confidence: "), level).alias("evidence"))


@query(
    "m16_confidence_history", "SELECT user_id, CAST(count(*) + CASE WHEN max(day) <> DATE '2024-01-30' THEN 1 ELSE 0 END AS BIGINT) AS entries, CAST(CAST(greatest(max(day), DATE '2024-01-30') AS DATE) AS VARCHAR) AS last_day FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id"
)
def m16(s, d):
    e = frame(s, d, "events").groupBy("user_id", F.to_date("ts").alias("at")).agg((F.avg("value") / 200).alias("confidence"))
    h = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "confidence"))).alias("history"))
    latest = F.struct(F.lit("2024-01-30").cast("date").alias("at"), F.lit(0.5).alias("confidence"))
    full = M.history_with_latest(F.col("history"), latest)
    return h.select("user_id", F.size(full).cast("long").alias("entries"), F.element_at(full, -1)["at"].cast("string").alias("last_day"))


@query(
    "m17_run_comparison", "SELECT run_id, tests, failed, seconds, tests - lag(tests) OVER w AS d_tests, failed - lag(failed) OVER w AS d_failed, round(seconds - lag(seconds) OVER w, 2) AS d_seconds FROM r WINDOW w AS (ORDER BY run_id)",
    ("r", "SELECT run_id, count(*) AS tests, count(*) FILTER (passed = 0) AS failed, round(sum(execution_time), 2) AS seconds FROM {test_runs} GROUP BY run_id"),
)
def m17(s, d):
    return M.compare_runs(frame(s, d, "test_runs"))


@query("m18_failures_attached", "SELECT run_id, count(*) AS tests, coalesce(string_agg(test_name, ',' ORDER BY test_name) FILTER (passed = 0), '') AS failing FROM {test_runs} GROUP BY run_id")
def m18(s, d):
    r = frame(s, d, "test_runs")
    out = P.nested(r.groupBy("run_id").agg(F.count(F.lit(1)).alias("tests")), r.filter("passed = 0"), "run_id", "bad", ["test_name"])
    return out.select("run_id", "tests", F.array_join(F.transform("bad", lambda x: x["test_name"]), ",").alias("failing"))


@query("m19_timeline", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m19(s, d):
    day = F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd")
    return frame(s, d, "events").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- Mutations -------------------------------------------------------------------------------

UPSERTED = "SELECT p_partkey, coalesce(n.p_name, o.p_name) AS p_name, coalesce(n.p_size, o.p_size) AS p_size, CASE WHEN n.p_partkey IS NULL THEN 'keep' WHEN o.p_partkey IS NULL THEN 'insert' ELSE 'update' END AS operation FROM o FULL OUTER JOIN n USING (p_partkey)"
OLD = ("o", "SELECT p_partkey, p_name, p_size FROM part")
NEW = ("n", "SELECT s_suppkey * 50 AS p_partkey, s_name AS p_name, CASE WHEN s_suppkey % 2 = 0 THEN 99 END AS p_size FROM supplier")


def _old_new(s, d):
    new = frame(s, d, "supplier").select((F.col("s_suppkey") * 50).alias("p_partkey"), F.col("s_name").alias("p_name"), F.when(F.col("s_suppkey") % 2 == 0, 99).alias("p_size"))
    return frame(s, d, "part").select("p_partkey", "p_name", "p_size"), new


@query("w01_bulk_insert_update", UPSERTED, OLD, NEW)
def w01(s, d):
    return M.upsert(*_old_new(s, d), "p_partkey")


@query("w02_upsert_by_key", UPSERTED, OLD, NEW)
def w02(s, d):
    return M.upsert(*_old_new(s, d), "p_partkey")


@query(
    "w03_remember", "SELECT coalesce(o.key, n.key) AS key, md5(coalesce(n.content, o.content)) AS content, md5(CASE WHEN o.key IS NOT NULL AND n.key IS NOT NULL THEN o.content END) AS previous, coalesce(n.importance, o.importance) AS importance, CASE WHEN o.key IS NULL THEN 1 ELSE o.access_count + CASE WHEN n.key IS NULL THEN 0 ELSE 1 END END AS access_count, CASE WHEN o.key IS NULL THEN 'insert' WHEN n.key IS NOT NULL THEN 'update' ELSE 'keep' END AS operation FROM o FULL OUTER JOIN n ON o.key = n.key",
    ("o", "SELECT 'fact_' || substring(md5(text), 1, 10) AS key, text AS content, 0.5 AS importance, count(*) AS access_count FROM documents GROUP BY text"),
    ("n", "SELECT DISTINCT 'fact_' || substring(md5(text), 1, 10) AS key, text AS content, 0.9 AS importance FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE lang = 'es')"),
)
def w03(s, d):
    docs = frame(s, d, "documents")
    old = docs.groupBy(F.col("text").alias("content")).agg(F.count(F.lit(1)).alias("access_count")).select(M.fact_id(F.col("content")).alias("key"), "content", F.lit(0.5).alias("importance"), "access_count")
    new = frame(s, d, "benchmark").select("text").union(docs.filter("lang = 'es'").select("text")).select(F.col("text").alias("content"), F.lit(0.9).alias("importance"))
    return M.remember(old, new).select("key", F.md5("content").alias("content"), F.md5("previous_content").alias("previous"), "importance", "access_count", "operation")


@query("w04_glossary_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(content, '[ \n\t]+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: regexp_full_match(w, '[A-Z][a-z0-9]{2,}')))), ' ') AS terms FROM {articles}")
def w04(s, d):
    return frame(s, d, "articles").select("doc_id", F.array_join(F.sort_array(M.glossary_terms(F.col("content"))), " ").alias("terms"))


@query("w05_default_ttl", "SELECT fact_id, 30 * (1 + importance) AS ttl FROM {facts}")
def w05(s, d):
    return frame(s, d, "facts").select("fact_id", M.default_ttl(F.col("importance")).alias("ttl"))


@query("w06_touch", "SELECT fact_id, access_count + coalesce(n, 0) AS access_count FROM {facts} LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) ON fact_id = user_id")
def w06(s, d):
    touched = frame(s, d, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("fact_id")).agg(F.count(F.lit(1)).alias("n"))
    return frame(s, d, "facts").join(touched, "fact_id", "left").select("fact_id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query("w07_delete_expired", "SELECT fact_id, ttl_days - 20 AS ttl_days FROM {facts} WHERE ttl_days - 20 > 0 AND lang <> 'es'")
def w07(s, d):
    ttl = F.when(F.col("lang") != "es", F.col("ttl_days") - 20)  # no ttl at all counts as expired
    return M.without_expired(frame(s, d, "facts").select("fact_id", ttl.alias("ttl_days")))


@query("w08_upsert_by_title", "SELECT p_name, coalesce(n.size, o.size) AS size, CASE WHEN n.p_name IS NULL THEN 'keep' WHEN o.p_name IS NULL THEN 'insert' ELSE 'update' END AS operation FROM (SELECT p_name, max(p_size) AS size FROM part GROUP BY 1) o FULL OUTER JOIN (SELECT 'red widget' AS p_name, 77 AS size UNION ALL SELECT 'new thing', 5) n USING (p_name)")
def w08(s, d):
    new = s.createDataFrame([("red widget", 77), ("new thing", 5)], "p_name string, size int")
    return M.upsert(frame(s, d, "part").groupBy("p_name").agg(F.max("p_size").alias("size")), new, "p_name")


@query("w09_partial_update", "SELECT c_custkey, coalesce(u.seg, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT s_suppkey, 'SUPPLIER' AS seg FROM supplier WHERE s_acctbal > 0) u ON c_custkey = s_suppkey")
def w09(s, d):
    u = frame(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), F.lit("SUPPLIER").alias("seg"))
    return frame(s, d, "customer").join(u, "c_custkey", "left").select("c_custkey", F.coalesce("seg", "c_mktsegment").alias("c_mktsegment"), "c_acctbal")


@query("w10_fan_out", """SELECT 'state' AS kind, run_id, count(*) AS n FROM {test_runs} GROUP BY run_id UNION ALL SELECT 'failure', run_id, count(*) FROM {test_runs} WHERE passed = 0 GROUP BY run_id UNION ALL SELECT 'history', run_id, CAST(sum(n) AS BIGINT) FROM {test_runs} GROUP BY run_id""")
def w10(s, d):
    """One nested row for each run, spread over three tables."""
    runs = frame(s, d, "test_runs").groupBy("run_id").agg(F.collect_list(F.struct("test_name", "passed", "n")).alias("tests"))
    state = runs.select(F.lit("state").alias("kind"), "run_id", F.size("tests").cast("long").alias("n"))
    each = runs.select("run_id", F.explode("tests").alias("t"))
    failure = each.filter("t.passed = 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("failure").alias("kind"), "run_id", "n")
    return state.unionByName(failure).unionByName(each.groupBy("run_id").agg(F.sum("t.n").alias("n")).select(F.lit("history").alias("kind"), "run_id", "n"))


@query("w12_insert_or_replace", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w12(s, d):
    return P.latest(frame(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("w13_evict", "SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE held <= 200")
def w13(s, d):
    e = frame(s, d, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).withColumn("bytes", F.length("props"))
    return P.within_budget(e, "user_id", [F.desc("ts"), F.desc("event_id")], "bytes", 200).select("event_id")


@query("w14_recompress")
def w14(s, d):
    """Compressed sizes of values over a thousand bytes."""
    @F.pandas_udf("long")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: len(zlib.compress(t.encode(), 6)))

    return frame(s, d, "documents").filter(F.octet_length("text") > 1024).select("doc_id", F.octet_length("text").cast("long").alias("size"), packed("text").alias("packed"))


@query("w17_latest_document", "SELECT event_type AS name, max(event_id) AS version FROM events GROUP BY event_type")
def w17(s, d):
    return frame(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("version"))


@query("w18_chat_tokens", "SELECT conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+')) AS tokens, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations")
def w18(s, d):
    from pyspark.sql import Window

    n = F.size(TEXT.tokens(F.col("text"))).cast("long")
    c = frame(s, d, "conversations").withColumn("tokens", n)
    return c.select("conv_id", "turn", "tokens", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn")).alias("total"))


# --- Time-driven behaviour, as batch --------------------------------------------------------


@query("e03_recency", "SELECT fact_id, round(1.0 / (1 + abs(days_since)), 6) AS recency FROM {facts}")
def e03(s, d):
    return frame(s, d, "facts").select("fact_id", F.round(1.0 / (1 + F.abs("days_since")), 6).alias("recency"))


# --- Names kept for callers of the many entry points -----------------------------------------

ALIASES = {
    "p01_get_fact": ("f01_equal_or",),
    "p03_keyword_search": ("r03_bm25_domain",),
    "p04_alternate_hybrid": ("r19_hybrid_alias",),
    "p05_all_test_states": ("m18_failures_attached",),
    "p09_cached_result": ("w12_insert_or_replace",),
    "p10_clear_cache": ("w13_evict",),
    "p12_question_generation": ("t16_function_questions",),
    "p15_insert_errors": ("w02_upsert_by_key",),
    "p18_keyword_embedding_query": ("r20_four_list_report",),
    "p23_two_collection_view": ("r14_cross_collection",),
    "p24_cached_analysis": ("w12_insert_or_replace",),
}


@query("p02_domain_filtered_keywords", "SELECT fact_id, round(bm25, 6) AS score FROM scored WHERE bm25 > 0 AND lang IN ('en', 'de') ORDER BY bm25 DESC, fact_id LIMIT 20", ("scored", bm25_sql("{facts}", {"content": 1.0}, ["idiot", "scum"])))
def p02(s, d):
    hits = index(s, d, "articles").search({"content": 1.0}, ["idiot", "scum"]).withColumnRenamed("doc_id", "fact_id")
    df = frame(s, d, "facts").join(hits, "fact_id").filter(F.col("lang").isin("en", "de"))
    return R.top(df, "bm25", "fact_id", 20).select("fact_id", F.round("bm25", 6).alias("score"))


@query("p06_search_states", "SELECT run_id, test_name FROM {test_runs} WHERE contains(test_name, 'err') AND passed = 0")
def p06(s, d):
    return frame(s, d, "test_runs").filter(F.col("test_name").contains("err") & (F.col("passed") == 0)).select("run_id", "test_name")


@query("p16_vector_display", "SELECT vec_id, printf('%.3f', embedding[1]) || ',' || printf('%.3f', embedding[2]) || ',' || printf('%.3f', embedding[3]) || ',...,' || printf('%.3f', embedding[64]) AS shown FROM embeddings")
def p16(s, d):
    at = lambda i: F.format_string("%.3f", F.element_at("embedding", i).cast("double"))
    return frame(s, d, "embeddings").select("vec_id", F.concat_ws(",", at(1), at(2), at(3), F.lit("..."), at(-1)).alias("shown"))


@query("p20_first_embedding", "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1")
def p20(s, d):
    return frame(s, d, "embeddings").filter("embedding IS NOT NULL").orderBy("vec_id").limit(1).select("vec_id", "label")


@query("p21_case_insensitive_type", "SELECT type, count(*) AS n FROM {associations} WHERE lower(type) IN ('causes', 'part_of') GROUP BY type")
def p21(s, d):
    wanted = [t.lower() for t in ("CAUSES", "Part_Of")]
    return frame(s, d, "associations").filter(F.lower("type").isin(wanted)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLES = Q, O
