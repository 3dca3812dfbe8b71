"""Queries of ranked retrieval over documents, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT
from lodestrata.functions.spotting import longest_by_root, spot_terms
from lodestrata.operators import retrieval as R
from lodestrata.operators.vector_index import recall_of
from lodestrata.plans.entities import frame, index, vector_index, with_sql

QUERY = "worthless clown trash"
TOKENS = TEXT.query(QUERY)
FIELDS = {"title": 1.5, "description": 1.0, "content": 0.8}


def bm25_sql(source: str, fields: dict[str, float], tokens: list[str]) -> str:
    """The same score as SQL over a named source."""
    names = list(fields)
    cells = [(i, j) for i in range(len(names)) for j in range(len(tokens))]
    tok = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '[\\pL\\pN]+') AS t{i}" for i, f in enumerate(names))
    tf = ", ".join(f"CAST(len(list_filter(t{i}, lambda x: x = '{tokens[j]}')) AS DOUBLE) AS f{i}_{j}" for i, j in cells)
    ln = ", ".join(f"CAST(len(t{i}) AS DOUBLE) AS l{i}" for i in range(len(names)))
    st = ", ".join([*[f"avg(l{i}) AS a{i}" for i in range(len(names))], *[f"CAST(count(*) FILTER (f{i}_{j} > 0) AS DOUBLE) AS d{i}_{j}" for i, j in cells]])
    score = " + ".join(
        f"CASE WHEN f{i}_{j} > 0 THEN ln(1 + (n - d{i}_{j} + 0.5) / (d{i}_{j} + 0.5)) * (f{i}_{j} * 2.2 / (f{i}_{j} + 1.2 * (0.25 + 0.75 * l{i} / a{i}))) * {fields[names[i]]} ELSE 0 END" for i, j in cells
    )
    return f"""SELECT *, ({score}) AS bm25 FROM (SELECT *, {ln}, {tf} FROM (SELECT *, {tok} FROM {source})) CROSS JOIN
      (SELECT CAST(count(*) AS DOUBLE) AS n, {st} FROM (SELECT {ln}, {tf} FROM (SELECT {tok} FROM {source})))"""


DOCS_BM25 = ("scored", bm25_sql("{articles}", FIELDS, TOKENS))
CONTENT_BM25 = ("scored", bm25_sql("{documents}", {"text": 1.0}, TOKENS))
COSINE = """list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) /
      (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"""
SIMILAR = ("near", f"SELECT e.vec_id, e.label, {COSINE} AS similarity FROM {{embeddings}} e, (SELECT embedding FROM {{embeddings}} WHERE vec_id = 0) q")


def _articles(s, d):
    return index(s, d, "articles").search(FIELDS, TOKENS)


def _content(s, d, key="doc_id", query=TOKENS):
    """Scores of the documents' texts, which are also the contents of articles and of facts."""
    return index(s, d, "articles").search({"content": 1.0}, query).withColumnRenamed("doc_id", key)


def _glossary(s, d, fields, query):
    return index(s, d, "glossary").search(fields, query)


def _similar(s, d):
    e = frame(s, d, "embeddings")
    return R.similar_to(e, e.filter("vec_id = 0")).select("vec_id", "label", "similarity")


def r01(s, d):
    """Blocks of postings that cannot reach the fifth score are not read."""
    return index(s, d, "articles").top(FIELDS, TOKENS, 5).select("doc_id", F.round("bm25", 6).alias("score"))


def r02(s, d):
    """Blocks of postings that cannot reach the threshold are not read."""
    return index(s, d, "articles").search_from({"content": 1.0}, TOKENS, 2.0).select("doc_id", F.round("bm25", 6).alias("score"))


def r02_reads(s, d):
    """Postings and blocks that rankings of some lengths read, of all that their query has."""
    each = [index(s, d, "articles").reads({"content": 1.0}, TOKENS, k) for k in (1, 10, 100)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def r03(s, d):
    df = frame(s, d, "facts").join(_content(s, d, "fact_id").filter("bm25 > 0.1"), "fact_id").filter("lang = 'en'")
    return R.top(df, "bm25", "fact_id", 10).select("fact_id", "lang", F.round("bm25", 6).alias("score"))


def r04(s, d):
    return _articles(s, d).agg((F.count_if(F.col("bm25") > 0.1) > 0).alias("exists"))


def r05(s, d):
    return R.top(_similar(s, d).filter("similarity > 0.2"), "similarity", "vec_id", 30).select("vec_id", F.round("similarity", 6).alias("similarity"))


def r06(s, d):
    g = frame(s, d, "glossary").join(_similar(s, d), F.col("term_id") == F.col("vec_id")).filter("similarity >= 0.15")
    return R.top(g, "similarity", "term_id", 10).select("term_id", "term", "definition", F.round("similarity", 6).alias("similarity"))


def r07(s, d):
    return _similar(s, d).filter("similarity >= 0.15").select("vec_id", F.round("similarity", 6).alias("similarity"))


def r08(s, d):
    """Approximate neighbours of one vector: only the lists nearest to it are read."""
    one = frame(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]
    return vector_index(s, d).search(one, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _twentieth(s, d):
    return frame(s, d, "embeddings").filter("vec_id % 20 = 0")


def r08_many(s, d):
    """Approximate neighbours of every twentieth vector among all others."""
    found = vector_index(s, d).neighbours(_twentieth(s, d), "vec_id", "embedding", 10, same=False)
    return found.select(F.col("query").alias("query_id"), "vec_id", F.round("similarity", 6).alias("similarity"))


def r08_recall(s, d):
    """How many of the true ten neighbours of every twentieth vector the index finds, and for how many comparisons."""
    index, asking = vector_index(s, d), _twentieth(s, d)
    ways = [index.neighbours(asking, "vec_id", "embedding", 10, same=False, probes=p) for p in (index.probes, len(index.centres))]
    compared = [index.compared(asking, "vec_id", "embedding", p) for p in (index.probes, len(index.centres))]
    report = recall_of(*ways, "query", "vec_id")
    return report.select("queries", "wanted", "found", F.round("recall", 4).alias("recall"), F.lit(index.probes).alias("probes"), F.lit(len(index.centres)).alias("lists"), *[F.lit(c).cast("long").alias(n) for c, n in zip(compared, ("compared", "pairs"))])


def _arms(s, d, k=20, least_bm25=0.1, least_similarity=0.2):
    keyword = R.top(_articles(s, d).filter(F.col("bm25") > least_bm25), "bm25", "doc_id", k).select("doc_id", F.col("bm25").alias("score"))
    vector = R.top(_similar(s, d).filter(F.col("similarity") >= least_similarity), "similarity", "vec_id", k).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    return {"bm25": keyword, "similarity": vector}


def r09(s, d):
    out = R.fuse(_arms(s, d), "doc_id", {"bm25": 0.5, "similarity": 0.5}, 0.15, 15)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("bm25", "similarity", "hybrid")])


ARMS_SQL = (
    ("keyword", "SELECT doc_id, bm25 AS score FROM scored WHERE bm25 > 0.1 ORDER BY bm25 DESC, doc_id LIMIT 20"),
    ("vectors", "SELECT vec_id AS doc_id, similarity AS score FROM near WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 20"),
    ("united", "SELECT doc_id, score AS bm25, 0.0 AS similarity FROM keyword UNION ALL SELECT doc_id, 0.0, score FROM vectors"),
    ("merged", "SELECT doc_id, max(bm25) AS bm25, max(similarity) AS similarity, 0.5 * max(bm25) + 0.5 * max(similarity) AS hybrid FROM united GROUP BY doc_id"),
)


def r10(s, d):
    """Each level loosens all three thresholds; the first level that finds anything counts."""
    keyword = _articles(s, d).select("doc_id", F.col("bm25").alias("score"))
    vector = _similar(s, d).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    both = R.fuse({"bm25": keyword, "similarity": vector}, "doc_id", {"bm25": 0.5, "similarity": 0.5}, None, None)
    levels = [(F.col("bm25") > a) & (F.col("similarity") > b) & (F.col("hybrid") >= c) for a, b, c in ((0.1, 0.5, 0.15), (0.05, 0.3, 0.1), (0.01, 0.01, 0.05))]
    return R.top(R.relax(both, levels), "hybrid", "doc_id", 10).select("doc_id", "level", F.round("hybrid", 6).alias("hybrid"))


R10_SQL = with_sql(
    """SELECT doc_id, level, round(hybrid, 6) AS hybrid FROM leveled WHERE level = (SELECT min(level) FROM leveled) ORDER BY leveled.hybrid DESC, doc_id LIMIT 10""",
    DOCS_BM25,
    SIMILAR,
    ("united", "SELECT doc_id, bm25, 0.0 AS similarity FROM scored UNION ALL SELECT vec_id, 0.0, similarity FROM near"),
    ("merged", "SELECT doc_id, max(bm25) AS bm25, max(similarity) AS similarity FROM united GROUP BY doc_id"),
    ("fused", "SELECT *, 0.5 * bm25 + 0.5 * similarity AS hybrid FROM merged"),
    ("leveled", """SELECT * FROM (SELECT *, CASE WHEN bm25 > 0.1 AND similarity > 0.5 AND hybrid >= 0.15 THEN 1 WHEN bm25 > 0.05 AND similarity > 0.3 AND hybrid >= 0.1 THEN 2
        WHEN bm25 > 0.01 AND similarity > 0.01 AND hybrid >= 0.05 THEN 3 END AS level FROM fused) WHERE level IS NOT NULL"""),
)


def r11(s, d):
    arms = _arms(s, d, least_bm25=0.0, least_similarity=0.1)
    return R.fuse(arms, "doc_id", {"bm25": 0.5, "similarity": 0.5}, None, 10).select("doc_id", F.round("hybrid", 6).alias("hybrid"))


def r12(s, d):
    """Glossary: the term counts more than its definition."""
    g = _glossary(s, d, {"term": 1.5, "definition": 1.0}, ["steel", "red"])
    keyword = R.top(g.filter("bm25 > 0.1"), "bm25", "term_id", 20).select("term_id", F.col("bm25").alias("score"))
    vector = R.top(_similar(s, d).filter("similarity >= 0.2"), "similarity", "vec_id", 20).select(F.col("vec_id").alias("term_id"), F.col("similarity").alias("score"))
    return R.fuse({"bm25": keyword, "similarity": vector}, "term_id", {"bm25": 0.5, "similarity": 0.5}, 0.1, 10).select("term_id", F.round("hybrid", 6).alias("hybrid"))


R12_SQL = with_sql(
    "SELECT term_id, round(h, 6) AS hybrid FROM (SELECT term_id, 0.5 * max(b) + 0.5 * max(v) AS h FROM united GROUP BY term_id) WHERE h >= 0.1 ORDER BY h DESC, term_id LIMIT 10",
    ("scored", bm25_sql("{glossary}", {"term": 1.5, "definition": 1.0}, ["steel", "red"])),
    SIMILAR,
    ("kw", "SELECT term_id, bm25 FROM scored WHERE bm25 > 0.1 ORDER BY bm25 DESC, term_id LIMIT 20"),
    ("vec", "SELECT vec_id, similarity FROM near WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 20"),
    ("united", "SELECT term_id, bm25 AS b, 0.0 AS v FROM kw UNION ALL SELECT vec_id, 0.0, similarity FROM vec"),
)


def _cross(s, d):
    """Two collections under one key: articles and glossary terms, with importance and age."""
    a = _content(s, d).select(F.lit("articles").alias("collection"), F.col("doc_id").alias("key"), F.col("bm25").alias("score"))
    g = _glossary(s, d, {"term": 1.0}, ["steel"]).select(F.lit("glossary").alias("collection"), F.col("term_id").alias("key"), F.col("bm25").alias("score"))
    v = _similar(s, d).select(F.lit("articles").alias("collection"), F.col("vec_id").alias("key"), F.col("similarity").alias("score"))
    return {"bm25": a.unionByName(g).filter("score > 0"), "similarity": v.filter("score >= 0.2")}


def r14(s, d):
    """Enabled arms share 0.8; importance and recency add a tenth each; groups by collection and key."""
    fused = R.fuse(_cross(s, d), ["collection", "key"], {"bm25": 0.4, "similarity": 0.4}, None, None)
    more = frame(s, d, "facts").select(F.lit("articles").alias("collection"), F.col("fact_id").alias("key"), "importance", "days_since")
    recency = 0.1 / (1 + F.abs(F.coalesce("days_since", F.lit(0))))
    out = fused.join(more, ["collection", "key"], "left").withColumn("total", F.col("hybrid") + 0.1 * F.coalesce("importance", F.lit(0.0)) + recency)
    return R.top(out.filter("total >= 0.4"), "total", ["collection", "key"], 10).select("collection", "key", F.round("total", 6).alias("total"))


CROSS_SQL = (
    ("a", bm25_sql("{articles}", {"content": 1.0}, TOKENS)),
    ("g", bm25_sql("{glossary}", {"term": 1.0}, ["steel"])),
    SIMILAR,
    ("united", """SELECT 'articles' AS collection, doc_id AS key, bm25, 0.0 AS similarity FROM a WHERE bm25 > 0 UNION ALL SELECT 'glossary', term_id, bm25, 0.0 FROM g WHERE bm25 > 0
        UNION ALL SELECT 'articles', vec_id, 0.0, similarity FROM near WHERE similarity >= 0.2"""),
    ("merged", "SELECT collection, key, max(bm25) AS bm25, max(similarity) AS similarity FROM united GROUP BY collection, key"),
)
R14_SQL = with_sql(
    """SELECT collection, key, round(t, 6) AS total FROM (SELECT m.collection, m.key, 0.4 * bm25 + 0.4 * similarity + 0.1 * coalesce(f.importance, 0) + 0.1 / (1 + abs(coalesce(f.days_since, 0))) AS t
       FROM merged m LEFT JOIN {facts} f ON m.collection = 'articles' AND m.key = f.fact_id) WHERE t >= 0.4 ORDER BY t DESC, collection, key LIMIT 10""",
    *CROSS_SQL,
)


def r15(s, d):
    """Only rows with a keyword match are scored at all."""
    a = _articles(s, d).filter("bm25 > 0").join(_similar(s, d), F.col("doc_id") == F.col("vec_id"))
    a = a.withColumn("hybrid", 0.5 * F.col("bm25") + 0.5 * F.col("similarity")).filter("hybrid > 0.5")
    return R.top(a, "hybrid", "doc_id", 10).select("doc_id", F.round("hybrid", 6).alias("hybrid"))


R15_SQL = with_sql(
    "SELECT doc_id, round(h, 6) AS hybrid FROM (SELECT doc_id, 0.5 * bm25 + 0.5 * similarity AS h FROM scored JOIN near ON doc_id = vec_id WHERE bm25 > 0) WHERE h > 0.5 ORDER BY h DESC, doc_id LIMIT 10",
    DOCS_BM25,
    SIMILAR,
)


def recall(s, d, weights=(0.8, 0.8, 0.8), k=10, threshold=0.4, lang=None, normalise=False, over=1):
    """Facts by meaning, keywords, glossary overlap, importance and recency."""
    f = frame(s, d, "facts").join(_content(s, d, "fact_id"), "fact_id", "left").join(_similar(s, d), F.col("fact_id") == F.col("vec_id"), "left")
    w = [0.8 / 3] * 3 if normalise else weights
    meaning = F.when(F.col("similarity") >= 0.2, F.col("similarity")).otherwise(0.0)
    overlap = R.overlap_share(F.array("lang", "source"), ["en", "src1"])
    score = w[0] * meaning + w[1] * F.coalesce("bm25", F.lit(0.0)) + w[2] * overlap + 0.1 * F.col("importance") + 0.04 / (1 + F.abs("days_since"))
    out = R.top(f.withColumn("total", score).filter(F.col("total") >= threshold), "total", "fact_id", k * over)
    if lang:
        out = R.top(out.filter(F.col("lang") == lang), "total", "fact_id", k)
    return out.select("fact_id", "lang", F.round("total", 6).alias("total"))


def recall_sql(weights=(0.8, 0.8, 0.8), k=10, threshold=0.4, lang=None, normalise=False, over=1):
    w = [0.8 / 3] * 3 if normalise else weights
    body = f"""SELECT fact_id, lang, round(t, 6) AS total FROM (SELECT * FROM (SELECT fact_id, lang, {w[0]!r} * CASE WHEN similarity >= 0.2 THEN similarity ELSE 0 END + {w[1]!r} * bm25
        + {w[2]!r} * ((CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END) / 2.0) + 0.1 * importance + 0.04 / (1 + abs(days_since)) AS t
        FROM scored LEFT JOIN near ON fact_id = vec_id) WHERE t >= {threshold} ORDER BY t DESC, fact_id LIMIT {k * over}) {f"WHERE lang = '{lang}'" if lang else ""} ORDER BY t DESC, fact_id LIMIT {k}"""
    return with_sql(body, ("scored", bm25_sql("{facts}", {"content": 1.0}, TOKENS)), SIMILAR)


def r20(s, d):
    """Arms and their merger as one tagged table."""
    arms = _arms(s, d)
    merged = R.fuse(arms, "doc_id", {"bm25": 0.5, "similarity": 0.5}, None, None)
    named = [a.select(F.lit(n).alias("list"), "doc_id", F.round("score", 6).alias("score")) for n, a in arms.items()]
    groups = frame(s, d, "articles").join(_articles(s, d).filter("bm25 > 0"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("score"))
    groups = groups.select(F.concat(F.lit("keywords_"), "lang").alias("list"), F.lit(None).cast("long").alias("doc_id"), "score")
    return named[0].unionByName(named[1]).unionByName(merged.select(F.lit("merged").alias("list"), "doc_id", F.round("hybrid", 6).alias("score"))).unionByName(groups)


R20_SQL = with_sql(
    """SELECT 'bm25' AS list, doc_id, round(score, 6) AS score FROM keyword UNION ALL SELECT 'similarity', doc_id, round(score, 6) FROM vectors UNION ALL SELECT 'merged', doc_id, round(hybrid, 6) FROM merged
       UNION ALL SELECT concat('keywords_', lang), NULL, CAST(count(*) AS DOUBLE) FROM scored WHERE bm25 > 0 GROUP BY lang""",
    DOCS_BM25, SIMILAR, *ARMS_SQL,
)


PHRASES = ["of the", "in the", "it is that"]


def r21(s, d):
    """Documents with any of some phrases, by positions in the index; no text is read."""
    found = index(s, d, "articles").phrases("content", PHRASES)
    return found.join(frame(s, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.round("bm25", 6).alias("score"))


def _phrase_score(hits: str, df: str) -> str:
    return f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * ({hits} * 2.2 / ({hits} + 1.2 * (0.25 + 0.75 * l / a)))"


_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+')"
_SIZES = ("sizes", "SELECT *, CAST(len(w) AS DOUBLE) AS l, CAST(count(*) OVER () AS DOUBLE) AS n, avg(len(w)) OVER () AS a FROM words")


def _hits_sql(phrase: list[str]) -> str:
    return f"CAST(len(list_filter(range(1, len(w) - {len(phrase) - 2}), lambda i: {' AND '.join(f'w[i + {j}] = {chr(39)}{t}{chr(39)}' for j, t in enumerate(phrase))})) AS DOUBLE)"


R21_SQL = with_sql(
    f"SELECT doc_id, lang, round({' + '.join(f'CASE WHEN h{i} > 0 THEN {_phrase_score(f'h{i}', f'd{i}')} ELSE 0 END' for i in range(len(PHRASES)))}, 6) AS score FROM scored WHERE {' OR '.join(f'h{i} > 0' for i in range(len(PHRASES)))}",
    ("words", f"SELECT doc_id, lang, {_W} AS w FROM documents"),
    _SIZES,
    ("hits", f"SELECT *, {', '.join(f'{_hits_sql(p.split())} AS h{i}' for i, p in enumerate(PHRASES))} FROM sizes"),
    ("scored", f"SELECT *, {', '.join(f'CAST(count(*) FILTER (h{i} > 0) OVER () AS DOUBLE) AS d{i}' for i in range(len(PHRASES)))} FROM hits"),
)


def r22(s, d):
    """Terms of the benchmark (the first three words of each item) as phrases in documents, score of .7 or more."""
    words = F.slice(TEXT.tokens(F.col("text")), 1, 3)
    terms = frame(s, d, "benchmark").select("item_id", F.array_join(words, " ").alias("term"))
    found = index(s, d, "articles").match_phrases(terms, "item_id", "term", "content").filter("bm25 >= 0.7")
    return found.join(terms, "item_id").select("item_id", "term", "doc_id", "hits", F.round("bm25", 6).alias("score"))


R22_SQL = with_sql(
    f"SELECT item_id, array_to_string(p, ' ') AS term, doc_id, CAST(h AS BIGINT) AS hits, round(sc, 6) AS score FROM (SELECT *, {_phrase_score('h', 'd')} AS sc FROM (SELECT *, CAST(count(*) OVER (PARTITION BY item_id) AS DOUBLE) AS d FROM met)) WHERE sc >= 0.7",
    ("words", f"SELECT doc_id, {_W} AS w FROM documents"),
    _SIZES,
    ("terms", f"SELECT item_id, p, ' ' || array_to_string(p, ' ') || ' ' AS line FROM (SELECT item_id, {_W}[1:3] AS p FROM benchmark) WHERE len(p) > 0"),
    ("texts", "SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM sizes"),
    ("met", "SELECT item_id, p, doc_id, l, n, a, CAST(len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS DOUBLE) AS h FROM terms t JOIN texts x ON contains(x.line, t.line)"),
)
SPOT = "The Red Steel part and a small Blue one"


def r23(s, d):
    """Terms of the glossary in a query: whole words, grouped by first token, the longest of each."""
    g = frame(s, d, "glossary").select("term").distinct().filter(F.length("term") >= 2)
    hit = g.filter(F.exists(TEXT.tokens(F.col("term")), lambda t: F.array_contains(F.array(*[F.lit(x) for x in TEXT.query(SPOT)]), t)))
    root = F.try_element_at(TEXT.tokens(F.col("term")), F.lit(1))
    return hit.groupBy(root.alias("root")).agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("longest"), F.count(F.lit(1)).alias("n"))


R23_SQL = with_sql(
    f"""SELECT root, arg_max(term, printf('%05d', length(term)) || term) AS longest, count(*) AS n FROM (SELECT DISTINCT term, regexp_extract_all(lower(term), '[\\pL\\pN]+')[1] AS root FROM {{glossary}}
        WHERE length(term) >= 2 AND len(list_intersect(regexp_extract_all(lower(term), '[\\pL\\pN]+'), {TEXT.query(SPOT)!r})) > 0) GROUP BY root"""
)


def r23_all(s, d):
    """Benchmark words of seven letters or more spotted in each chat turn, by one automaton."""
    words = frame(s, d, "benchmark").select(F.explode(TEXT.tokens(F.col("text"))).alias("word")).filter(F.length("word") >= 7)
    found = spot_terms(frame(s, d, "conversations"), ["conv_id", "turn"], "text", words, "word")
    return found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("terms"))


R23_ALL_SQL = """SELECT conv_id, turn, count(*) AS terms FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+')) AS word FROM conversations)
  WHERE length(word) >= 7 AND word IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) FROM benchmark) GROUP BY conv_id, turn"""


def r23_terms(s, d):
    """Glossary terms of several words in each definition of goods: per first word, the longest."""
    goods = frame(s, d, "glossary").select("term_id", F.concat_ws(" ", F.lit("The"), "term", F.lit("is a"), "term").alias("line"))
    found = spot_terms(goods, ["term_id"], "line", frame(s, d, "glossary"), "term")
    return longest_by_root(found, ["term_id"])


R23_TERMS_SQL = with_sql(
    """SELECT term_id, root, max(line) AS longest, count(*) AS n FROM (SELECT g.term_id, t.line, split_part(t.line, ' ', 1) AS root FROM
       (SELECT term_id, 'the ' || array_to_string(regexp_extract_all(lower(term), '[\\pL\\pN]+'), ' ') || ' is a ' || array_to_string(regexp_extract_all(lower(term), '[\\pL\\pN]+'), ' ') AS text FROM {glossary}) g
       JOIN (SELECT DISTINCT array_to_string(regexp_extract_all(lower(term), '[\\pL\\pN]+'), ' ') AS line FROM {glossary}) t ON contains(' ' || g.text || ' ', ' ' || t.line || ' ')) GROUP BY term_id, root"""
)


def r24(s, d):
    """Similarity plus a fifth where the term occurs in the query."""
    g = frame(s, d, "glossary").join(_similar(s, d), F.col("term_id") == F.col("vec_id"))
    g = g.withColumn("score", F.col("similarity") + F.when(F.contains(F.lit(SPOT.lower()), F.lower("category")) | F.exists(TEXT.tokens(F.col("term")), lambda t: t.isin(TEXT.query(SPOT))), 0.2).otherwise(0.0))
    levels = [F.col("score") >= 0.45, F.col("score") >= 0.25]
    return R.top(R.relax(g, levels), "score", "term_id", 10).select("term_id", "level", F.round("score", 6).alias("score"))


R24_SQL = with_sql(
    "SELECT term_id, level, round(sc, 6) AS score FROM lv WHERE level = (SELECT min(level) FROM lv) ORDER BY sc DESC, term_id LIMIT 10",
    SIMILAR,
    ("g", f"""SELECT term_id, similarity + CASE WHEN contains('{SPOT.lower()}', lower(category)) OR len(list_intersect(regexp_extract_all(lower(term), '[\\pL\\pN]+'), {TEXT.query(SPOT)!r})) > 0 THEN 0.2 ELSE 0 END AS sc
        FROM {{glossary}} JOIN near ON term_id = vec_id"""),
    ("lv", "SELECT * FROM (SELECT *, CASE WHEN sc >= 0.45 THEN 1 WHEN sc >= 0.25 THEN 2 END AS level FROM g) WHERE level IS NOT NULL"),
)
WORDS = ["steel", "brushed", "large"]


def r25(s, d):
    g = frame(s, d, "glossary").withColumn("score", R.keyword_score(F.col("definition"), WORDS)).filter("score > 0.2")
    return g.select("term_id", F.round("score", 6).alias("score"))


R25_SQL = with_sql(
    f"""SELECT term_id, round(sc, 6) AS score FROM (SELECT term_id, ({" + ".join(f"CASE WHEN len(list_filter(regexp_extract_all(lower(definition), '[\\pL\\pN]+'), lambda t: starts_with(t, '{w}') OR starts_with('{w}', t))) > 0 THEN 1.0 ELSE 0.0 END" for w in WORDS)}) / 3 AS sc FROM {{glossary}}) WHERE sc > 0.2"""
)


def r27(s, d):
    """Terms of the kinds that matched terms name as related."""
    g = frame(s, d, "glossary").groupBy("term").agg(F.sort_array(F.collect_set("category")).alias("links"))
    brands = frame(s, d, "glossary").select(F.col("category").alias("term")).distinct()
    matched = g.filter(F.array_contains(TEXT.tokens(F.col("term")), "widget"))
    return R.related(brands, matched.select("term", "links"), "term", "links").select("term")


R27_SQL = with_sql(
    """SELECT DISTINCT category AS term FROM {glossary} WHERE lower(category) IN (SELECT lower(category) FROM {glossary} WHERE list_contains(regexp_extract_all(lower(term), '[\\pL\\pN]+'), 'widget'))
       AND category NOT IN (SELECT term FROM {glossary} WHERE list_contains(regexp_extract_all(lower(term), '[\\pL\\pN]+'), 'widget'))"""
)


def r28(s, d):
    """Wide semantic candidates, raised by the overlap of question words with term and definition."""
    g = R.top(_similar(s, d).filter("similarity >= 0.1"), "similarity", "vec_id", 60).join(frame(s, d, "glossary"), F.col("vec_id") == F.col("term_id"))
    words = F.array(*[F.lit(w) for w in TEXT.query(SPOT)])
    part = lambda c: F.size(F.array_intersect(TEXT.tokens(F.col(c)), words)) / F.lit(float(len(TEXT.query(SPOT))))
    g = g.withColumn("score", F.least(F.lit(1.0), F.col("similarity") * (1 + 0.3 * part("term") + 0.2 * part("definition")))).filter("score >= 0.2")
    return R.top(g, "score", "term_id", 10).select("term_id", F.round("score", 6).alias("score"))


_N = len(TEXT.query(SPOT))
R28_SQL = with_sql(
    "SELECT term_id, round(sc, 6) AS score FROM g WHERE sc >= 0.2 ORDER BY sc DESC, term_id LIMIT 10",
    SIMILAR,
    ("c", "SELECT * FROM near WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 60"),
    ("g", f"""SELECT term_id, least(1.0, similarity * (1 + 0.3 * len(list_intersect(list_distinct(regexp_extract_all(lower(term), '[\\pL\\pN]+')), {TEXT.query(SPOT)!r})) / {_N}.0
        + 0.2 * len(list_intersect(list_distinct(regexp_extract_all(lower(definition), '[\\pL\\pN]+')), {TEXT.query(SPOT)!r})) / {_N}.0)) AS sc FROM c JOIN {{glossary}} ON vec_id = term_id"""),
)


def r31(s, d):
    a = R.top(_articles(s, d).filter("bm25 > 0"), "bm25", "doc_id", 10).select(F.lit("knowledge").alias("kind"), F.col("doc_id").alias("key"), F.col("bm25").alias("score"))
    g = _glossary(s, d, {"term": 1.0}, ["steel"]).filter("bm25 > 0")
    g = R.top(g, "bm25", "term_id", 10).select(F.lit("glossary").alias("kind"), F.col("term_id").alias("key"), F.col("bm25").alias("score"))
    return R.top(a.unionByName(g), "score", ["kind", "key"], 12).select("kind", "key", F.round("score", 6).alias("score"))


R31_SQL = with_sql(
    """SELECT kind, key, round(sc, 6) AS score FROM (SELECT * FROM (SELECT 'knowledge' AS kind, doc_id AS key, bm25 AS sc FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT 10)
       UNION ALL SELECT * FROM (SELECT 'glossary', term_id, bm25 FROM g WHERE bm25 > 0 ORDER BY bm25 DESC, term_id LIMIT 10)) ORDER BY sc DESC, kind, key LIMIT 12""",
    DOCS_BM25,
    ("g", bm25_sql("{glossary}", {"term": 1.0}, ["steel"])),
)


def r33(s, d, mode="keyword"):
    """One entry for the three kinds of search."""
    return {"keyword": r01, "semantic": r05, "hybrid": r09}[mode](s, d)


def r34(s, d):
    a = frame(s, d, "articles")
    hit = lambda c: F.lower(c).contains("tion")
    return a.filter(hit("title") | hit("description") | hit("content")).select("doc_id")


def k02(s, d):
    """Share of a query's words among a fact's terms."""
    f = frame(s, d, "facts").withColumn("score", R.overlap_share(F.array_distinct(TEXT.tokens(F.col("content"))), ["of", "the", "idiot"]))
    return f.filter("score >= 0.3").select("fact_id", F.round("score", 6).alias("score"))


def k01(s, d):
    f = frame(s, d, "facts").withColumn("score", R.domain_keyword_score(["en", "src1", "src"], F.array("lang", "source", "tenure"), ["temporary"]))
    return f.filter("score >= 0.1").select("fact_id", F.round("score", 6).alias("score"))


_PAIR = " + ".join(f"CAST(len(list_filter([lang, source, tenure], lambda x: contains(lower(x), '{t}') OR contains('{t}', lower(x)))) AS DOUBLE)" for t in ("en", "src1", "src"))
K01_SQL = with_sql(f"SELECT fact_id, round(sc, 6) AS score FROM (SELECT fact_id, least(({_PAIR}) / 3, 0.95) + CASE WHEN tenure = 'temporary' THEN 0.5 ELSE 0.0 END AS sc FROM {{facts}}) WHERE sc >= 0.1")


def k03(s, d):
    """Errors by the tokens of a message, each with how often its user saw others."""
    e = frame(s, d, "events")
    err = e.filter("event_type = 'error'").filter(F.arrays_overlap(TEXT.tokens(F.col("props")), F.array(*[F.lit(x) for x in ("7", "42")])))
    others = e.filter("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("others"))
    return err.join(others, "user_id", "left").select("event_id", "user_id", F.coalesce("others", F.lit(0)).alias("others"))


K03_SQL = """SELECT event_id, e.user_id, coalesce(others, 0) AS others FROM events e LEFT JOIN (SELECT user_id, count(*) AS others FROM events WHERE event_type <> 'error' GROUP BY user_id) o ON e.user_id = o.user_id
  WHERE event_type = 'error' AND len(list_intersect(regexp_extract_all(lower(props), '[\\pL\\pN]+'), ['7', '42'])) > 0"""

QUERIES = {
    "r01_bm25_boosted": r01, "r02_bm25_field": r02, "r02_rows_read": r02_reads, "r03_bm25_domain": r03, "r04_bm25_gate": r04, "r05_cosine_topk": r05, "r06_cosine_glossary": r06, "r07_cosine_filter": r07,
    "r08_approximate_neighbours": r08, "r08_neighbours_of_many": r08_many, "r08_recall": r08_recall, "r09_hybrid_two_arm": r09, "r10_relaxation": r10, "r11_hybrid_no_threshold": r11, "r12_hybrid_glossary": r12, "r14_cross_collection": r14, "r15_one_pass_hybrid": r15,
    "r16_recall": lambda s, d: recall(s, d), "r17_recall_normalised": lambda s, d: recall(s, d, lang="en", normalise=True, over=2, threshold=0.2), "r18_recall_over_fetch": lambda s, d: recall(s, d, lang="en", normalise=True, over=3, threshold=0.1),
    "r19_hybrid_alias": lambda s, d: recall(s, d, threshold=0.3), "r20_four_list_report": r20, "r21_phrase": r21, "r22_terms_in_text": r22, "r23_term_spotting": r23, "r23_words_in_texts": r23_all, "r23_longest_terms": r23_terms, "r24_semantic_exact_boost": r24, "r25_keyword_fallback": r25,
    "r27_related_terms": r27, "r28_question_terms": r28, "r31_combined_ranking": r31, "r33_dispatch": r33, "r34_substring_fields": r34, "k01_domain_keywords": k01, "k02_term_overlap": k02, "k03_error_lookup": k03,
}

ORACLES = {
    "r01_bm25_boosted": with_sql("SELECT doc_id, round(bm25, 6) AS score FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT 5", DOCS_BM25),
    "r02_bm25_field": with_sql("SELECT doc_id, round(bm25, 6) AS score FROM scored WHERE bm25 >= 2", CONTENT_BM25),
    "r03_bm25_domain": with_sql("SELECT fact_id, lang, round(bm25, 6) AS score FROM scored WHERE bm25 > 0.1 AND lang = 'en' ORDER BY bm25 DESC, fact_id LIMIT 10", ("scored", bm25_sql("{facts}", {"content": 1.0}, TOKENS))),
    "r04_bm25_gate": with_sql("SELECT count(*) FILTER (bm25 > 0.1) > 0 AS exists FROM scored", DOCS_BM25),
    "r05_cosine_topk": with_sql("SELECT vec_id, round(similarity, 6) AS similarity FROM near WHERE near.similarity > 0.2 ORDER BY near.similarity DESC, vec_id LIMIT 30", SIMILAR),
    "r06_cosine_glossary": with_sql("SELECT term_id, term, definition, round(similarity, 6) AS similarity FROM {glossary} JOIN near ON term_id = vec_id WHERE near.similarity >= 0.15 ORDER BY near.similarity DESC, term_id LIMIT 10", SIMILAR),
    "r07_cosine_filter": with_sql("SELECT vec_id, round(similarity, 6) AS similarity FROM near WHERE near.similarity >= 0.15", SIMILAR),
    "r09_hybrid_two_arm": with_sql("SELECT doc_id, round(bm25, 6) AS bm25, round(similarity, 6) AS similarity, round(hybrid, 6) AS hybrid FROM merged WHERE merged.hybrid >= 0.15 ORDER BY merged.hybrid DESC, doc_id LIMIT 15", DOCS_BM25, SIMILAR, *ARMS_SQL),
    "r10_relaxation": R10_SQL,
    "r11_hybrid_no_threshold": with_sql(
        "SELECT doc_id, round(hybrid, 6) AS hybrid FROM merged ORDER BY merged.hybrid DESC, doc_id LIMIT 10", DOCS_BM25, SIMILAR,
        ("keyword", "SELECT doc_id, bm25 AS score FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT 20"),
        ("vectors", "SELECT vec_id AS doc_id, similarity AS score FROM near WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 20"), *ARMS_SQL[2:],
    ),
    "r12_hybrid_glossary": R12_SQL, "r14_cross_collection": R14_SQL, "r15_one_pass_hybrid": R15_SQL, "r16_recall": recall_sql(), "r17_recall_normalised": recall_sql(lang="en", normalise=True, over=2, threshold=0.2),
    "r18_recall_over_fetch": recall_sql(lang="en", normalise=True, over=3, threshold=0.1), "r19_hybrid_alias": recall_sql(threshold=0.3), "r20_four_list_report": R20_SQL, "r21_phrase": R21_SQL, "r22_terms_in_text": R22_SQL,
    "r23_term_spotting": R23_SQL, "r23_words_in_texts": R23_ALL_SQL, "r23_longest_terms": R23_TERMS_SQL, "r24_semantic_exact_boost": R24_SQL, "r25_keyword_fallback": R25_SQL, "r27_related_terms": R27_SQL, "r28_question_terms": R28_SQL, "r31_combined_ranking": R31_SQL,
    "r34_substring_fields": with_sql("SELECT doc_id FROM {articles} WHERE contains(lower(title), 'tion') OR contains(lower(description), 'tion') OR contains(lower(content), 'tion')"),
    "k01_domain_keywords": K01_SQL,
    "k02_term_overlap": with_sql("SELECT fact_id, round(sc, 6) AS score FROM (SELECT fact_id, len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\pL\\pN]+')), ['of', 'the', 'idiot'])) / 3.0 AS sc FROM {facts}) WHERE sc >= 0.3"),
    "k03_error_lookup": K03_SQL,
}
ORACLES["r33_dispatch"] = ORACLES["r01_bm25_boosted"]
