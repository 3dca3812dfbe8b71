"""Queries of file sources, entry points, validators and text search by embedded query texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT
from lodestrata.functions.fuzzy import ratio_column
from lodestrata.functions.vectors import cosine_of, embed
from lodestrata.operators import catalog as K
from lodestrata.operators import corpus as C
from lodestrata.operators import retrieval as R
from lodestrata.plans import session as S
from lodestrata.plans.entities import frame, with_sql
from lodestrata.plans.retrieval_queries import QUERIES as RETRIEVAL
from lodestrata.plans.retrieval_queries import bm25_sql
from lodestrata.sources import files
from lodestrata.sources.scratch import scratch_root

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None, *more: tuple[str, str]):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = with_sql(sql, *more)
        return f

    return add


# --- File sources: files made from the small tables, read back -------------------------------


def _folder(s: SparkSession, contents: dict[str, str]) -> str:
    """Write named files to a new scratch folder; the tables they come from have a fixed size."""
    root = f"{scratch_root(s)}/sources-{uuid.uuid4().hex}"
    jvm = s.sparkContext._jvm
    for name, text in contents.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def _nations(s, d):
    return frame(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale


def _json(rows: list[dict]) -> str:
    import json

    return json.dumps(rows, ensure_ascii=False)


@query("s03_rule_files", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS rule_number, n_name AS title, 'Region ' || n_regionkey AS description FROM nation")
def s03(s, d):
    rows = {f"{r.n_nationkey:03d}-rule.mdc": f"---\nglobs: '*.py'\n---\n\n# {r.n_name}\n\nRegion {r.n_regionkey}\n\n## More\n\n{r.n_comment if 'n_comment' in r else ''}\n" for r in _nations(s, d)}
    return files.rules(s, _folder(s, rows)).select("rule_number", "title", "description")


@query("s04_glossary_file", "SELECT n_name AS term, 'in region ' || n_regionkey AS definition FROM nation WHERE n_nationkey % 5 NOT IN (1, 2)")
def s04(s, d):
    rows = [{"term": None if r.n_nationkey % 5 == 1 else r.n_name, "definition": "" if r.n_nationkey % 5 == 2 else f"in region {r.n_regionkey}"} for r in _nations(s, d)]
    return files.glossary(s, _folder(s, {"glossary.json": _json(rows)})).select("term", "definition")


@query("s05_scenario_file", "SELECT n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'description' WHEN n_nationkey % 3 = 1 THEN 'query_example,expected_result_format' ELSE '' END AS missing FROM nation")
def s05(s, d):
    def one(r):
        k = r.n_nationkey % 3
        return {"title": r.n_name, "description": None if k == 0 else "d", "query_example": "" if k == 1 else "q", "expected_result_format": None if k == 1 else "rows", "priority": 1}

    good, bad = files.scenarios(s, _folder(s, {"scenarios.json": _json([one(r) for r in _nations(s, d)])}))
    return good.select("title", F.lit("").alias("missing")).unionByName(bad.select("title", F.array_join("missing", ",").alias("missing")))


@query("s06_error_catalogue", "SELECT n_name AS name, CAST(1000 + n_nationkey AS BIGINT) AS code, 'in region ' || n_regionkey AS description, CAST(n_regionkey AS VARCHAR) AS category FROM nation WHERE n_nationkey % 4 <> 0")
def s06(s, d):
    lines = ["# name, code, description, category"]
    lines += [f"{r.n_name}, {'none' if r.n_nationkey % 4 == 0 else 1000 + r.n_nationkey}, in region {r.n_regionkey}, {r.n_regionkey}" for r in _nations(s, d)]
    return files.error_catalogue(s, _folder(s, {"errors.csv": "\n".join(lines)}))


@query("s07_error_lines", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS code, 'see, region ' || n_regionkey AS description, CASE WHEN n_nationkey < 5 THEN 'General' ELSE 'From ' || (n_nationkey - n_nationkey % 5) END AS category FROM nation")
def s07(s, d):
    lines = ["# all errors"]
    for r in _nations(s, d):
        if r.n_nationkey >= 5 and r.n_nationkey % 5 == 0:
            lines += ["", f"## From {r.n_nationkey}"]
        lines.append(f'{r.n_name}, {r.n_nationkey}, "see, region {r.n_regionkey}"')
    return files.error_lines(s.read.text(_folder(s, {"errors.txt": "\n".join(lines)}), wholetext=True))


def _repository(s, d) -> str:
    kinds = (".py", ".md", ".tmp.py", ".sql")
    return _folder(s, {f"{'vendor' if r.n_nationkey % 7 == 0 else 'src'}/n{r.n_nationkey}{kinds[r.n_nationkey % 4]}": r.n_name for r in _nations(s, d)})


_FILE = "CASE WHEN n_nationkey % 7 = 0 THEN 'vendor' ELSE 'src' END || '/n' || n_nationkey || CASE n_nationkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.tmp.py' ELSE '.sql' END"


@query("s08_repository_walk", f"SELECT {_FILE} AS path, n_name AS content FROM nation WHERE n_nationkey % 4 IN (0, 1) AND n_nationkey % 7 <> 0")
def s08(s, d):
    found = files.repository(s, _repository(s, d), (".py", ".md"), ignore=r"/vendor/|\.tmp\.")
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), "content")


@query("s09_repository_extract", f"SELECT path FROM (SELECT {_FILE} AS path FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey % 7 <> 0) ORDER BY path LIMIT 4")
def s09(s, d):
    found = files.repository(s, _repository(s, d), include="*.py", exclude=("*/vendor/*", "*.tmp.py"), most=4)
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"))


@query("s12_saved_queries", "SELECT 'q' || n_nationkey AS name, 'SELECT ' || n_regionkey AS text FROM nation")
def s12(s, d):
    return files.saved_queries(s, _folder(s, {f"q{r.n_nationkey}.sql": f"\nSELECT {r.n_regionkey}\n" for r in _nations(s, d)}))


@query("s17_graph_dump", "SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, CAST(n_nationkey AS DOUBLE) / 25 AS strength FROM nation")
def s17(s, d):
    lines = [_json({"_from": f"nation/{r.n_nationkey}", "_to": f"region/{r.n_regionkey}", "strength": r.n_nationkey / 25}) for r in _nations(s, d)]
    dump = files.json_lines(s, _folder(s, {"edges.jsonl": "\n".join(lines)}), "_from string, _to string, strength double")
    return dump.select(F.col("_from").alias("src"), F.col("_to").alias("dst"), "strength")


@query("w11_written_pairs", "SELECT 'What is ' || p_name || '?' AS instruction, '' AS input, p_type AS output FROM part")
def w11(s, d):
    """The pairs as written for training, read back."""
    path = f"{scratch_root(s)}/pairs-{uuid.uuid4().hex}"
    files.write_pairs(frame(s, d, "part").select(F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("question"), F.col("p_type").alias("answer")), path)
    return s.read.schema("instruction string, input string, output string").json(path)


@query("s16_cast_graph", """SELECT a.o_custkey AS actor, b.o_custkey AS other, count(DISTINCT a.l_partkey) AS films FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50) a
  JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50) b ON a.l_partkey = b.l_partkey AND a.o_custkey < b.o_custkey GROUP BY 1, 2""")
def s16(s, d):
    """A property graph of actors (customers) in films (parts), and who appears together how often."""
    acted = frame(s, d, "lineitem").filter("l_quantity = 50").join(frame(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("actor"), F.col("l_partkey").alias("film")).distinct()
    both = acted.join(acted.withColumnRenamed("actor", "other"), "film").filter("actor < other")
    return both.groupBy("actor", "other").agg(F.count(F.lit(1)).alias("films"))


# --- Stores, caches and definitions -----------------------------------------------------------

SAMPLE = "SELECT n_name AS term, 'nation ' || n_nationkey AS definition FROM nation"


@query("w15_bootstrap", SAMPLE)
def w15(s, d):
    """A sample fills a store that is empty."""
    sample = s.sql(SAMPLE.replace("FROM nation", "FROM {nation}"), nation=frame(s, d, "nation"))
    return S.bootstrap(s.createDataFrame([], "term string, definition string"), sample)


SCHEMA = {
    "collections": ["customer", "nation", "region"],
    "edges": {"lives_in": ("customer", "nation"), "part_of": ("nation", "region")},
    "graphs": {"places": ["lives_in", "part_of"]},
    "views": {"articles_view": {"articles": ["title", "content"]}},
    "analyzers": {"text": "words", "text_en": "stems"},
}


@query("w16_definitions", """SELECT 'collection' AS kind, 'customer' AS name, '' AS detail, count(*) AS n FROM customer UNION ALL SELECT 'collection', 'nation', '', count(*) FROM nation UNION ALL SELECT 'collection', 'region', '', count(*) FROM region
  UNION ALL SELECT 'edge', 'lives_in', 'customer>nation', count(*) FROM customer UNION ALL SELECT 'edge', 'part_of', 'nation>region', count(*) FROM nation
  UNION ALL SELECT 'graph', 'places', 'lives_in,part_of', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) UNION ALL SELECT 'view', 'articles_view', 'articles(title,content)', count(*) FROM documents
  UNION ALL SELECT 'analyzer', 'text', 'words', 0 UNION ALL SELECT 'analyzer', 'text_en', 'stems', 0""")
def w16(s, d):
    return K.define(s, SCHEMA, lambda n: frame(s, d, n), frame(s, d, "property_edges"), "lodestrata_")


_CACHE = S.ResultCache()


def _cached(name):
    """A search whose result is held with the last ten, for an hour at most."""
    return lambda s, d: _CACHE.get((s.sparkContext.applicationId, name, d), lambda: RETRIEVAL[name](s, d))


def _same_as(name: str, other: str):
    from lodestrata.plans.retrieval_queries import ORACLES

    Q[name], O[name] = _cached(other), ORACLES[other]


_same_as("r32_cached_rule_search", "r01_bm25_boosted")
_same_as("d15_cached_result", "r02_bm25_field")


@query("t24_formatted", "SELECT '| ' || p_partkey || ' | ' || p_name || ' |' AS markdown, '<tr><td>' || p_partkey || '</td><td>' || replace(p_name, '<', '&lt;') || '</td></tr>' AS html, p_partkey || chr(9) || p_name AS text FROM part")
def t24(s, d):
    rows = frame(s, d, "part").select("p_partkey", "p_name")
    return rows.select(*[S.line(rows.columns, style).alias(style) for style in ("markdown", "html", "text")])


# --- Scenarios, validators, filters -----------------------------------------------------------

SCENARIOS = """SELECT p_partkey AS scenario_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title, p_type AS description, p_brand AS query_example, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'rows' END AS expected_result_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'one' ELSE '["one", "two"]' END AS validation_criteria, CASE WHEN p_partkey % 6 = 0 THEN 'high' ELSE CAST(p_size AS VARCHAR(9)) END AS priority, p_partkey % 11 AS updated FROM {part}"""


def _scenarios(s, d):
    return s.sql(SCENARIOS, part=frame(s, d, "part"))


@query("p07_scenario_store", """SELECT title, scenario_id, updated, count(*) OVER () AS stored FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY updated DESC, scenario_id DESC) AS r FROM scenarios WHERE title IS NOT NULL) WHERE r = 1""", ("scenarios", SCENARIOS))
def p07(s, d):
    """The store after all scenarios were put into it by title, newest last; with their number."""
    stored = C.latest_by(_scenarios(s, d).filter("title IS NOT NULL"), "title", ["updated", "scenario_id"])
    n = stored.agg(F.count(F.lit(1)).alias("stored"))
    return stored.select("title", "scenario_id", "updated").crossJoin(F.broadcast(n))  # one row


@query("p08_scenario_contract", """SELECT scenario_id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN expected_result_type IS NULL THEN 'expected_result_type' END) AS missing,
  concat_ws(',', CASE WHEN scenario_id % 4 = 0 THEN 'validation_criteria' END, CASE WHEN scenario_id % 6 = 0 THEN 'priority' END) AS mistyped FROM scenarios""", ("scenarios", SCENARIOS))
def p08(s, d):
    return K.scenario_faults(_scenarios(s, d)).select("scenario_id", F.array_join("missing", ",").alias("missing"), F.array_join("mistyped", ",").alias("mistyped"))


PACKAGES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'os' WHEN 1 THEN 'numpy' WHEN 2 THEN '_private' WHEN 3 THEN 'polars' WHEN 4 THEN 're' ELSE p_brand END AS package FROM {part}"


@query("p11_packages", "SELECT p_partkey, package FROM packages WHERE p_partkey % 6 IN (3, 5)", ("packages", PACKAGES))
def p11(s, d):
    return s.sql(PACKAGES, part=frame(s, d, "part")).filter(K.worth_analysing(F.col("package")))


MESSAGES = """SELECT user_id % 20 AS run, event_id, CASE event_type WHEN 'error' THEN 'Critical Error' WHEN 'click' THEN 'Style Issue' WHEN 'view' THEN 'Warning' WHEN 'purchase' THEN 'Method/Attribute Issue' ELSE 'Note' END AS category,
  CASE WHEN event_id % 3 = 0 THEN 'trailing-whitespace' ELSE 'other' END AS symbol FROM {events}"""


@query("p13_lint_buckets", """SELECT run, b AS bucket, count(*) AS n, string_agg(DISTINCT CASE WHEN symbol = 'trailing-whitespace' THEN 'Remove trailing whitespace from all lines' END, '|') AS more
  FROM (SELECT *, CASE category WHEN 'Critical Error' THEN 'type_issues' WHEN 'Method/Attribute Issue' THEN 'method_issues' WHEN 'Style Issue' THEN 'style_issues' ELSE 'quality_issues' END AS b FROM messages) GROUP BY run, b""", ("messages", MESSAGES))
def p13(s, d):
    rows = s.sql(MESSAGES, events=frame(s, d, "events"))
    out = rows.groupBy("run", K.lint_bucket(F.col("category")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(K.lint_advice(F.col("symbol")))), "|").alias("more"))
    return out.withColumn("more", F.nullif("more", F.lit("")))


@query("p14_rule_fields", "SELECT doc_id, CASE WHEN title = '' THEN 'Untitled Rule' ELSE title END AS title, coalesce(nullif(source, ''), 'No description') AS description, length(content) AS n_chars FROM {articles} WHERE doc_id = 7 OR title = (SELECT title FROM {articles} WHERE doc_id = 3)")
def p14(s, d):
    """Titles, descriptions and contents with their defaults, of rules by number or by title."""
    a = frame(s, d, "articles")
    default = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    third = a.filter("doc_id = 3").select("title").limit(1)
    by_title = a.join(F.broadcast(third), "title", "left_semi")  # one row
    found = a.filter("doc_id = 7").unionByName(by_title).dropDuplicates(["doc_id"])
    return found.select("doc_id", default("title", "Untitled Rule").alias("title"), default("source", "No description").alias("description"), F.length("content").cast("long").alias("n_chars"))


@query("p17_normalised", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[^a-zA-Z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS normalised, md5(regexp_replace(lower(url), '[^a-z0-9]', '', 'g')) AS plain FROM pages")
def p17(s, d):
    """Texts without markup and special characters; urls without punctuation."""
    return frame(s, d, "pages").select("page_id", F.md5(C.normalised(F.col("html"))).alias("normalised"), F.md5(C.without_punctuation(F.col("url"))).alias("plain"))


FIELDS = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN repeat('word ', 31) ELSE p_type END AS description, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'text' ELSE 'array' END AS type,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS citation FROM {part}"""


@query("p19_field_checks", """SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 9 = 1 THEN 'description too long' END, CASE WHEN p_partkey % 9 = 0 THEN 'description missing' END, CASE WHEN p_partkey % 4 = 2 THEN 'type invalid' END, CASE WHEN p_partkey % 5 = 0 THEN 'citation missing' END) AS faults FROM part""")
def p19(s, d):
    return s.sql(FIELDS, part=frame(s, d, "part")).select("p_partkey", F.array_join(K.field_faults("description", "type", "citation"), "|").alias("faults"))


# --- Search by embedded query texts ------------------------------------------------------------

DIMENSION = 64


def embed_sql(text: str) -> str:
    """The default model as SQL over an expression that gives the text without its prefix."""
    places = f"list_transform(regexp_extract_all(lower({text}), '[\\pL\\pN]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {2 * DIMENSION})"
    count = "len(list_filter(p, lambda z: z = {0}))"
    counts = f"list_transform(range(0, {DIMENSION}), lambda i: CAST({count.format('2 * i')} - {count.format('2 * i + 1')} AS DOUBLE))"
    return f"list_transform([{places}], lambda p: {counts})[1]"


def cosine_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


TERMS = "SELECT min(term_id) AS term_id, term, min(definition) AS definition, min(category) AS category FROM {glossary} GROUP BY term"


def _terms(s, d):
    """Each term once, with its vector."""
    t = s.sql(TERMS, glossary=frame(s, d, "glossary"))
    return t.withColumn("vector", embed(F.concat_ws(": ", "term", "definition")))


def _near_text(terms: DataFrame, text: str) -> DataFrame:
    return terms.withColumn("similarity", F.coalesce(cosine_of(F.col("vector"), embed(F.lit(f"search_query: {text}"))), F.lit(0.0)))


def _near_sql(text: str) -> tuple[tuple[str, str], ...]:
    return (
        ("terms", TERMS), ("vectors", f"SELECT *, {embed_sql("term || ': ' || definition")} AS v FROM terms"), ("asked", f"SELECT {embed_sql(repr(text))} AS q"),
        ("near", f"SELECT term_id, term, definition, category, {cosine_sql('v', 'q')} AS similarity FROM vectors, asked"),
    )


@query("embedded_text_search", "SELECT term_id, term, round(similarity, 6) AS similarity FROM near WHERE similarity >= 0.3 ORDER BY similarity DESC, term_id LIMIT 10", *_near_sql("small ring of brushed steel"))
def text_search(s, d):
    """Terms near a query text, by vectors of both."""
    out = _near_text(_terms(s, d), "small ring of brushed steel").filter("similarity >= 0.3")
    return R.top(out, "similarity", "term_id", 10).select("term_id", "term", F.round("similarity", 6).alias("similarity"))


def fused_terms(s, d, text: str, k: int = 5) -> DataFrame:
    """Glossary search by vectors (0.5 at least) and BM25 (above 0.1), half each, 0.15 at least."""
    near = _near_text(_terms(s, d), text)
    vector = R.top(near.filter("similarity >= 0.5"), "similarity", "term_id", k).select("term_id", F.col("similarity").alias("score"))
    words = R.bm25(_terms(s, d).drop("vector"), {"term": 1.0, "definition": 1.0}, TEXT.query(text)).filter("bm25 > 0.1")
    keyword = R.top(words, "bm25", "term_id", k).select("term_id", F.col("bm25").alias("score"))
    fused = R.fuse({"similarity": vector, "bm25": keyword}, "term_id", {"similarity": 0.5, "bm25": 0.5}, 0.15, k)
    return fused.join(_terms(s, d).select("term_id", "term", "definition", "category"), "term_id")


FUSED_SQL = (
    *_near_sql("small ring"),
    ("scored", bm25_sql("terms", {"term": 1.0, "definition": 1.0}, ["small", "ring"])),
    ("by_vector", "SELECT term_id, similarity, 0.0 AS bm25 FROM near WHERE similarity >= 0.5 ORDER BY similarity DESC, term_id LIMIT 5"),
    ("by_word", "SELECT term_id, 0.0 AS similarity, bm25 FROM scored WHERE bm25 > 0.1 ORDER BY bm25 DESC, term_id LIMIT 5"),
    ("fused", "SELECT term_id, max(similarity) AS similarity, max(bm25) AS bm25, 0.5 * max(similarity) + 0.5 * max(bm25) AS hybrid FROM (SELECT * FROM by_vector UNION ALL SELECT * FROM by_word) GROUP BY term_id"),
    ("best", "SELECT * FROM fused WHERE hybrid >= 0.15 ORDER BY hybrid DESC, term_id LIMIT 5"),
)


@query("r13_verified_hybrid", "SELECT term_id, term, round(hybrid, 6) AS hybrid, round(similarity, 6) AS similarity, round(bm25, 6) AS bm25 FROM best JOIN terms USING (term_id) WHERE lower(term) = 'small ring'", *FUSED_SQL)
def r13(s, d):
    """Hits of both arms whose term equals the query nearly letter by letter (98 of 100)."""
    out = fused_terms(s, d, "small ring").filter(ratio_column(F.lower("term"), F.lit("small ring")) >= 98)
    return out.select("term_id", "term", *[F.round(c, 6).alias(c) for c in ("hybrid", "similarity", "bm25")])


@query("p22_reformatted", "SELECT term_id, round(list_dot_product(v, list_transform(range(0, 64), lambda i: CAST(i AS DOUBLE))) / sqrt(list_dot_product(v, v)), 6) AS checksum, 'search_document' AS format FROM (SELECT term_id, " + embed_sql("term || ': ' || definition") + " AS v FROM {glossary} WHERE term_id % 10 <> 0)")
def p22(s, d):
    """Vectors of a glossary made again in one format; rows without a term or definition stay out."""
    g = frame(s, d, "glossary").withColumn("definition", F.when(F.col("term_id") % 10 != 0, F.col("definition")))
    v = K.reformatted(g, "term", "definition", "vector")
    total = F.aggregate(F.zip_with("vector", F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return v.select("term_id", F.round(total, 6).alias("checksum"), "format")


ASKED = "What is the [TERM: blue bolt | a fastener] next to a small red ring?"


@query("r26_unified_search")
def r26(s, d):
    """Terms that a question embeds, that it nearly names, that it means, and that are related to
    the embedded ones; the first kind that has a term counts."""
    t = _terms(s, d)
    embedded = s.range(1).select(F.explode(C.embedded_terms(F.lit(ASKED))).alias("e")).select(F.lower("e.term").alias("name")).distinct()
    exact = t.join(embedded, F.lower("term") == F.col("name"), "left_semi").withColumn("score", F.lit(1.0))
    fuzzy = R.top(t.withColumn("score", C.token_sort_ratio_column(F.lit(ASKED), F.col("term")) / 100).filter("score >= 0.3"), "score", "term_id", 10)
    named = F.contains(F.lit(ASKED.lower()), F.lower("term"))
    near = _near_text(t, ASKED).withColumn("boost", F.when(named, 0.2).otherwise(0.0)).withColumn("score", F.col("similarity") + F.col("boost"))
    near = R.top(near.filter("score >= 0.2"), "score", "term_id", 10)
    related = t.join(exact.select("category").distinct(), "category", "left_semi").withColumn("score", F.lit(0.1))
    kinds = [(1, "embedded_exact", exact), (2, "fuzzy", fuzzy), (3, "semantic", near), (4, "related", related)]
    frames = []
    for p, kind, df in kinds:
        match = F.when(F.col("boost") > 0, "semantic_exact").otherwise("semantic") if kind == "semantic" else F.lit(kind)
        frames.append((p, df.select("term", "term_id", "score", match.alias("match_type"))))
    return R.priority_union(frames, "term").select("term_id", "term", "match_type", F.round("score", 6).alias("score"))


QUERIES, ORACLES = Q, O
