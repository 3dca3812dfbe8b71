"""Corpus, metadata and fuzzy-matching queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import fuzzy as Z
from lodestrata.functions.lenient_json import question_answers_of
from lodestrata.functions.analysis import TEXT, TEXT_EN, edge_ngrams
from lodestrata.functions.vectors import cosine_of, embed
from lodestrata.operators import catalog as K
from lodestrata.operators import corpus as C
from lodestrata.operators import retrieval as R
from lodestrata.operators.relational import spread
from lodestrata.plans.entities import TABLES, frame, index, with_sql

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None, *more: tuple[str, str]):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = with_sql(sql, *more)
        return f

    return add


# The base documents have no markup: each is wrapped into a markdown file with code.
MARKDOWN_SQL = """SELECT doc_id, concat('by ', lang, chr(10), '# ', split_part(text, chr(10), 1), chr(10), text, chr(10), '## ', source, chr(10), 'see', chr(10), '```python', chr(10), 'import os', chr(10), 'def f', CAST(doc_id AS VARCHAR(20)), '(x):', chr(10), '    return len(x)', chr(10), 'class C', CAST(doc_id AS VARCHAR(20)), ':', chr(10), '    def m(self):', chr(10), '        return 1', chr(10), '```', chr(10), '```', chr(10), 'plain', chr(10), '```') AS content FROM {documents}"""
MD = ("md", MARKDOWN_SQL)
LINES = ("lines", "SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM md")
MARKED = ("marked", "SELECT *, regexp_matches(line, '^#{1,6}[ ]+[^ ]') AS h, sum(CASE WHEN regexp_matches(line, '^#{1,6}[ ]+[^ ]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lines")
PARTS = ("parts", "SELECT doc_id, nth, coalesce(max(CASE WHEN h THEN regexp_extract(line, '^#+[ ]+(.*)$', 1) END), 'Overview') AS title, coalesce(max(CASE WHEN h THEN length(regexp_extract(line, '^(#+)', 1)) END), 0) AS level, coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY pos), '') AS body FROM marked GROUP BY doc_id, nth")
SECTIONS = ("sections", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY nth DESC) AS r FROM parts WHERE nth > 0 OR trim(body) <> '') WHERE r = 1")


def markdown(s, d):
    return s.sql(MARKDOWN_SQL, documents=frame(s, d, "documents"))


@query("t01_markdown_sections", "SELECT doc_id, title, CAST(level AS INTEGER) AS level, md5(body) AS body FROM sections", MD, LINES, MARKED, PARTS, SECTIONS)
def t01(s, d):
    return C.section_table(markdown(s, d), "doc_id", "content").select("doc_id", "title", "level", F.md5("body").alias("body"))


FENCE = "(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"


@query("t02_code_blocks", f"SELECT doc_id, CASE WHEN l = '' THEN 'text' ELSE l END AS language, c AS code FROM (SELECT doc_id, unnest(regexp_extract_all(content, '{FENCE}', 1)) AS l, unnest(regexp_extract_all(content, '{FENCE}', 2)) AS c FROM md)", MD)
def t02(s, d):
    return markdown(s, d).select("doc_id", F.explode(C.code_blocks(F.col("content"))).alias("b")).select("doc_id", F.col("b.language").alias("language"), F.col("b.content").alias("code"))


@query("t03_markdown_record")
def t03(s, d):
    """Sections and code blocks of a file as one record."""
    m = markdown(s, d)
    sections = C.section_table(m, "doc_id", "content").groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("title", "body")))).alias("sections"))
    return m.select("doc_id", C.code_blocks(F.col("content")).alias("code_blocks")).join(sections, "doc_id").select("doc_id", F.size("sections").alias("n_sections"), F.size("code_blocks").alias("n_blocks"))


FILES = """SELECT p_partkey AS file_id, concat('src/', replace(p_name, ' ', '_'), CASE p_partkey % 16 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.md' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '.rs' WHEN 5 THEN ''
  WHEN 6 THEN '.sql' WHEN 7 THEN '.yml' WHEN 8 THEN '.jsx' WHEN 9 THEN '.bat' WHEN 10 THEN '_Makefile' WHEN 11 THEN '.h++' WHEN 12 THEN '.zsh' WHEN 13 THEN '.scss' WHEN 14 THEN '_run' ELSE '.ipynb' END) AS path,
  CASE p_partkey % 16 WHEN 14 THEN concat('#!/usr/bin/env ', CASE WHEN p_partkey % 3 = 0 THEN 'node' WHEN p_partkey % 3 = 1 THEN 'python' ELSE 'pythonic' END) WHEN 5 THEN concat('#!/bin/sh -e', chr(10), 'x') ELSE 'no interpreter' END AS content FROM {part}"""
LANG = """CASE file_id % 16 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'markdown' WHEN 4 THEN 'rust' WHEN 5 THEN 'bash' WHEN 6 THEN 'sql' WHEN 7 THEN 'yaml' WHEN 8 THEN 'jsx' WHEN 9 THEN 'batch' WHEN 10 THEN 'makefile'
  WHEN 11 THEN 'cpp' WHEN 12 THEN 'bash' WHEN 13 THEN 'scss' WHEN 14 THEN CASE file_id % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' ELSE 'unknown' END WHEN 15 THEN 'jupyter' ELSE 'unknown' END"""


def files(s, d):
    return s.sql(FILES, part=frame(s, d, "part"))


def _language():
    return C.language_of(F.col("path"), F.split("content", "\n")[0])


@query("t04_language_detection", f"SELECT file_id, path, {LANG} AS language FROM files", ("files", FILES))
def t04(s, d):
    return files(s, d).select("file_id", "path", _language().alias("language"))


@query("t05_language_category", f"""SELECT category, false AS is_binary, count(*) AS n FROM (SELECT CASE WHEN l IN ('python', 'javascript', 'rust', 'cpp') THEN 'code' WHEN l = 'markdown' THEN 'documentation' WHEN l = 'yaml' THEN 'data'
  WHEN l = 'scss' THEN 'web' WHEN l IN ('bash', 'batch') THEN 'script' ELSE 'unknown' END AS category FROM (SELECT {LANG} AS l FROM files)) GROUP BY category""", ("files", FILES))
def t05(s, d):
    return files(s, d).groupBy(C.category_of(_language()).alias("category"), C.is_binary(F.col("content")).alias("is_binary")).agg(F.count(F.lit(1)).alias("n"))


@query("t06_supported", f"SELECT file_id FROM files WHERE {LANG} IN ('python', 'javascript', 'markdown')", ("files", FILES))
def t06(s, d):
    return files(s, d).filter(_language().isin("python", "javascript", "markdown")).select("file_id")


@query("t07_terms")
def t07(s, d):
    return frame(s, d, "articles").select("doc_id", F.array_join(C.terms_of(F.col("title")), "|").alias("terms"))


NOTED = "concat('Can you explain what [TERM: ', p_name, ' | ', p_type, ' goods] means?')"


@query("t08_embedded_terms", "SELECT p_partkey, p_name AS term, p_type || ' goods' AS definition FROM part")
def t08(s, d):
    noted = frame(s, d, "part").select("p_partkey", F.explode(C.embedded_terms(F.expr(NOTED))).alias("t"))
    return noted.select("p_partkey", "t.term", "t.definition")


@query("t09_annotate", "SELECT p_partkey, CASE WHEN p_name LIKE '%widget' THEN replace(p_name, 'widget', '[TERM: widget | a thing]') ELSE p_name || ' [TERM: widget | a thing]' END AS noted FROM part")
def t09(s, d):
    return frame(s, d, "part").select("p_partkey", C.annotate(F.col("p_name"), "widget", "a thing").alias("noted"))


@query("t10_embedding_text", "SELECT term_id, CASE WHEN starts_with(term, 'red') THEN term ELSE 'search_document: ' || term || ': ' || definition END AS text FROM {glossary}")
def t10(s, d):
    t = F.concat(F.lit("search_document: "), "term", F.lit(": "), "definition")
    return frame(s, d, "glossary").select("term_id", F.when(F.col("term").startswith("red"), F.col("term")).otherwise(t).alias("text"))


@query("t11_sentences", "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])[ \n\t]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS BIGINT) AS sentences FROM documents")
def t11(s, d):
    return frame(s, d, "documents").select("doc_id", F.size(C.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("t12_chunks")
def t12(s, d):
    return C.chunk(frame(s, d, "documents"), "doc_id", "text", 100)


@query("l11_overlapping_chunks")
def l11(s, d):
    return C.chunk(frame(s, d, "documents"), "doc_id", "text", 200, 0.1).groupBy("doc_id").agg(F.max("of").alias("chunks"))


@query("t13_truncate_tokens", "SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN n > 10 THEN array_to_string(t[1:5], ' ') || ' ... ' || array_to_string(t[n-4:n], ' ') ELSE array_to_string(t, ' ') END AS kept FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS t, len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS n FROM documents)")
def t13(s, d):
    t = TEXT.tokens(F.col("text"))
    return frame(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(C.truncate_middle(t, 10), " ").alias("kept"))


@query("t14_shorten", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS shown FROM documents")
def t14(s, d):
    return frame(s, d, "documents").select("doc_id", C.shorten(F.col("text"), 80).alias("shown"))


@query("t15_definition_lines", "SELECT doc_id, 'What is ' || regexp_extract(line, '(?:def|class) ([A-Za-z0-9_]+)', 1) || '?' AS question, trim(line) AS answer FROM lines WHERE regexp_matches(line, '^ *(def |class )')", MD, LINES)
def t15(s, d):
    lines = markdown(s, d).select("doc_id", F.explode(F.split("content", "\n")).alias("line")).filter(F.col("line").rlike("^ *(def |class )"))
    return lines.select("doc_id", F.concat(F.lit("What is "), F.regexp_extract("line", "(?:def|class) ([A-Za-z0-9_]+)", 1), F.lit("?")).alias("question"), F.trim("line").alias("answer"))


@query("t16_function_questions", """SELECT p_partkey, question, answer FROM (SELECT p_partkey, unnest(['What does the function ' || p_name || ' do?', 'Which parameters does ' || p_name || ' take?', 'How is ' || p_name || ' called?']) AS question,
  unnest([CASE WHEN p_size > 10 THEN p_type END, CASE WHEN p_brand <> '' THEN p_name || ' takes: ' || p_brand END, p_name || '(' || p_brand || ')']) AS answer FROM part) WHERE answer IS NOT NULL""")
def t16(s, d):
    pairs = C.function_questions(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 10, F.col("p_type")))
    return frame(s, d, "part").select("p_partkey", F.explode(pairs).alias("p")).select("p_partkey", "p.question", "p.answer")


_ABOUT = {  # what is known of a part, read as a function; the same in both dialects
    "doc": "CASE WHEN p_size > 10 THEN p_type END", "returns": "CASE WHEN p_size % 3 = 0 THEN concat('goods of ', p_brand) WHEN p_size % 3 = 1 THEN '' END", "size_note": "CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 20 THEN '' END",
    "error_note": "CASE WHEN p_size % 5 = 0 THEN 'no such goods' END", "source": "concat('def ', p_name, '(size, brand): ...')",
}


@query(
    "t16_all_templates",
    """SELECT p_partkey, question, answer FROM (SELECT p_partkey, unnest([
        {'question': 'What does the function `' || p_name || '(size, brand)` do?', 'answer': doc}, {'question': 'What are the parameters of `' || p_name || '`?', 'answer': CASE WHEN size_note <> '' THEN '- `size`: ' || size_note || chr(10) ELSE '' END || '- `brand`: ' || p_brand},
        {'question': 'What does `' || p_name || '` return?', 'answer': returns}, {'question': 'How do I use `' || p_name || '`? Show me an example.', 'answer': p_name || '(1)' || chr(10) || p_name || '(2)'},
        {'question': 'What errors can `' || p_name || '` raise?', 'answer': '- `ValueError`: ' || error_note}, {'question': 'Show me the implementation of `' || p_name || '`.', 'answer': source},
        {'question': 'What is the purpose of the `' || p_brand || '` class?', 'answer': doc}, {'question': 'Show me the implementation of the `' || p_brand || '` class.', 'answer': 'class ' || p_brand}], max_depth := 2)
        FROM (SELECT *, """ + ", ".join(f"{sql} AS {name}" for name, sql in _ABOUT.items()) + """ FROM part)) WHERE answer <> ''""",
)
def t16_all(s, d):
    """Parts read as functions, and their brands as classes: all eight templates."""
    p = frame(s, d, "part").withColumns({n: F.expr(sql) for n, sql in _ABOUT.items()})
    item = lambda key, name, note: F.struct(F.lit(name).alias(key), note.alias("description"))
    parameters = F.array(item("name", "size", F.col("size_note")), item("name", "brand", F.col("p_brand")))
    examples = F.array(*[F.concat("p_name", F.lit(f"({i})")) for i in (1, 2)])
    of_function = C.function_pairs(F.col("p_name"), F.lit("(size, brand)"), F.col("doc"), parameters, F.col("returns"), examples, F.array(item("type", "ValueError", F.col("error_note"))), F.col("source"))
    of_class = C.class_pairs(F.col("p_brand"), F.col("doc"), F.concat(F.lit("class "), "p_brand"))
    return p.select("p_partkey", F.explode(F.concat(of_function, of_class)).alias("p")).select("p_partkey", "p.question", "p.answer")


@query("t17_docstring_questions")
def t17(s, d):
    """Docstrings between equal quotes, found by a back-reference."""
    code = F.concat(F.lit('def f(x):\n    """'), "definition", F.lit(' part."""\n    return x'))
    body = F.regexp_extract(code, "(?s)def ([a-z]+)\\([^)]*\\):\\s*(\"\"\"|''')(.*?)\\2", 3)
    return frame(s, d, "glossary").select("term_id", F.concat(F.lit("What does "), "term", F.lit(" do?")).alias("question"), body.alias("answer"))


@query("t18_header_questions", "SELECT doc_id, 'What does the section ' || title || ' say?' AS question, md5(trim(body)) AS answer FROM sections WHERE level > 0 AND length(trim(body)) >= 10", MD, LINES, MARKED, PARTS, SECTIONS)
def t18(s, d):
    x = C.section_table(markdown(s, d), "doc_id", "content").filter((F.col("level") > 0) & (F.length(F.trim("body")) >= 10))
    return x.select("doc_id", F.concat(F.lit("What does the section "), "title", F.lit(" say?")).alias("question"), F.md5(F.trim("body")).alias("answer"))


DEPTH = "length({0}) - length(ltrim({0}, ' '))"
HEADS = ("heads", f"SELECT doc_id, pos, line, {DEPTH.format('line')} AS depth FROM lines WHERE regexp_matches(line, '^ *(def|class) +[A-Za-z_]')")
ENDS = ("ends", f"SELECT h.doc_id, h.pos, h.line, min(l.pos) AS stop FROM heads h LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.pos > h.pos AND trim(l.line) <> '' AND {DEPTH.format('l.line')} <= h.depth GROUP BY ALL")
SOURCES = ("sources", """SELECT e.doc_id, e.pos, regexp_extract(e.line, '(def|class) +([A-Za-z0-9_]+)', 2) AS name, regexp_extract(e.line, '(def|class)', 1) AS kind, string_agg(l.line, chr(10) ORDER BY l.pos) AS source
  FROM ends e JOIN lines l ON l.doc_id = e.doc_id AND l.pos >= e.pos AND (e.stop IS NULL OR l.pos < e.stop) GROUP BY e.doc_id, e.pos, e.line""")


def _definitions(s, d):
    return markdown(s, d).select("doc_id", F.explode(C.definitions(F.col("content"))).alias("f")).select("doc_id", "f.*")


@query("t19_function_source", "SELECT doc_id, name, kind, source FROM sources", MD, LINES, HEADS, ENDS, SOURCES)
def t19(s, d):
    """Every function and class of each text, nested ones too, with its own lines."""
    return _definitions(s, d).select("doc_id", "name", "kind", "source")


@query("t20_valid_pairs", "SELECT conv_id, count(*) AS n FROM (SELECT a.conv_id, a.text AS q, b.text AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant') WHERE length(trim(q)) >= 10 AND length(trim(a)) >= 15 GROUP BY conv_id")
def t20(s, d):
    return C.valid_pairs(_pairs(s, d)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _pairs(s, d):
    c = frame(s, d, "conversations")
    a = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])


@query("t21_json_pairs", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def t21(s, d):
    return frame(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).filter("k >= 50")


@query(
    "t21_pairs_from_prose",
    """SELECT conv_id, turn, question, answer FROM (SELECT a.conv_id, a.turn + 1 AS turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
       WHERE a.role = 'user' AND b.role = 'assistant') WHERE length(question) >= 10 AND length(answer) >= 10""",
)
def t21_prose(s, d):
    """Pairs out of what a model might have written about them: in a fence or in prose, cut off, with a
    comma too many, or with bare keys, by conversation."""
    p = _pairs(s, d).filter("question IS NOT NULL AND answer IS NOT NULL")
    whole = F.to_json(F.array(F.struct("question", "answer")))
    kind = F.pmod("conv_id", F.lit(5))
    text = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```\nAnything else?")))
        .when(kind == 1, F.concat(F.lit("The pairs are "), whole, F.lit(" as you asked.")))
        .when(kind == 2, F.concat(F.lit("Here: "), F.substring(whole, F.lit(1), F.length(whole) - 2)))
        .when(kind == 3, F.concat(F.substring(whole, F.lit(1), F.length(whole) - 2), F.lit(",},]")))
        .otherwise(F.replace(F.replace(whole, F.lit('{"question":'), F.lit("{question: ")), F.lit(',"answer":'), F.lit(",\n answer : ")))
    )
    found = p.select("conv_id", "turn", F.explode(question_answers_of(text)).alias("p"))
    return found.select("conv_id", "turn", "p.question", "p.answer")


@query("t22_reverse_quota", "SELECT conv_id, greatest(5, CAST(ceil(count(*) * 0.25) AS BIGINT)) AS quota FROM conversations GROUP BY conv_id")
def t22(s, d):
    return frame(s, d, "conversations").groupBy("conv_id").agg(F.greatest(F.lit(5), F.ceil(F.count(F.lit(1)) * 0.25)).cast("long").alias("quota"))


@query("d01_foreign_keys", """SELECT 'lineitem' AS collection, 'l_orderkey' AS field, 'orders' AS target, 'o_orderkey' AS target_field, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS missing FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_partkey', 'part', 'p_partkey', count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier', 's_suppkey', count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) FROM lineitem
  UNION ALL SELECT 'orders', 'o_custkey', 'customer', 'c_custkey', count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders
  UNION ALL SELECT 'customer', 'c_nationkey', 'nation', 'n_nationkey', count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM customer
  UNION ALL SELECT 'supplier', 's_nationkey', 'nation', 'n_nationkey', count(*) FILTER (s_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM supplier
  UNION ALL SELECT 'nation', 'n_regionkey', 'region', 'r_regionkey', count(*) FILTER (n_regionkey NOT IN (SELECT r_regionkey FROM region)) FROM nation""")
def d01(s, d):
    return K.verified_keys(s, {t: frame(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


@query("d02_edge_kinds", "SELECT src_collection, dst_collection, count(*) AS n FROM {property_edges} GROUP BY 1, 2")
def d02(s, d):
    return frame(s, d, "property_edges").groupBy("src_collection", "dst_collection").agg(F.count(F.lit(1)).alias("n"))


@query("d03_relations", "SELECT src_collection AS a, dst_collection AS b, 'edge' AS kind FROM {property_edges} WHERE src_collection <> 'orders' GROUP BY 1, 2 UNION ALL SELECT 'orders', 'customer', 'key'")
def d03(s, d):
    edges = frame(s, d, "property_edges").filter("src_collection <> 'orders'").select(F.col("src_collection").alias("a"), F.col("dst_collection").alias("b"), F.lit("edge").alias("kind")).distinct()
    keys = [(n, t, "key") for n, _, t, _ in K.foreign_keys({t: frame(s, d, t) for t in ("customer", "orders")})]
    return edges.unionByName(s.createDataFrame(keys, "a string, b string, kind string"))


@query("d04_schema_description")
def d04(s, d):
    t = K.schema_table(s, {t: frame(s, d, t) for t in TABLES})
    return t.groupBy("collection").agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.concat_ws(" ", "field", "type")))).alias("description"))


@query("d05_sparse_schema")
def d05(s, d):
    return K.schema_table(s, {t: frame(s, d, t) for t in TABLES}).select("collection", "field")


@query("d06_schema_versions", "SELECT event_type AS name, count(*) AS versions, max(ts) AS latest FROM events GROUP BY event_type")
def d06(s, d):
    return frame(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("versions"), F.max("ts").alias("latest"))


@query("d07_method_catalogue", "SELECT name, kind, count(*) AS found, min(doc_id) AS first_doc FROM sources GROUP BY name, kind", MD, LINES, HEADS, ENDS, SOURCES)
def d07(s, d):
    """The functions and classes that the corpus defines, by name."""
    return _definitions(s, d).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("found"), F.min("doc_id").alias("first_doc")).orderBy("name", "kind")


_CATS = ", ".join(f"CASE WHEN regexp_matches(lower(content), '{w}') THEN '{n}' END" for n, w in (("create", "create|insert|add|new|init"), ("read", "get|fetch|retrieve|find|search|list"), ("update", "update|modify|change|set"), ("delete", "delete|remove|clear"), ("bulk", "bulk|batch|many|multiple"), ("validation", "validate|check|verify|ensure"), ("utility", "format|convert|parse|helper"), ("error_handling", "raise|except|error|handle|idiot")))


@query("d08_categories", f"SELECT doc_id, array_to_string(list_filter([{_CATS}], lambda x: x IS NOT NULL), ',') AS categories FROM {{articles}}")
def d08(s, d):
    return frame(s, d, "articles").select("doc_id", F.array_join(K.categories_of(F.col("content"), F.lower("content").contains("idiot")), ",").alias("categories"))


@query("d09_summary", "SELECT doc_id, CASE WHEN length(f) > 100 THEN substring(f, 1, 97) || '...' ELSE f END AS summary FROM (SELECT doc_id, regexp_extract(text, '(?s)^([^.]*)', 1) || '.' AS f FROM documents)")
def d09(s, d):
    return frame(s, d, "documents").select("doc_id", K.summary_of(F.col("text")).alias("summary"))


@query("d10_relevance", "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 3 ELSE 0 END + CASE WHEN p_type = 'SMALL' THEN 2 ELSE 0 END + CASE WHEN p_name <> '' THEN 1 ELSE 0 END AS INTEGER) AS relevance FROM part")
def d10(s, d):
    return frame(s, d, "part").select("p_partkey", K.relevance(F.col("p_size") > 25, F.col("p_type") == "SMALL", F.col("p_name") != "").alias("relevance"))


@query("d11_docstring_parts")
def d11(s, d):
    doc = F.concat("term", F.lit(".\n\nArgs:\n    size (int): "), "definition", F.lit("\n\nReturns:\n    the "), "kind", F.lit("\n\nRaises:\n    ValueError: if none"))
    x = frame(s, d, "glossary").select("term_id", K.docstring_parts(doc).alias("p"))
    return x.select("term_id", F.array_join("p.parameters", ",").alias("parameters"), F.array_join("p.raises", ",").alias("raises"), F.col("p.returns").alias("returns"))


@query("d12_imports_and_calls")
def d12(s, d):
    code = markdown(s, d).select("doc_id", F.get(C.code_blocks(F.col("content")), F.lit(0))["content"].alias("code"))
    return code.lateralJoin(K.PythonNames(F.col("code").outer())).select("doc_id", "kind", "name", "line")


@query("d13_method_lookup", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') ORDER BY p_partkey LIMIT 3")
def d13(s, d):
    return frame(s, d, "part").filter(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("ring")).orderBy("p_partkey").limit(3).select("p_partkey", "p_name")


@query(
    "d13_method_exists",
    """SELECT a.name, k.entries IS NOT NULL AS exists, coalesce(entries, 0) AS entries, summary, coalesce(close, '') AS close FROM a LEFT JOIN k ON a.name = k.name
       LEFT JOIN (SELECT name, string_agg(other, '|' ORDER BY n DESC, other) AS close FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, other) AS r FROM shared) WHERE r <= 3 GROUP BY name) c ON a.name = c.name""",
    ("a", "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_name, ' no', CAST(p_size AS VARCHAR)) END AS name FROM part"),
    ("k", "SELECT p_name AS name, count(*) AS entries, min(p_type) AS summary FROM part GROUP BY p_name"),
    ("aw", "SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[\\pL\\pN]+')) AS word FROM a WHERE name NOT IN (SELECT name FROM k)"),
    ("kw", "SELECT DISTINCT name AS other, unnest(regexp_extract_all(lower(name), '[\\pL\\pN]+')) AS word FROM k"),
    ("shared", "SELECT name, other, count(*) AS n FROM aw JOIN kw USING (word) GROUP BY name, other"),
)
def d13_exists(s, d):
    """Whether methods, here names of parts, are in the catalogue, and what comes close to those that are not."""
    p = frame(s, d, "part")
    asked = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" no"), F.col("p_size").cast("string"))).alias("name"))
    return K.method_lookup(asked, "name", p, "p_name", "p_type").withColumn("close", F.array_join("close", "|"))


# Code of which each part gives a function, every third one a method of a class.
CODE_SQL = """SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN concat('class K', CAST(p_partkey AS VARCHAR(20)), ':', chr(10)) ELSE concat('if True:', chr(10)) END,
  '    def make_', CAST(p_partkey AS VARCHAR(20)), '(', CASE WHEN p_partkey % 3 = 0 THEN 'self, ' ELSE '' END, 'size: int, brand: str = ', chr(39), p_brand, chr(39), ', *more) -> bool:', chr(10),
  '        ', repeat(chr(34), 3), 'Makes ', p_name, '. Ships it.', chr(10), chr(10), '        Args:', chr(10), '            size: at most ', CAST(p_size AS VARCHAR(20)), chr(10), '            brand (str): who made it', chr(10), chr(10),
  '        Raises:', chr(10), '            KeyError: never', chr(10), chr(10), '        >>> make(', CAST(p_size AS VARCHAR(20)), ')', chr(10), '        ', repeat(chr(34), 3), chr(10),
  CASE WHEN p_size % 2 = 0 THEN concat('        if size > 3:', chr(10), '            raise ValueError(size)', chr(10)) ELSE '' END, '        return True', chr(10)) AS code FROM {part}"""
DEEP = """SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN concat('K', CAST(p_partkey AS VARCHAR), '.') ELSE '' END, 'make_', CAST(p_partkey AS VARCHAR)) AS name, concat('Makes ', p_name, '.') AS summary,
  concat('(', CASE WHEN p_partkey % 3 = 0 THEN 'self, ' ELSE '' END, 'size: int, brand: str=', chr(39), p_brand, chr(39), ', *more)') AS signature, 'bool' AS returns, concat('size:int::true:at most ', CAST(p_size AS VARCHAR), '|brand:str:', chr(39), p_brand, chr(39), ':false:who made it|more:::false:') AS parameters,
  CASE WHEN p_size % 2 = 0 THEN 'ValueError:|KeyError:never' ELSE 'KeyError:never' END AS errors, concat('make(', CAST(p_size AS VARCHAR), ')') AS examples FROM part"""


def _methods(s, d):
    return K.methods_of(s.sql(CODE_SQL, part=frame(s, d, "part")), "code").drop("code")


def _flat(found):
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    joined = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[part(x[n]) for n in names])), "|")
    return found.select("p_partkey", "name", "summary", "signature", "returns", joined("parameters", "name", "annotation", "default", "required", "description").alias("parameters"), joined("errors", "type", "description").alias("errors"), F.array_join("examples", "|").alias("examples"))


@query("d13_deep_analysis", "SELECT * FROM deep", ("deep", DEEP))
def d13_deep(s, d):
    """Every method of the corpus's code, analysed."""
    return _flat(K.analysed(_methods(s, d)))


@query("d13_relevant_methods", "SELECT * FROM deep WHERE contains(lower(summary), 'ring') ORDER BY name, p_partkey LIMIT 3", ("deep", DEEP))
def d13_relevant(s, d):
    """The first three methods whose summary speaks of rings, analysed."""
    return _flat(K.relevant_methods(_methods(s, d), "Ring", ["p_partkey"]))


@query(
    "d13_deep_lookup",
    "SELECT a.name, d.p_partkey IS NOT NULL AS found, summary, signature FROM (SELECT DISTINCT concat('K', CAST(p_partkey AS VARCHAR), '.make_', CAST(p_partkey AS VARCHAR)) AS name FROM part) a LEFT JOIN deep d ON a.name = d.name",
    ("deep", DEEP),
)
def d13_deep_lookup(s, d):
    """Methods looked up by dotted names, of which a third exist."""
    key = F.col("p_partkey").cast("string")
    asked = frame(s, d, "part").select(F.concat(F.lit("K"), key, F.lit(".make_"), key).alias("name"))
    return K.deep_lookup(asked, "name", _methods(s, d)).select("name", "found", "summary", "signature")


@query("z01_ratio")
def z01(s, d):
    return frame(s, d, "glossary").select("term_id", F.round(Z.ratio_column("term", F.lit("small ring")), 4).alias("ratio")).filter("ratio >= 60")


@query("z02_two_stage")
def z02(s, d):
    hits = R.top(index(s, d, "glossary").search({"term": 1.0}, ["small", "ring"]), "bm25", "term_id", 50).join(frame(s, d, "glossary"), "term_id")
    return hits.withColumn("score", F.round(Z.best_ratio_column("term", F.lit("ring small")) * 100, 4)).filter("score >= 80").select("term_id", "term", "score")


@query("z03_token_sort")
def z03(s, d):
    out = frame(s, d, "glossary").withColumn("score", Z.token_sort_ratio_column("term", F.lit("ring small"))).filter("score >= 80")
    return R.top(out, "score", "term_id", 20).select("term_id", "term", F.round("score", 4).alias("score"))


@query("z04_best_of_three")
def z04(s, d):
    return frame(s, d, "glossary").select("term_id", F.round(Z.best_ratio_column("term", F.lit("blue bolt")), 6).alias("score")).filter("score >= 0.7")


@query("z05_longest_match")
def z05(s, d):
    """For each distinct part name the longest glossary term that matches it nearly wholly.

    At a ratio of 97 fewer than 0.062 characters of a text's length differ, so at most as many words
    do: texts meet by one of their rarest words, one more than that. A text all of whose words may
    differ also meets by the empty word.
    """
    names = frame(s, d, "part").select(F.col("p_name").alias("question")).distinct()
    terms = frame(s, d, "glossary").select("term").distinct()
    words = lambda df, c: df.select(F.col(c).alias("text"), F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("word"))
    every = words(names, "question").unionByName(words(terms, "term"))
    counts = every.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))

    def rarest(df, c):
        may = F.floor(F.length("text") * 0.062) + 1
        w = words(df, c).join(counts, "word").withColumn("at", F.row_number().over(Window.partitionBy("text").orderBy("texts", "word")))
        few = df.select(F.col(c).alias("text"), F.lit("").alias("word")).filter(may > F.size(F.array_distinct(F.split(F.lower("text"), " "))))
        return w.filter(F.col("at") <= may).select("text", "word").unionByName(few).withColumnRenamed("text", c)

    near = rarest(names, "question").join(rarest(terms, "term"), "word").select("question", "term").distinct()
    near = near.filter(Z.token_sort_ratio_column("question", "term") >= 97)
    return near.groupBy("question").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))


@query("z06_distinct_pairs")
def z06(s, d):
    """Question-answer pairs, in the order of conversations and turns, without those whose question or
    whose answer has a partial ratio of 80 or more with that of a pair that stays."""
    p = _pairs(s, d).select(F.struct("conv_id", "turn").alias("k"), "question", "answer")
    return C.first_of_classes(p, "k", ["question", "answer"]).select("k.conv_id", "k.turn")


@query("z07_code_complete")
def z07(s, d):
    """Answers on a function, here the first sentence of its text, that lack its code get it appended."""
    about = frame(s, d, "documents").select("doc_id", K.summary_of(F.col("text")).alias("answer"))
    q = _definitions(s, d).filter("kind = 'def' AND name <> 'm'").select("doc_id", "name", "source", F.concat(F.lit("How does "), "name", F.lit(" work?")).alias("question"))
    return C.complete_answers(q.join(about, "doc_id"), "question", "answer", "name", "source").select("doc_id", "question", F.col("completed").alias("answer"))


def _fused_terms(s, d):
    g = spread(frame(s, d, "glossary")).join(index(s, d, "glossary").search({"term": 1.0, "definition": 0.5}, ["blue", "bolt"]), "term_id", "left")
    g = g.withColumn("similarity", cosine_of(embed(F.concat_ws(": ", "term", "definition")), embed(F.lit("search_query: blue bolt")))).withColumn("fuzzy", Z.best_ratio_column("term", F.lit("blue bolt"))).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return g.filter("fuzzy >= 0.6 OR similarity >= 0.3").withColumn("score", 0.5 * F.col("similarity") + 0.3 * F.col("fuzzy") + 0.2 * F.coalesce("bm25", F.lit(0.0)))


@query("r29_three_way_fusion")
def r29(s, d):
    return R.top(_fused_terms(s, d), "score", "term_id", 10).select("term_id", F.round("score", 6).alias("score"))


@query("r30_query_analysis")
def r30(s, d):
    """All searches for one question, one row for each term in order of kind and score."""
    exact = frame(s, d, "glossary").filter(F.exists(TEXT.tokens(F.col("term")), lambda t: t.isin("blue", "bolt"))).select("term_id", F.lit(0.9).alias("score"))
    return R.top(R.priority_union([(1, exact), (2, _fused_terms(s, d).select("term_id", "score"))], "term_id"), "score", "term_id", 25).select("term_id", "priority")


@query("text_en_stems")
def stems(s, d):
    """The stemming analyzer profile: most frequent stems."""
    words = frame(s, d, "documents").filter("lang = 'en'").select(F.explode(TEXT_EN.tokens(F.col("text"))).alias("stem"))
    return words.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stem").limit(50)


@query("text_edge_ngrams", "SELECT p_name, count(*) AS grams FROM (SELECT p_name, unnest(regexp_extract_all(p_name, '[\\pL\\pN]+')) AS t FROM (SELECT DISTINCT p_name FROM part)), generate_series(3, 6) AS g(n) WHERE n <= greatest(3, length(t)) GROUP BY p_name")
def ngrams(s, d):
    return frame(s, d, "part").select("p_name").distinct().select("p_name", F.size(edge_ngrams(TEXT.tokens(F.col("p_name")))).cast("long").alias("grams"))


@query("postings_table", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS term FROM documents) GROUP BY doc_id, term")
def postings(s, d):
    return R.postings(frame(s, d, "documents"), "doc_id", ["text"]).select("doc_id", "term", "tf")


QUERIES, ORACLES = Q, O
