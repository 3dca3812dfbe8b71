"""The registered queries over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.conversations import repair_report
from lodestrata.llm.decontaminate import find_overlap, overlap_report
from lodestrata.llm.exact_dedup import mark_copies
from lodestrata.llm.html import extract_text
from lodestrata.llm.language import identify_languages
from lodestrata.llm.lm import score_texts
from lodestrata.llm.packing import pack
from lodestrata.llm.periodic import collapse_runs
from lodestrata.llm.quality import classify
from lodestrata.llm.secrets import find_secrets, span_report
from lodestrata.llm.sharding import kd_shards
from lodestrata.llm.simhash import near_duplicates
from lodestrata.llm.urls import Rule, filter_urls, url_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    """The vocabulary file of the packing contract, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The packing digest: each piece with a checksum of its ids in place of them."""
    return pack(docs, word_bpe_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return packed_pieces(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's judgement of every document."""
    return classify(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score_texts(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of equal text that stays."""
    return mark_copies(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark, and its longest verbatim match."""
    return overlap_report(find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=True))


# The rules of the URL contract.
URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled through the document that the last number of its path names."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    number = F.regexp_extract(url_path(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    numbered = pages.select("page_id", "url", number.alias("number"))
    numbered = numbered.select("page_id", "url", F.when(F.col("number") != "", F.col("number").cast("long")).alias("doc_id"))
    return filter_urls(numbered.join(labels, "doc_id", "left"), URL_RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of every document, by the law of equal bytes."""
    return kd_shards(_table(spark, sf_dir, "documents"), 40).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every document."""
    return span_report(find_secrets(_table(spark, sf_dir, "documents")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identify_languages(_table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The run contract's damage: where h = crc32(doc_id) ends in 0, words from the place g mod n on
    repeat with period 1 + (n - g mod n) div (3 + g mod 8), for g = h div 10. A null identifier damages nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        kept, period = F.slice(w, F.lit(1), a), F.slice(w, a + 1, p)
        return F.array_join(F.slice(F.concat(kept, F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))), F.lit(1), n), " ")

    # Through an array of one, so that the words are split once, not wherever they are named.
    hurt = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.col("text"))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, hurt).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some with runs planted, and digests of them and of what is left."""
    found = collapse_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    best = F.try_element_at(order, F.lit(1))
    length = -best["l"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged_turns(turns: DataFrame) -> DataFrame:
    """The repair contract's damage, by crc32(`conv_id:turn`) mod 20; a null is one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_copies").alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, some of whose turns were damaged."""
    turns = _table(spark, sf_dir, "conversations")
    return repair_report(damaged_turns(turns), turns.select("conv_id"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.k, g.n, v.item FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
places AS (SELECT item, n, unnest(range(1, len(w) - n + 2)) AS ia, w FROM sized),
met AS (SELECT g.doc_id, g.k, g.n, p.item, p.ia FROM (SELECT doc_id, n, k, gram FROM grams) g JOIN (SELECT item, n, ia, array_to_string(w[ia:ia + n - 1], ' ') AS gram FROM places) p ON g.n = p.n AND g.gram = p.gram),
runs AS (SELECT doc_id, item, min(k) - 1 AS word, min(ia) - 1 AS item_word, count(*) + n - 1 AS words FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item, n, k - ia ORDER BY k) AS r FROM met) GROUP BY doc_id, item, n, k - ia, r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, word, item, item_word) AS r FROM runs) WHERE r = 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  b.words AS longest_words, b.item AS longest_item, b.item_word AS longest_item_word, b.word AS longest_word
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN best b USING (doc_id)
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_secrets": op10_secrets,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_decontamination": OP6_SQL}
