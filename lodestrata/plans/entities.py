"""Frames of the data model, derived from the base tables.

Each is one SQL text that Spark and DuckDB read alike, with {name} for a base table or another
entity. frame() gives the DataFrame, with_sql() the same as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators.text_index import LAYOUT, TextIndex, refresh
from lodestrata.operators.vector_index import VectorIndex, build_vector_index
from lodestrata.sources.kept import kept_root, table_state
from lodestrata.sources.scratch import made_once

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ENTITIES: dict[str, str] = {
    # One searchable document: its first line is the title.
    "articles": """
        SELECT doc_id, split_part(text, chr(10), 1) AS title, concat(lang, ' ', source) AS description, text AS content, lang, source
        FROM {documents}""",
    "glossary": """
        SELECT p_partkey AS term_id, p_name AS term, concat(p_brand, ' ', p_type) AS definition, p_brand AS category, p_type AS kind
        FROM {part}""",
    "facts": """
        SELECT d.doc_id AS fact_id, d.text AS content, d.lang AS lang, d.source AS source,
               CAST(CASE WHEN l.quality IS NULL THEN 0.5 WHEN l.quality = 1 THEN 0.8 ELSE 0.3 END AS DOUBLE) AS importance,
               CAST(CASE WHEN l.toxic IS NULL THEN 0.6 WHEN l.toxic = 1 THEN 0.2 ELSE 0.9 END AS DOUBLE) AS confidence,
               CASE WHEN l.quality = 0 THEN 'temporary' ELSE 'permanent' END AS tenure,
               CAST(d.doc_id % 13 AS BIGINT) AS access_count,
               CAST(30 + d.doc_id % 90 - 20 AS DOUBLE) AS ttl_days,
               CAST(d.doc_id % 4 AS BIGINT) AS n_alternatives,
               CAST(d.doc_id % 30 AS BIGINT) AS days_since
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Parts on neighbouring lines of an order.
    "associations": """
        SELECT src, dst, type, strength, created FROM (
          SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS src, l_partkey AS dst,
                 CASE l_returnflag WHEN 'A' THEN 'causes' WHEN 'N' THEN 'related' ELSE 'part_of' END AS type,
                 CAST(l_quantity / 50 AS DOUBLE) AS strength, CAST(l_shipdate AS DATE) AS created
          FROM {lineitem}) e
        WHERE src IS NOT NULL AND src <> dst""",
    "strong_edges": """
        SELECT src, dst, max(strength) AS strength FROM {associations} WHERE strength >= 0.99 GROUP BY src, dst""",
    # The property graph of the base tables: typed edges between (collection, key) vertices.
    "property_edges": """
        SELECT 'customer' AS src_collection, CAST(c_custkey AS VARCHAR(20)) AS src_key, 'nation' AS dst_collection, CAST(c_nationkey AS VARCHAR(20)) AS dst_key, 'lives_in' AS relationship_type FROM {customer}
        UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR(20)), 'nation', CAST(s_nationkey AS VARCHAR(20)), 'based_in' FROM {supplier}
        UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR(20)), 'region', CAST(n_regionkey AS VARCHAR(20)), 'part_of' FROM {nation}
        UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR(20)), 'customer', CAST(o_custkey AS VARCHAR(20)), 'placed_by' FROM {orders}""",
    # Runs of tests: a day's events of one type and user group are one test.
    "test_runs": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS run_id, concat(event_type, '_', CAST(user_id % 5 AS VARCHAR(2))) AS test_name,
               min(CASE WHEN event_type = 'error' AND value > 50 THEN 0 ELSE 1 END) AS passed, CAST(sum(value) AS DOUBLE) AS execution_time, count(*) AS n
        FROM {events} GROUP BY CAST(ts AS DATE), event_type, user_id % 5""",
    "chats": """
        SELECT conv_id, turn, role, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens
        FROM {conversations}""",
}


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or an entity as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ENTITIES[name]
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in dict.fromkeys(_needs(sql))})


# Searched fields by entity, the base table that they come from, and the key.
INDEXED = {"articles": ("documents", "doc_id", ["title", "description", "content"]), "glossary": ("part", "term_id", ["term", "definition"])}


def index(spark: SparkSession, sf_dir: str, name: str) -> TextIndex:
    """The kept text index of an entity: built at its first use by any session, and brought up to
    date when the table's files have changed."""
    table, key, fields = INDEXED[name]
    path = f"{sf_dir}/{table}.parquet"
    root = kept_root(spark, path, name, LAYOUT, *fields)
    return made_once(spark, path, f"index-{name}", lambda: refresh(frame(spark, sf_dir, name), root, key, fields, state=table_state(spark, path)))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The inverted lists of the embeddings, built at their first use."""
    return made_once(spark, f"{sf_dir}/embeddings.parquet", "vector-lists", lambda: build_vector_index(frame(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def with_sql(body: str, *more: tuple[str, str]) -> str:
    """body preceded by the entities it names in braces (and those in turn), and by further
    (name, sql) expressions, which may name entities too."""
    order: list[str] = []

    def add(sql: str) -> None:
        for n in _needs(sql):
            if n in ENTITIES and n not in order:
                add(ENTITIES[n])
                order.append(n)

    for _, sql in more:
        add(sql)
    add(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    parts = [f"{n} AS ({plain(ENTITIES[n])})" for n in order] + [f"{n} AS ({plain(sql)})" for n, sql in more]
    recursive = "RECURSIVE " if any("UNION ALL" in s and re.search(rf"\b{n}\b", s) for n, s in more) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + plain(body)
