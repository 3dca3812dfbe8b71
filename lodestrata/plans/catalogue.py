"""All registered queries over the operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import corpus_queries, graph_queries, memory_queries, relational_queries, retrieval_queries, service_queries, streaming_queries

FAMILIES = [retrieval_queries, relational_queries, graph_queries, memory_queries, corpus_queries, streaming_queries, service_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
for _name, (_same,) in memory_queries.ALIASES.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_same], ORACLES[_same]
FLAGSHIP = "r09_hybrid_two_arm"
