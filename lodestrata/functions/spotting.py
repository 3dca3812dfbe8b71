"""Many terms in whole columns of texts: one pass of an automaton over each text.

The dictionary is a table in the shared folder, cut by a hash of the term into shards of bounded
size. A worker builds a shard's automaton once and keeps it for all batches that it gets; texts
pass the shards one after the other, so memory is that of one shard however many terms there are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT, Analyzer

#: Terms of one shard, at most about.
SHARD = 200_000


@functools.lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(f" {t} ", t)
    found.make_automaton()
    return found


def occurrences(line: str, terms: tuple[str, ...]) -> dict[str, int]:
    """How often each term occurs in tokens joined by single spaces; overlaps count."""
    if not terms:
        return {}
    out: dict[str, int] = {}
    for _, t in _automaton(terms).iter(f" {line} "):
        out[t] = out.get(t, 0) + 1
    return out


def spot_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, term: str, analyzer: Analyzer = TEXT, shard: int = SHARD) -> DataFrame:
    """keys, term (its tokens joined by spaces), times: each term in each text that has it.

    A term is found as whole words, by the analyzer's tokens; terms with the same tokens are one, and
    such without tokens, and null texts, are found nowhere. Terms may overlap and contain each other.
    """
    spark = texts.sparkSession
    line = lambda c: F.array_join(analyzer.tokens(F.col(c)), " ")
    known = terms.select(line(term).alias("term")).filter("term <> ''").distinct()
    shards = max(1, -(-known.count() // shard))
    rows = texts.select(*keys, line(text).alias("_line")).filter("_line <> ''")
    schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k != "_line") + ", term string, times bigint"
    out = None
    for i in range(shards):
        own = known if shards == 1 else known.filter(F.pmod(F.xxhash64("term"), F.lit(shards)) == i)
        dictionary = spark.sparkContext.broadcast(tuple(sorted(r["term"] for r in own.collect())))  # one shard: of bounded size

        def run(batches: Iterator[pa.RecordBatch], dictionary=dictionary) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found, times = [], [], []
                for row, x in enumerate(batch.column("_line").to_pylist()):
                    for t, n in occurrences(x, dictionary.value).items():
                        at.append(row)
                        found.append(t)
                        times.append(n)
                own = batch.select(keys).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string()), pa.array(times, pa.int64())], names=[*keys, "term", "times"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def longest_by_root(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, root, longest, n: terms of a text grouped by their first word, the longest of each."""
    root = F.substring_index("term", " ", 1)
    return found.groupBy(*keys, root.alias("root")).agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("longest"), F.count(F.lit(1)).alias("n"))
