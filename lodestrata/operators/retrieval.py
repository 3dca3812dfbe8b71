"""Ranked retrieval: BM25, vector similarity, score fusion, relaxation and term spotting.

Scores are columns; a ranking is an orderBy with a limit, which Spark runs as one top-k without
a full sort. Corpus statistics are one row, so the only broadcast here is of one row or of a
query's own terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT, Analyzer
from lodestrata.functions.vectors import cosine

K1, B = 1.2, 0.75


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def postings(df: DataFrame, key: str, fields: list[str], analyzer: Analyzer = TEXT) -> DataFrame:
    """key, field, term, tf: the inverted index as a table."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), analyzer.tokens(F.col(f)).alias("tokens")) for f in fields])
    long = df.select(key, F.explode(parts).alias("p")).select(key, F.col("p.field").alias("field"), F.explode("p.tokens").alias("term"))
    return long.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_of(parts: list[tuple[Column, Column, Column, Column, float]], rows: Column, k1: float, b: float) -> Column:
    """Sum over (term frequency, length, mean length, document frequency, boost), in their order."""

    def one(tf: Column, length: Column, mean: Column, df: Column, boost: float) -> Column:
        idf = F.ln(1 + (rows - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))) * boost).otherwise(F.lit(0.0))

    return total([one(*p) for p in parts])


def bm25(df: DataFrame, fields: dict[str, float], query: list[str], analyzer: Analyzer = TEXT, k1: float = K1, b: float = B) -> DataFrame:
    """df with a column bm25: boosted sum over fields and query tokens; zero without a match. For a
    frame that is searched once; text_index has the form for many searches.

    A row's length and term frequencies are expressions over its tokens, so nothing is
    exploded or shuffled; document frequencies and mean lengths are one aggregate.
    """
    names = list(fields)
    t = df.select("*", *[analyzer.tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(names)])
    tf = lambda i, q: F.size(F.filter(f"_t{i}", lambda x: x == q)).cast("double")
    cells = [(i, j, f"_f{i}_{j}") for i in range(len(names)) for j in range(len(query))]
    t = t.select(
        *df.columns, *[F.size(f"_t{i}").cast("double").alias(f"_l{i}") for i in range(len(names))], *[tf(i, query[j]).alias(c) for i, j, c in cells]
    )
    stats = t.agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(f"_l{i}").alias(f"_a{i}") for i in range(len(names))],
        *[F.count_if(F.col(c) > 0).cast("double").alias(f"_d{c}") for _, _, c in cells],
    )
    scored = t.crossJoin(F.broadcast(stats))  # one row

    parts = [(F.col(c), F.col(f"_l{i}"), F.col(f"_a{i}"), F.col(f"_d{c}"), fields[names[i]]) for i, _, c in cells]
    return scored.select(*df.columns, bm25_of(parts, F.col("_n"), k1, b).alias("bm25"))


def similar_to(df: DataFrame, target: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with a column similarity: cosine with the vector of target, a frame of one row."""
    one = target.select(F.col(vector).alias("_q")).limit(1)
    return df.crossJoin(F.broadcast(one)).withColumn("similarity", cosine(F.col(vector), F.col("_q"))).drop("_q")


def top(df: DataFrame, score: str, key: str | list[str], k: int) -> DataFrame:
    """The k rows with the largest scores, ties by key."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(F.desc(score), *keys).limit(k)


def fuse(arms: dict[str, DataFrame], key: str | list[str], weights: dict[str, float], threshold: float | None, k: int | None) -> DataFrame:
    """Weighted sum of arms. Each arm has the key and a column `score`; a missing score counts zero.

    Arms are united and grouped by key once, instead of joined one by one.
    """
    keys = [key] if isinstance(key, str) else key
    tagged = [
        a.select(*keys, *[(F.col("score") if n == m else F.lit(0.0)).cast("double").alias(m) for m in arms]) for n, a in arms.items()
    ]
    united = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.max(m).alias(m) for m in arms])
    out = united.withColumn("hybrid", total([F.lit(weights[m]) * F.col(m) for m in arms]))
    if threshold is not None:
        out = out.filter(F.col("hybrid") >= threshold)
    return top(out, "hybrid", keys, k) if k else out


def relax(df: DataFrame, levels: list[Column]) -> DataFrame:
    """Rows of the first level that has any; the level is added. One pass, no loop on the driver."""
    level = F.lit(None).cast("int")
    for i in range(len(levels) - 1, -1, -1):
        level = F.when(levels[i], F.lit(i + 1)).otherwise(level)
    marked = df.withColumn("level", level).filter("level IS NOT NULL")
    first = marked.agg(F.min("level").alias("_first"))
    return marked.crossJoin(F.broadcast(first)).filter(F.col("level") == F.col("_first")).drop("_first")


def contains_phrase(text: Column, phrase: Column | str, analyzer: Analyzer = TEXT) -> Column:
    """Whether the tokens of the phrase follow each other in the text."""
    words = phrase if isinstance(phrase, Column) else F.lit(phrase)
    wrap = lambda c: F.concat(F.lit(" "), F.array_join(analyzer.tokens(c), " "), F.lit(" "))
    return wrap(text).contains(wrap(words))


def mentions(text: Column, term: Column) -> Column:
    """Whole-word containment, without regard to case, in terms of ASCII letters and digits."""
    return contains_phrase(text, term)


def keyword_score(term: Column, words: list[str]) -> Column:
    """Share of the words longer than three letters that equal the term's tokens or are a prefix
    either way."""
    long = [w for w in words if len(w) > 3]
    if not long:
        return F.lit(0.0)
    hit = lambda w: F.exists(TEXT.tokens(term), lambda t: t.startswith(w) | F.startswith(F.lit(w), t))
    return total([F.when(hit(w), 1.0).otherwise(0.0) for w in long]) / len(long)


def overlap_share(terms: Column, words: list[str]) -> Column:
    """Matched terms over the number of query words."""
    return F.size(F.array_intersect(terms, F.array(*[F.lit(w) for w in words]))) / F.lit(float(max(1, len(words))))


def domain_keyword_score(tokens: list[str], domains: Column, preserved: list[str] | None = None) -> Column:
    """Pairs of token and domain where one contains the other, over tokens, .95 at most, plus a
    half if a preserved domain is among them."""
    pair = lambda t: F.size(F.filter(domains, lambda d: F.lower(d).contains(t) | F.contains(F.lit(t), F.lower(d))))
    share = F.least(total([pair(t).cast("double") for t in tokens]) / len(tokens), F.lit(0.95))
    kept = F.arrays_overlap(domains, F.array(*[F.lit(p) for p in preserved])) if preserved else F.lit(False)
    return share + F.when(kept, 0.5).otherwise(0.0)


def priority_union(frames: list[tuple[int, DataFrame]], key: str, score: str = "score") -> DataFrame:
    """One row for each key: of the frame with the smallest priority number, then best score."""
    every = reduce(DataFrame.unionByName, [f.withColumn("priority", F.lit(p)) for p, f in frames])
    first = Window.partitionBy(key).orderBy("priority", F.desc(score))
    return every.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def related(terms: DataFrame, matched: DataFrame, key: str, links: str) -> DataFrame:
    """Terms that matched ones link to by name, without those matched themselves. links: an array
    column; names compare without regard to case."""
    names = matched.select(F.explode(links).alias("_name")).select(F.lower("_name").alias("_name")).distinct()
    return terms.join(names, F.lower(terms[key]) == names["_name"], "left_semi").join(matched.select(key), key, "left_anti")
