"""Vector expressions over arrays of numbers, all in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or of length zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def cosine_of(a: Column, b: Column) -> Column:
    """cosine() of vectors that are long expressions themselves, each computed once."""
    return _with(a, lambda x: _with(b, lambda y: cosine(x, y)))


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def statistics(a: Column) -> Column:
    """Smallest, largest, mean, population standard deviation and norm, as a struct."""
    x = a.cast("array<double>")
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n - mean * mean)
    return F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high"), mean.alias("mean"), spread.alias("std"), norm(a).alias("norm"))


def is_valid(a: Column, dimension: int) -> Column:
    """Not null, of the right length, and without null entries."""
    return F.coalesce((F.size(a) == dimension) & F.forall(a, lambda v: v.isNotNull()), F.lit(False))


def with_prefix(text: Column) -> Column:
    """The text as a document to embed, unless it says already what it is."""
    return F.when(text.startswith("search_query:") | text.startswith("search_document:"), text).otherwise(F.concat(F.lit("search_document: "), text))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_words(text: Column, dimension: int = 64) -> Column:
    """A unit vector of signed word counts: a word's place and sign come from its MD5. The prefix that
    tells documents from queries is left out; a text without words gives the zero vector."""
    words = TEXT.tokens(F.regexp_replace(text, "^search_(query|document): ?", ""))
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % (2 * dimension))

    def counts(p: Column) -> Column:
        count = lambda v: F.size(F.filter(p, lambda x: x == v))
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (count(2 * i) - count(2 * i + 1)).cast("double"))

    unit = lambda raw: _with(F.greatest(norm(raw), F.lit(1e-12)), lambda n: F.transform(raw, lambda x: x / n))
    return _with(_with(places, counts), unit)


def embed(text: Column, model: Callable[[Column], Column] = hashed_words) -> Column:
    """The vector of a text by any model that maps a text column to an array column, as a pandas UDF
    over a trained one does; the default needs no training. A null text counts as empty."""
    return model(with_prefix(F.coalesce(text, F.lit(""))))
