"""Secret scan with corpus-wide ownership frequency, with DataFrame operations only.

Base spans come from three fixed patterns. The method adds spans: long tokens of mixed kinds
of characters whose hash occurs with few distinct owners and repositories in the whole corpus
and which look live. Values copied by many owners are taken
for examples and are not added. Base spans are told apart in the same way, and all kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, stored

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
# Candidates of the method: whole runs of token characters.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
# Parts of words that mark placeholders.
PLACEHOLDERS = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|your_|test_?key|0123456789|abcdefgh|12345678"

SPAN = "struct<start:int,k:int,stop:int,value:string>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """For each match and for what follows the last one: length of the text before it since the match
    before, its own length and the value of the group. Only texts that match are split."""
    re = F.lit(pattern)
    found = F.regexp_extract_all(text, re, F.lit(0))
    values = F.regexp_extract_all(text, re, F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("f"), values.alias("v"))
    each = F.transform(zipped, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.coalesce(F.length(x["f"]), F.lit(0)).alias("size"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), each)


def _placed(rows: DataFrame) -> DataFrame:
    """row, owner, repository, k, start, stop, value of every match, by one running sum over each row's
    lengths: work goes with the matches, however many a text has."""
    parts = [rows.select("row", "owner", "repository", F.lit(k).alias("k"), F.posexplode(f"m{k}").alias("i", "m")) for k in range(len(KINDS))]
    each = reduce(DataFrame.unionByName, parts).select("row", "owner", "repository", "k", "i", "m.*")
    upto = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    least = F.element_at(F.array(*[F.lit(n) for n in (MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN)]), F.col("k") + 1)
    placed = each.select("row", "owner", "repository", "k", (stop - F.col("size")).alias("start"), stop.alias("stop"), "value")
    return placed.filter(F.length("value") >= least)


def _apart(placed: DataFrame) -> DataFrame:
    """placed without tokens that do not look live or that overlap a base span of their row."""
    order = Window.partitionBy("row").orderBy("start", "k", "stop")
    base = F.col("k") < 3
    before = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("k"), F.desc("stop"))  # a frame that ends at the end costs the square
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.select("*", before.alias("before"), after.alias("after"))
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))
    v = F.col("value")
    kinds = v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int")
    live = v.rlike("[0-9]") & (kinds >= 1) & (F.size(F.array_distinct(F.split(v, ""))) >= 10) & ~v.rlike(PLACEHOLDERS)
    return marked.filter(base | (clear & live)).drop("before", "after")


def _least(pattern: str, n: int) -> str:
    """A run of one class of characters, n at least: the same matches as runs of any length, filtered."""
    return pattern[:-1] + "{%d,}" % n


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["k"]], s["start"], s["stop"])), ",")


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    max_owners: int = 1,
    max_repositories: int = 2,
) -> DataFrame:
    """For each row: id, base (array of spans), owned (array of spans), owner_specific and
    widely_copied (numbers of base spans by how far their value is spread).

    A span is (start, k, stop, value), places in code points, stop exclusive, k an index into
    KINDS. base holds every match of the three base patterns and is never thinned. owned holds
    further tokens that lie outside all base spans, look live (at least two kinds of characters
    with digits among them, ten distinct ones, no placeholder word) and occur with at most
    max_owners distinct owners and max_repositories repositories; base spans whose value does so
    are owner-specific, the others widely copied. A null owner or repository
    counts as one of its own; a column that the table lacks counts as null. A null or empty
    text has no spans. Repeated rows are separate rows. An empty table gives an empty result.
    """
    part = lambda c: F.coalesce(col(c).cast("string"), F.lit("\u0000")) if c in docs.columns else F.lit("\u0000")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).alias("id"), text.alias("text"), part(owner_col).alias("owner"), F.concat_ws("\u0001", *[part(c) for c in repository_cols]).alias("repository")
    )
    patterns = ((ASSIGN, 2), (_least(ACCESS, MIN_ACCESS - 4), 0), (_least(HEX, MIN_HEX), 0), (TOKEN, 0))
    matches = [_matches(F.col("text"), p, g).alias(f"m{k}") for k, (p, g) in enumerate(patterns)]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", *matches)
    rows = stored(rows, "secret-candidates")
    spans = stored(_apart(_placed(rows)), "secret-spans")
    span = F.struct("start", "k", "stop", "value").cast(SPAN).alias("s")
    every = spans.select("row", "owner", "repository", span, F.sha2("value", 256).alias("hash"))
    seen = every.select("hash", "owner", "repository").distinct()
    spread = (
        seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = every.join(spread.select("hash", few.alias("few")), "hash")
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("s"))))
    of_base = lambda which: F.count_if((F.col("s.k") < 3) & which)
    per_row = judged.groupBy("row").agg(
        listed(F.col("s.k") < 3).alias("base"), listed((F.col("s.k") == 3) & F.col("few")).alias("owned"),
        of_base(F.col("few")).alias("owner_specific"), of_base(~F.col("few")).alias("widely_copied"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")
    has_any = F.coalesce(*[F.col(f"m{k}.gap") for k in range(len(KINDS))]).isNotNull()
    without = rows.filter(~has_any).select("id", none.alias("base"), none.alias("owned"), zero.alias("owner_specific"), zero.alias("widely_copied"))
    found = rows.filter(has_any).select("row", "id").join(per_row, "row", "left").select(
        "id", *[F.coalesce(c, d).alias(c) for c, d in (("base", none), ("owned", none), ("owner_specific", zero), ("widely_copied", zero))]
    )
    return without.unionByName(found).withColumnRenamed("id", id_col)


def span_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans, one row for each of find_secrets()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        "owner_specific",
        "widely_copied",
    )
