"""File sources: rules in markdown, JSON glossaries and scenarios, CSV and line-based error
lists, repositories, saved queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)


def rules(spark: SparkSession, path: str, pattern: str = "*.mdc") -> DataFrame:
    """rule_number, title, description, content of markdown rule files: the number is the file's stem
    up to the first hyphen, front matter between --- lines is dropped, the title is the first line
    without "# ", the description what follows up to the next "## "."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    rows = raw.select(F.split(_stem(), "-")[0].alias("rule_number"), F.btrim(body, F.lit(" \n\t\r")).alias("content"))
    title = F.regexp_replace(F.regexp_extract("content", r"\A([^\n]*)", 1), "^#+ *", "")
    about = F.btrim(F.regexp_extract("content", r"(?s)\A[^\n]*\n(.*?)(?:\n## |\z)", 1), F.lit(" \n\t"))
    return rows.select("rule_number", title.alias("title"), about.alias("description"), "content")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON array; entries without a term or definition are skipped."""
    schema = "term string, definition string, category string, source string, related_terms array<string>, examples array<string>, aliases array<string>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.filter("term IS NOT NULL AND term <> '' AND definition IS NOT NULL AND definition <> ''")


SCENARIO_FIELDS = ("title", "description", "query_example", "expected_result_format")


def scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenarios of a JSON array that have all required fields, and those that lack some, with the
    names of what is missing."""
    schema = ", ".join(f"{f} string" for f in SCENARIO_FIELDS) + ", category string, priority long, tags array<string>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f) == ""), f) for f in SCENARIO_FIELDS]))
    df = df.withColumn("missing", missing)
    return df.filter(F.size("missing") == 0).drop("missing"), df.filter(F.size("missing") > 0)


def error_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """name, code, description, category of a CSV list with # comments; a row needs a numeric code."""
    df = spark.read.schema("name string, code string, description string, category string").csv(path, comment="#", ignoreLeadingWhiteSpace=True)
    return df.withColumn("code", F.expr("try_cast(code AS BIGINT)")).filter("code IS NOT NULL")


def error_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """The same from whole files of lines, where a ## line names the category of the lines after it
    and other # lines are comments. text: one row for each file."""
    lines = text.select(F.monotonically_increasing_id().alias("file"), F.split(column, "\n").alias("lines")).select("file", F.posexplode("lines").alias("pos", "line"))
    so_far = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("category", F.last(F.when(F.col("line").rlike("^## *[^ #]"), F.trim(F.regexp_replace("line", "^## *", ""))), ignorenulls=True).over(so_far))
    parts = F.split("line", ",", 3)
    rows = named.filter(~F.col("line").startswith("#")).select(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).try_cast("long").alias("code"), F.regexp_replace(F.trim(F.get(parts, F.lit(2))), '^"|"$', "").alias("description"), F.coalesce("category", F.lit("General")).alias("category"))
    return rows.filter("code IS NOT NULL")


def repository(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), include: str | None = None, ignore: str | None = None, most: int | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content of a tree of text files, by extension and a glob of file names, without paths
    that a pattern is found in or that one of the globs to leave out fits; the first `most` by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", include) if include else reader
    df = reader.load(path)
    if extensions:
        df = df.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".").lower() for e in extensions]))
    if ignore:
        df = df.filter(~F.col("path").rlike(ignore))
    for glob in exclude:
        df = df.filter(~F.col("path").rlike("^" + ".*".join(re.escape(x) for x in glob.split("*")) + "$"))
    df = df.select("path", F.decode("content", "UTF-8").alias("content"))
    return df.orderBy("path").limit(most) if most else df


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return repository(spark, path, ("md", "markdown"))


def saved_queries(spark: SparkSession, path: str, include: str = "*.sql") -> DataFrame:
    """name, text of query files."""
    raw = spark.read.option("pathGlobFilter", include).text(path, wholetext=True)
    return raw.select(_stem().alias("name"), F.btrim("value", F.lit(" \n\t\r")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A graph dump: one JSON object a line."""
    return spark.read.schema(schema).json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """Question and answer pairs as JSON lines for training."""
    df.select(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output")).write.mode("overwrite").json(path)
