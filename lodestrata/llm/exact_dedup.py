"""Exact de-duplication by a content sort, with DataFrame operations only.

Rows are range-partitioned by splitters that Spark samples from (a prefix of the normalised
bytes, their hash, a salt); each partition is sorted externally by the whole normalised text,
so that equal texts lie next to each other, and a window compares whole neighbouring texts
and keeps the smallest identifier. The range key is of bounded length, so what the sampling
sends to the driver does not grow with the length of the texts.

A text whose hash occurs in more than rows / (4 x partitions) rows is salted by its row's
number, so that rows repeated under one identifier are spread as well. At most 4 x partitions
hashes can be that frequent, which bounds the broadcast table of them. Salted runs are merged
through that bounded table afterwards. Rows are numbered as they are read: a task that runs again
has to read the same rows in the same order, as from files or a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, shuffle_partitions, stored, unpack, whole_row

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, partitions: int | None, prefix: int, keep_rows: bool) -> DataFrame:
    """One row for each document (with keep_rows: for each first of a run), with its run's
    smallest identifier and size; runs of one text are whole unless the text is salted."""
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    norm = F.regexp_replace(F.coalesce(col(text_col).cast("string"), F.lit("")), WHITE_SPACE, " ")
    number = F.monotonically_increasing_id().alias("number")
    base = docs.select(col(id_col).alias("id"), norm.alias("norm"), number, *([whole_row(docs).alias("row")] if keep_rows else []))
    base = base.withColumn("h", F.xxhash64("norm"))
    per_task = max(1, -(-docs.count() // (4 * n)))
    hot = base.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > per_task)
    salts = F.ceil(F.col("copies") / per_task).cast("long")
    base = base.join(F.broadcast(hot), "h", "left").withColumn(
        "salt", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("number"), salts)).cast("long")
    )
    key = [F.substring("norm", 1, prefix).alias("prefix"), "h", "salt"]
    ranged = base.select("*", key[0]).repartitionByRange(n, "prefix", "h", "salt")
    run = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(F.col("id").asc_nulls_last(), "number")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranged.select(
        "id",
        "h",
        F.col("copies").isNotNull().alias("hot"),
        F.sha2("norm", 256).alias("sha"),
        "number",
        F.row_number().over(run).alias("nth"),
        F.first(F.struct(F.col("id").isNull().alias("none"), "id", "number")).over(whole).alias("keep"),
        F.count(F.lit(1)).over(whole).alias("size"),
        *(["row"] if keep_rows else []),
    )
    return out.filter("nth = 1") if keep_rows else out


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of salted texts put together."""
    hot = runs.filter("hot AND nth = 1").groupBy("h", "sha").agg(F.min("keep").alias("all_keep"), F.sum("size").alias("all_size"))
    out = runs.join(F.broadcast(hot), ["h", "sha"], "left")
    keep = F.coalesce("all_keep", "keep")
    return out.withColumns(
        {"keep_id": keep["id"], "group_size": F.coalesce("all_size", "size").cast("long"), "kept": F.col("number") == keep["number"]}
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, prefix: int = 48) -> DataFrame:
    """For each row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; a null
    text counts as empty. The smallest identifier of a group stays; null identifiers come
    last, and of rows with the same text and identifier exactly one is kept. Texts of any
    length are compared whole. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    runs = stored(_sorted_runs(docs, id_col, text_col, partitions, prefix, False), "content-sort")
    return _merged(runs).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, prefix: int = 48) -> DataFrame:
    """The rows that mark_copies() keeps, with all their columns."""
    runs = stored(_sorted_runs(docs, id_col, text_col, partitions, prefix, True), "content-sort")
    return _merged(runs).filter("kept").select(*unpack("row", docs.columns))
