"""Small helpers that the operators share: quoting, shared scratch tables, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.scratch import clear_scratch, scratch_root, stored, temporary_tables  # noqa: F401


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[col(c) for c in df.columns])


def unpack(row: str, columns: list[str]) -> list[Column]:
    """The columns of a struct made by whole_row, under their old names."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows, and so with long texts the memory, of what one Arrow batch brings to Python.

    Only ever lowers the session's setting, which Spark reads when it plans a query.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def schema_with(source: DataFrame, carried: list[str], more: str) -> T.StructType:
    """Carried columns as they are in source, then further ones by DDL; field names may be any."""
    return T.StructType([T.StructField(c, source.schema[c].dataType) for c in carried] + T.StructType.fromDDL(more).fields)
