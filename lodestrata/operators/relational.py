"""Joins, nested groupings, set operations and window-like selections of document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge in both directions, so that "either end" is an equi join."""
    turned = edges.select(*[F.col(dst).alias(src) if c == src else (F.col(src).alias(dst) if c == dst else F.col(c)) for c in edges.columns])
    return edges.unionByName(turned)


def nested(left: DataFrame, right: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """left with an array of right's rows for the key; empty, not null, where there are none.

    Meant for keys with few rows on the right: each array is one row's value.
    """
    many = right.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    kind = dict(many.dtypes)[name]
    return left.join(many, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def latest(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by the order, which has to be total."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def first_n(df: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def within_budget(df: DataFrame, key: str, order: list[Column], amount: str, budget: float) -> DataFrame:
    """Rows of each key until their running total exceeds the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(amount).over(w)).filter(F.col("running") <= budget)


def carry_forward(df: DataFrame, key: str | list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """The last value so far that is not null."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def distinct_ignoring_case(items: Column) -> Column:
    """An array without later repetitions, compared without regard to case, in order."""
    start = F.array().cast("array<string>")
    return F.aggregate(items, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def with_share(df: DataFrame, group: str | list[str], count: str = "n", share: str = "percent") -> DataFrame:
    """Rows by group and their percentage of all rows; the total is taken over the groups."""
    counted = df.groupBy(*([group] if isinstance(group, str) else group)).agg(F.count(F.lit(1)).alias(count))
    total = counted.agg(F.sum(count).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).withColumn(share, F.round(100.0 * F.col(count) / F.col("_total"), 2)).drop("_total")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it has fewer tasks, as a few small files have: for work that takes far
    longer than reading."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
