"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under the shared one that spark.checkpoint.dir names.

    Where that is unset, a session on one machine, as in tests, has a temporary folder; on a
    cluster, whose machines do not share such a folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-scratch")
    return f"{base.rstrip('/')}/lodestrata-{spark.sparkContext.applicationId}"


#: Spark's setting that removes a query's shuffle files at its end, where the version has it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def stored(df: DataFrame, name: str, keep: bool = False, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    Cuts lineage in a way that outlives any executor. Shuffle files of the write go with its end,
    as nothing reads them again. The table stays until clear_scratch(), or, within
    temporary_tables() and without keep, until that ends. by: columns whose values are folders.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with unshuffled(spark):
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    within = _temporary.get()
    if within is not None and not keep:
        within.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go with the end of each write."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what stored() wrote within, but for tables that were to be kept."""
    mine: list[str] = []
    token = _temporary.set(mine)
    try:
        yield
    finally:
        _temporary.reset(token)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_made: dict[tuple, object] = {}


def made_once(spark: SparkSession, table: str, name: str, make: Callable[[], object]) -> object:
    """make(), a thing built of the table at a path, once for each application and state of the
    table's files; built again when they have changed, or after clear_scratch()."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (files.getFileStatus(at).getModificationTime(), files.getContentSummary(at).getLength())
    key = (spark.sparkContext.applicationId, table, name)
    if key not in _made or _made[key][0] != state:
        _made[key] = (state, make())
    return _made[key][1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them become unreadable."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
    _delete(spark, scratch_root(spark))
