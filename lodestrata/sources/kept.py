"""Tables that outlive a session: folders of versions in the shared folder, and a manifest that names
the version that counts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept_root(spark: SparkSession, *names: str) -> str:
    """A folder for what all applications share, under the one that spark.checkpoint.dir names; where
    that is unset, for a session on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-scratch")
    return f"{base.rstrip('/')}/lodestrata-kept/{hashlib.sha256('|'.join(names).encode()).hexdigest()[:32]}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_state(spark: SparkSession, path: str) -> str:
    """A digest of names, lengths and times of a table's files."""
    at, files = _files(spark, path)
    found, each = [], files.listFiles(at, True)
    while each.hasNext():
        f = each.next()
        found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def write_kept(df: DataFrame, root: str, name: str, **options: str) -> str:
    """Write a table under a new name in a kept folder; its path within that."""
    name = f"{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(f"{root}/{name}")
    return name


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the highest version, or None."""
    at, files = _files(spark, root)
    if not files.exists(at):
        return None
    versions = [int(m[1]) for f in files.listStatus(at) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))]
    if not versions:
        return None
    path, _ = _files(spark, f"{root}/manifest-{max(versions)}.json")
    stream = files.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"version": max(versions)}


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> dict:
    """Put a manifest in force: written aside, then renamed to the next version, which nobody has
    written yet; if another session was faster, its version counts, and this one's is dropped."""
    version = manifest.get("version", 0) + 1
    aside, files = _files(spark, f"{root}/.manifest-{uuid.uuid4().hex}")
    stream = files.create(aside)
    stream.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
    stream.close()
    target, _ = _files(spark, f"{root}/manifest-{version}.json")
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        return read_manifest(spark, root)
    return manifest | {"version": version}


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables in a kept folder."""
    at, files = _files(spark, root)
    return [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []


def drop_kept(spark: SparkSession, root: str, *names: str) -> None:
    """Delete tables of a kept folder; without names, the whole of it."""
    for path in [f"{root}/{n}" for n in names] or [root]:
        at, files = _files(spark, path)
        files.delete(at, True)
