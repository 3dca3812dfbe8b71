"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits that differ in at most d bits agree wholly on BLOCKS - d of BLOCKS
blocks at least, so each distinct fingerprint is filed once under every choice of so many
blocks (20 choices of three blocks in six, for three bits: about 32 bits of key). Members of a
bucket are compared by Hamming distance and linked by a spanning forest of verified links, one
link less than members at most, instead of all pairs. A bucket of over MOST members is filed
again under choices of blocks of its remaining bits; with the bits shared by then, a bucket
cannot hold more than 2**12 distinct fingerprints. Links become components by alternating
large-star and small-star steps on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, schema_with, small_batches, stored, unpack, whole_row

BITS = 64
MOST = 4096
SEED = 42


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of one text: lower-cased ASCII words, shingles with repeats, XXH64 each."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """id, fp (signed 64 bits) for each row, with keep_rows also the whole row as a struct."""
    small_batches(docs.sparkSession)
    rows = [whole_row(docs).alias("row")] if keep_rows else []
    source = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            carried = [batch.column("row")] if keep_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps), *carried], names=["id", "fp", *(["row"] if keep_rows else [])])

    schema = schema_with(source, ["id"], "fp bigint")
    return source.mapInArrow(run, schema.add(source.schema["row"]) if keep_rows else schema)


def _edges(parts: int, low: int, high: int) -> list[tuple[int, int]]:
    """Bits low..high in `parts` blocks of nearly equal width."""
    cuts = [low + round(i * (high - low) / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    m = sum(((1 << w) - 1) << at for at, w in blocks)
    return m - (1 << 64) if m >= 1 << 63 else m


def _filed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """Each fingerprint once for every choice of blocks: choice, key (its bits there), fp."""
    masks = [_mask(c) for c in combinations(_edges(blocks, 0, BITS), blocks - distance)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    return fps.select("fp", F.posexplode(keys).alias("choice", "key"))


def _refiled(large: DataFrame, blocks: int, distance: int) -> DataFrame:
    """Members of large buckets, filed again by blocks of the bits that their bucket leaves open."""
    fine = 8

    def keys(choice: tuple[tuple[int, int], ...]) -> Column:
        held = {b for at, w in choice for b in range(at, at + w)}
        rest = [b for b in range(BITS) if b not in held]
        groups = [rest[i * len(rest) // fine : (i + 1) * len(rest) // fine] for i in range(fine)]
        masks = []
        for c in combinations(groups, fine - distance):
            m = sum(1 << b for g in c for b in g) + sum(1 << b for b in held)
            masks.append(m - (1 << 64) if m >= 1 << 63 else m)
        return F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])

    choices = list(combinations(_edges(blocks, 0, BITS), blocks - distance))
    # One branch for each choice: few rows, and an array of literals stays small.
    out = None
    for i, c in enumerate(choices):
        part = large.filter(F.col("choice") == i).select("fp", F.posexplode(keys(c)).alias("sub", "key"))
        part = part.select((F.lit(1000 * (i + 1)) + F.col("sub")).cast("int").alias("choice"), "key", "fp")
        out = part if out is None else out.unionByName(part)
    return out


def _forest(distance: int):
    """Verified links of each bucket; rows come sorted by (choice, key)."""

    def linked(fps: np.ndarray, a: list[int], b: list[int]) -> None:
        left = np.unique(fps)
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found = left[near]
                    left = left[~near]
                    a.extend([x.view(np.int64).item()] * len(found))
                    b.extend(found.view(np.int64).tolist())
                    todo.extend(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket of the batches so far, which may go on
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a: list[int] = []
            b: list[int] = []
            new = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            for i in np.flatnonzero(np.diff(bounds) > 1):
                linked(fp[bounds[i] : bounds[i + 1]], a, b)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("choice", "key")] + [batch.column("fp").to_numpy().view(np.uint64)]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if ((now[0] != now[0][-1]) | (now[1] != now[1][-1])).any() else 0
            held = [x[last:] for x in now]
            if last:
                yield links(*[x[:last] for x in now])
        if held is not None:
            yield links(*held)

    return run


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, most: int = MOST) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints: within each component of the relation
    'at most `distance` bits apart' they connect all members. fps: distinct values in column fp."""
    if not 0 <= distance < blocks:
        raise ValueError("distance must be below the number of blocks")
    bucket = Window.partitionBy("choice", "key")
    filed = _filed(fps, blocks, distance).withColumn("members", F.count(F.lit(1)).over(bucket)).filter("members > 1")
    filed = stored(filed, "simhash-buckets")
    normal = filed.filter(F.col("members") <= most).select("choice", "key", "fp")
    small = _refiled(filed.filter(F.col("members") > most), blocks, distance)
    both = normal.unionByName(small).repartition("choice", "key").sortWithinPartitions("choice", "key")
    return both.mapInArrow(_forest(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: every node of the links (a, b) with the smallest (signed) node it can reach.

    Large-star and small-star steps; each round is written out, and a round that changes nothing
    ends it. Minima are pre-aggregated, so a node with many links is no single task's list.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.filter("u > v").groupBy("u").agg(F.min("v").alias("m"))
        down = large.filter("u > v").join(low, "u")
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    distance: int = 3,
    blocks: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_rows: bool = False,
    most: int = MOST,
) -> DataFrame:
    """For each row: id, fingerprint (16 hex digits), component_id.

    Words are runs between [\\x20\\x09-\\x0D], A-Z lower-cased; a text of fewer words than a
    shingle is one shingle; one without words, or null, has fingerprint zero, which links like
    any other. component_id is the smallest identifier that links of at most `distance` bits
    reach; null identifiers are never the smallest unless a component has no other. Equal
    fingerprints need no links: they share a component. Texts are taken whole. Repeated rows
    are rows of one component. An empty table gives an empty result. With keep_rows the
    columns are row (a struct of all columns), id, root (the component's own number) and
    component_id, and other columns may have any name.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col, keep_rows), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    distinct = stored(distinct, "distinct-fingerprints")
    found = components(links(distinct.select("fp"), distance, blocks, most))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted-fingerprints")
    # Only components of several fingerprints need a minimum over them.
    multi = found.select(F.col("node").alias("fp")).distinct()
    joined = rooted.join(multi, "fp", "left_semi")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "component_id")
    every = rooted.join(named, "fp", "left").select("fp", "root", F.coalesce("component_id", "first").alias("component_id"))
    # A table of its own: both sides of the join are then plain exchanges, which Spark can split.
    every = stored(every, "named-fingerprints")
    out = prints.join(every, "fp")
    if keep_rows:
        return out.select("row", "id", "root", "component_id")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with one of each component: that of its smallest identifier, and of repeated rows
    with that identifier the one with the smallest row hash."""
    marked = near_duplicates(docs, words, distance, blocks, id_col, text_col, keep_rows=True)
    first = marked.filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = Window.partitionBy("root").orderBy(F.xxhash64("row"))
    return first.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select(*unpack("row", docs.columns))
