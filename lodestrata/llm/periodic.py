"""Periodic runs of words, found on tiles of every scale.

A document is exploded into overlapping tiles, for each octave of periods [2^k, 2^(k+1)) some whose
length goes with 2^k. Tiles are solved independently. Blocks of 2^k words at multiples of 2^k are
compared with what stands a period later, all periods of the octave at once, by rolling hashes; two
neighbouring blocks that recur at one distance are part of every run that is long enough. Where
such a chain of blocks ends, Z-functions at the boundary, forward and backward, say for all periods
how far the repetition goes on. A tile hands on fragments (document, period, interval), which Spark
shuffles by document and period and stitches into whole runs.

Hashes only propose: a fragment's words are compared before it is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, small_batches, stored

#: Words of a tile's core, or four blocks where these are more.
SPAN = 8192
#: Bytes from which on a text's tiles are dealt to tasks of their own.
LONG = 1 << 20
#: Odd multipliers of the rolling hash and of a word's number in it.
BASE, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Compared places of one step.
STEP = 1 << 20


def octaves(n: int, exponent: int) -> range:
    """Octaves whose least period fits into n words so often."""
    return range((n // exponent).bit_length())


def tiles(n: int, exponent: int, span: int = SPAN) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low, high, start, stop, first, last): octaves served, words of the tile, blocks of its core.

    Neighbouring cores share a block, so that each two neighbouring blocks are in one core. Octaves
    for which one tile holds the whole document share it, with last = -1 for the last whole block.
    """
    whole = [k for k in octaves(n, exponent) if (n >> k) - 1 <= max(4, span >> k)]
    if whole:
        yield whole[0], whole[-1], 0, n, 0, -1
    for k in octaves(n, exponent):
        if k not in whole:
            blocks, core = n >> k, max(4, span >> k)
            for first in range(0, blocks - 1, core):
                last = min(first + core, blocks - 1)
                yield k, k, max(0, (first - 1) << k), min(n, (last + 4) << k), first, last


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those at the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def _chains(words: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, tile: np.ndarray, block: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(tile, period, first block, last block): two blocks or more in a row that recur at the period.

    anchor: places of the blocks in words, in order of tile and block."""
    length = 1 << k
    power = np.full(max(len(words), 2 * length) + 1, np.uint64(BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * np.uint64(WORD) * power[: len(words)], out=sums[1:])
    windows = sums[length:] - sums[:-length] if len(words) >= length else np.zeros(0, np.uint64)
    end = (begin + size)[tile]
    periods = np.arange(length, 2 * length)
    at, distance = [], []
    rows = max(1, STEP // length)
    for a in range(0, len(anchor), rows):
        here = anchor[a : a + rows, None]
        there = here + periods[None, :]
        fits = there + length <= end[a : a + rows, None]
        there = np.minimum(there, len(windows) - 1)
        i, q = np.nonzero(fits & (windows[here] * power[periods][None, :] == windows[there]))
        at.append(i + a)
        distance.append(q)
    i, q = np.concatenate(at), np.concatenate(distance)
    # In order of tile, period and block, a chain is a stretch without a gap.
    order = np.lexsort((block[i], q, tile[i]))
    i, q = i[order], q[order]
    new = np.ones(len(i), bool)
    new[1:] = (q[1:] != q[:-1]) | (tile[i[1:]] != tile[i[:-1]]) | (block[i[1:]] != block[i[:-1]] + 1)
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(i)) - 1
    for s, e in zip(starts[stops > starts].tolist(), stops[stops > starts].tolist()):
        yield int(tile[i[s]]), int(q[s]) + length, int(block[i[s]]), int(block[i[e]])


def fragments(words: np.ndarray, sizes: list[int], extents: list[tuple[int, int, int, int]], k: int, exponent: int) -> Iterator[tuple[int, int, int, int]]:
    """(tile, period, start, stop) of an octave: words at start to stop (exclusive), counted in the
    document, equal those a period later; the period is the least one.

    words: of all tiles, one after another; extents: (start, first, last, n) of each. What is
    surely too short is left out; what reaches a core's border is handed on for stitching.
    """
    length = 1 << k
    size = np.array(sizes)
    begin = np.cumsum(size) - size
    last = [x[2] if x[2] >= 0 else (x[3] >> k) - 1 for x in extents]
    counts = np.array([b - x[1] + 1 for b, x in zip(last, extents)])
    tile = np.repeat(np.arange(len(extents)), counts)
    block = np.arange(len(tile)) - np.repeat(np.cumsum(counts) - counts, counts) + np.array([x[1] for x in extents])[tile]
    anchor = begin[tile] + block * length - np.array([x[0] for x in extents])[tile]
    own: list[int] = []
    of, ahead, forward, backward = -1, {}, {}, {}
    for t, q, b1, b2 in _chains(words, begin, size, anchor, tile, block, k):
        start, first, _, n = extents[t]
        if t != of:
            of, ahead, forward, backward = t, {}, {}, {}
            here = words[begin[t] : begin[t] + size[t]]
            own = here.tolist()
        m1, m2 = b1 * length - start, (b2 + 1) * length - start
        if b1 not in ahead:
            z = z_function(own[m1 : m1 + 2 * length])
            p = next((p for p in range(1, len(z)) if z[p] == len(z) - p), len(z))
            ahead[b1] = z, p, _reach(here, m1, p)
        z, p, reach = ahead[b1]
        power = _is_power(z, q)
        if power and q % p == 0 and reach >= m2 + q:
            continue  # what recurs is a power of something shorter
        if power or not np.array_equal(here[m1:m2], here[m1 + q : m2 + q]):  # the hash was wrong
            yield from ((t, q, start + a, start + z) for a, z in _stretches(here[:-q] == here[q:]) if not _is_power(z_function(own[a : a + q]), q))
            continue
        if b1 not in backward:
            before = own[max(0, m1 - length) : m1][::-1]
            backward[b1] = [min(len(before), z) for z in z_function([*before, -1, *own[max(0, m1 - length) : m1 + 2 * length][::-1]])[len(before) + 1 :]]
        if b2 not in forward:
            forward[b2] = z_function(own[m2 : m2 + 3 * length])
        known = m1 + 2 * length - max(0, m1 - length)
        behind = m1 + 2 * length - min(len(own), m1 + 2 * length)
        left = backward[b1][2 * length - q - behind] if 2 * length - q - behind < known else 0
        right = min(length, forward[b2][q]) if q < len(forward[b2]) else 0
        a, z = start + m1 - left, start + m2 + right
        if z - a >= (exponent - 1) * q or (b1 == first and first) or (b2 == last[t] and (last[t] + 1) << k < n - length):
            yield t, q, a, z


def _is_power(z: list[int], q: int) -> bool:
    """Whether the first q elements repeat something shorter, by the Z-function from there on."""
    return any(z[q // r] >= q - q // r for r in _primes(q))


def _reach(words: np.ndarray, start: int, period: int) -> int:
    """The end of what has this period from start on."""
    differs = words[start:-period] != words[start + period :]
    return start + period + (int(differs.argmax()) if differs.any() else len(differs))


def _stretches(equal: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist())


TILE = "k1 bigint, k2 bigint, n bigint, low int, high int, start bigint, first bigint, last bigint, words binary"


def _cut(texts: DataFrame, exponent: int, least: int, span: int) -> DataFrame:
    """k1, k2, text: the tiles of every document, with words as numbers of the document's own."""
    names = [x.split()[0] for x in TILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k1, k2, text in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "text")]):
                number: dict[bytes, int] = {}
                ids = [number.setdefault(w, len(number)) for w in text.split()]
                if len(ids) < least or len(number) == len(ids):
                    continue
                data = np.array(ids, "<i4")
                for low, high, start, stop, first, last in tiles(len(ids), exponent, span):
                    rows.append((k1, k2, len(ids), low, high, start, first, last, data[start:stop].tobytes()))
                    held += stop - start
                    if held > STEP:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names).cast(ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names).cast(ARROW)

    return texts.mapInArrow(run, TILE)


ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in TILE.split(", "))])


def _solved(cut: DataFrame, exponent: int) -> DataFrame:
    """k1, k2, period, start, stop of the tiles' fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            extents = list(zip(*[batch.column(c).to_pylist() for c in ("start", "first", "last", "n")]))
            words = [np.frombuffer(w.as_buffer(), "<i4") for w in batch.column("words")]
            found: list[tuple[int, int, int, int]] = []
            for k in range(min(low, default=0), max(high, default=-1) + 1):
                at = [i for i in range(len(words)) if low[i] <= k <= high[i]]
                # As many tiles at a time as make about STEP words.
                parts = np.cumsum([len(words[i]) for i in at]) // STEP
                for p in np.unique(parts):
                    own = [at[j] for j in np.flatnonzero(parts == p)]
                    every = np.concatenate([words[i] for i in own])
                    found.extend((own[t], q, a, z) for t, q, a, z in fragments(every, [len(words[i]) for i in own], [extents[i] for i in own], k, exponent))
            if found:
                of, q, a, z = (np.array(x, np.int64) for x in zip(*found))
                keys = [batch.column(c).take(pa.array(of)) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(q), pa.array(a), pa.array(z)], names=["k1", "k2", "period", "start", "stop"])

    return cut.mapInArrow(run, "k1 bigint, k2 bigint, period bigint, start bigint, stop bigint")


def _stitched(found: DataFrame, exponent: int, least: int) -> DataFrame:
    """k1, k2, start, length, period: fragments that meet or overlap, put together."""
    before = Window.partitionBy("k1", "k2", "period").orderBy("start", "stop")
    marked = found.distinct().withColumn("reach", F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("k1", "k2", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("k1", "k2", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.filter(F.col("length") >= F.greatest(F.lit(least), exponent * F.col("period")))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, span: int = SPAN, long: int = LONG) -> DataFrame:
    """One row for each run of each distinct (id, text): k1, k2 (hashes of both), start, length, period.

    A run is a stretch of words (runs of anything but [\\x20\\x09-\\x0D]) with smallest period q and
    length of at least exponent x q and `least`, which no neighbouring word prolongs. exponent is
    four at least: that is what makes each run hold two blocks. A null text has no words. Texts
    of any length are read whole; those of `long` bytes or more share their tiles among tasks.
    Repeated rows are solved each and give their runs once. An empty table has none.
    """
    if exponent < 4 or least < 1:
        raise ValueError("runs of fewer than four periods, or of no words, are not found")
    small_batches(docs.sparkSession)
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = _keyed(docs, id_col, text_col).select("k1", "k2", text.alias("text"))
    few = texts.filter(F.octet_length("text") < long)
    many = _cut(texts.filter(F.octet_length("text") >= long), exponent, least, span).repartition("k1", "k2", "low", "start")
    found = _solved(_cut(few, exponent, least, span), exponent).unionByName(_solved(many, exponent))
    return _stitched(stored(found, "run-fragments"), exponent, least)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row, and two 64-bit hashes of identifier and text: a key that no lost task changes."""
    parts = [col(id_col).cast("string"), col(text_col).cast("string")]
    return docs.select(*[col(c) for c in (id_col, text_col)], F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("k2"), *parts).alias("k2"))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, span: int = SPAN, long: int = LONG) -> DataFrame:
    """For each row: id, runs (array of start, period, length, in this order), collapsed (the words
    that are in no run after that run's first period, joined by one space).

    As find_runs(); a null text collapses to an empty one, and repeated rows have a row each. Null
    identifiers are carried. Other columns are ignored, whatever their names.
    """
    runs = find_runs(docs, id_col, text_col, exponent, least, span, long)
    each = F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    # A text's runs are no more than its words.
    by_text = stored(runs.groupBy("k1", "k2").agg(each), "runs")
    rows = _keyed(docs, id_col, text_col).select(col(id_col).alias("id"), "k1", "k2", F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    # Shuffled at every size: runs are not few enough to be broadcast for certain.
    joined = rows.join(by_text.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"))
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.split()
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    a, q, n = (np.array([r[c] for r in runs]) for c in ("start", "period", "length"))
                    np.add.at(change, a + q, 1)
                    np.add.at(change, a + n, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                out.append(b" ".join(words))
            texts = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("runs"), texts], names=["id", "runs", "collapsed"])

    return joined.mapInArrow(run, f"id {id_type}, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string").withColumnRenamed("id", id_col)
