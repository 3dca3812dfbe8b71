"""Nearest neighbours by cosine over inverted lists.

A coarse quantiser (spherical k-means over a bounded sample) gives every vector a list; lists are
partitions of the stored table, so that a search for one vector reads the lists nearest to it and
no others. A search for many vectors meets blocks of them with groups of lists, as matrix products
of each list and those vectors of the block that probe it. How many lists a search probes is measured: the fewest that bring the recall of
a bounded set of stored vectors to the target, against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.vectors import cosine, vector
from lodestrata.operators.relational import first_n
from lodestrata.sources.scratch import stored

#: Vectors that the quantiser is fitted to, and that measure recall, at most about.
SAMPLE, MEASURED = 20_000, 200
#: Vectors of a block, at least, as far as there are so many; blocks that larger tables have; vectors of a block, at most about.
BLOCK, BLOCKS, LARGEST = 4096, 8, 1 << 16
#: Cosines that Python holds at once, about, and found rows before the best of them are chosen.
SCORES, FOUND = 1 << 22, 1 << 21
#: Copies of vectors, one for each list that they probe, that Python holds at once.
COPIES = 16_384


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors as rows of length one; one of length zero stays."""
    m = np.array(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def blocks_of(n: int, rows: int) -> int:
    """Blocks that n vectors are cut into: each vector is shuffled about once for each block."""
    return max(1, min(-(-n // rows), max(BLOCKS, -(-n // LARGEST))))


def unit_table(column: pa.ChunkedArray) -> np.ndarray:
    """unit_rows() of an Arrow column of vectors of one dimension."""
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def best_of_rows(score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k best scores of at least `least`, in that order, ties by column."""
    hit = score >= least
    if score.shape[1] > k and hit.sum() > 16 * k * len(score):
        hit &= score >= np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(hit)
    return _firsts(i, j, score[i, j], k)


def _firsts(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((j, -score, i))
    i, j = i[order], j[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best]


class Best:
    """The k best (row, other, score) of each row among all that are added, ties by the other."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((row, other, score))
        self.held += len(row)
        if self.held > FOUND:
            self.parts = [self.all()]
            self.held = min(self.held, len(self.parts[0][0]) // 2)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((other, -score, row))
        row, other, score = row[order], other[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[best], other[best], score[best]


def fit_centres(rows: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, begun with rows spread over the sample; an empty one takes
    the row that fits its centre worst."""
    if not len(rows):
        return np.zeros((0, 0))
    centres = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        score = rows @ centres.T
        own = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        worst = iter(np.argsort(score.max(1), kind="stable"))
        for c in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            sums[c] = rows[next(worst)]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """lists: (list, key, v), stored by list; sizes: rows of each list; probes: lists that a search
    reads; recall: what share of true neighbours that found when it was measured."""

    key: str
    centres: np.ndarray
    lists: DataFrame
    sizes: np.ndarray
    probes: int
    recall: float

    def nearest_lists(self, one: list[float], probes: int | None = None) -> list[int]:
        return np.argsort(-(unit_rows([one]) @ self.centres.T)[0], kind="stable")[: probes or self.probes].tolist()

    def search(self, one: list[float], k: int, probes: int | None = None) -> DataFrame:
        """key, similarity: the k best of the lists nearest to one vector. Only they are read."""
        if not len(self.centres):
            return self.lists.select(F.col("key").alias(self.key), F.lit(0.0).alias("similarity"))
        near = self.lists.filter(F.col("list").isin(self.nearest_lists(one, probes)))
        return near.select(F.col("key").alias(self.key), cosine(F.col("v"), vector(one)).alias("similarity")).orderBy(F.desc("similarity"), self.key).limit(k)

    def neighbours(self, queries: DataFrame, key: str, vector: str, k: int, least: float = -1.0, same: bool = True, probes: int | None = None) -> DataFrame:
        """query, key, similarity: for each query the k best cosines of at least `least` in the lists
        that it probes; without same, a vector is not its own neighbour.

        Queries are cut into blocks, lists into groups of about a block's size; a block and a group are one
        task's work, which passes on at most k rows for each query. So a vector is shuffled once for each
        group or block, however many lists it probes.
        """
        asking = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(_usable(F.col("v")))
        kind, of = dict(self.lists.dtypes)["key"], dict(asking.dtypes)["id"]
        if not len(self.centres):
            return self.lists.select(F.lit(None).cast(of).alias("query"), F.col("key").alias(self.key), F.lit(0.0).alias("similarity")).limit(0)
        probes = probes or self.probes
        blocks, groups = blocks_of(asking.count(), BLOCK), blocks_of(int(self.sizes.sum()), BLOCK)
        rows = -(-max(1, int(self.sizes.sum())) // groups)
        pick = lambda n: F.element_at(F.array(*[F.lit(int(x)) for x in n]), F.col("list") + 1)
        first, cuts = (np.cumsum(self.sizes) - self.sizes) // rows, np.maximum(1, -(-self.sizes // rows))
        groups = int((first + cuts).max())
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = asking.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("b", each(groups))
        b = self.lists.withColumn("b", (pick(first) + F.pmod(F.xxhash64("key"), pick(cuts))).cast("int")).withColumn("a", each(blocks))
        centres = queries.sparkSession.sparkContext.broadcast(self.centres)

        def match(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.sort_by("id"), right.sort_by([("list", "ascending"), ("key", "ascending")])
            x, y, best = unit_table(left.column("v")), unit_table(right.column("v")), Best(k)
            ids, keys, lists = (c.combine_chunks() for c in (left.column("id"), right.column("key"), right.column("list")))
            lists = lists.to_numpy()
            # Numbers of equal keys are equal, in their order, so that they break ties.
            names = pa.concat_arrays([keys, ids if ids.type == keys.type else pa.nulls(len(ids), keys.type)])
            code = pc.rank(names, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
            there, here = code[: len(keys)], code[len(keys) :]
            near = np.zeros((len(x), len(centres.value)), bool)
            each = max(1, SCORES // len(centres.value))
            for at in range(0, len(x), each):
                order = np.argsort(-(x[at : at + each] @ centres.value.T), axis=1, kind="stable")[:, :probes]
                np.put_along_axis(near[at : at + each], order, True, axis=1)
            for n in np.unique(lists).tolist():
                low, high = np.searchsorted(lists, [n, n + 1])
                asks = np.flatnonzero(near[:, n])
                step = max(1, SCORES // (high - low))
                for own in (asks[i : i + step] for i in range(0, len(asks), step)):
                    score = x[own] @ y[low:high].T
                    if not same:
                        score[here[own][:, None] == there[low:high]] = -2
                    i, j = best_of_rows(score, k, max(least, -1.5))
                    best.add(own[i], there[low:high][j] * len(y) + low + j, score[i, j])
            row, other, similarity = best.all()
            return pa.table({"query": ids.take(pa.array(row)), "key": keys.take(pa.array(other % max(1, len(y)))), "similarity": similarity})

        met = a.repartition(blocks * groups, "a", "b").groupBy("a", "b").cogroup(b.repartition(blocks * groups, "a", "b").groupBy("a", "b")).applyInArrow(match, f"query {of}, key {kind}, similarity double")
        return first_n(met, "query", [F.desc("similarity"), F.col("key")], k).select("query", F.col("key").alias(self.key), "similarity")

    def compared(self, queries: DataFrame, key: str, vector: str, probes: int | None = None) -> int:
        """Pairs of vectors that neighbours() compares."""
        centres, most = queries.sparkSession.sparkContext.broadcast(self.centres), probes or self.probes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = np.zeros(len(centres.value), np.int64)
            for batch in batches:
                if len(batch) and len(asked):
                    near = np.argsort(-(unit_rows(batch.column("v").to_pylist()) @ centres.value.T), axis=1, kind="stable")[:, :most]
                    asked += np.bincount(near.ravel(), minlength=len(asked))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked), dtype=np.int32)), pa.array(asked)], names=["list", "n"])

        asked = queries.select(F.col(vector).alias("v")).filter(_usable(F.col("v"))).mapInArrow(run, "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n")).collect()  # one row a list
        return sum(r["n"] * int(self.sizes[r["list"]]) for r in asked)

    def _probing(self, queries: DataFrame, probes: int) -> DataFrame:
        """list, id, v: each query once for each list that it probes; a batch is copied part by part."""
        centres = queries.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = max(1, COPIES // max(1, min(probes, len(centres.value))))
            for batch in (whole.slice(i, each) for whole in batches for i in range(0, len(whole), each)):
                if not len(centres.value):
                    continue
                near = np.argsort(-(unit_rows(batch.column("v").to_pylist()) @ centres.value.T), axis=1, kind="stable")[:, :probes]
                rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *rows.columns], names=["list", "id", "v"])

        kinds = dict(queries.dtypes)
        return queries.filter(_usable(F.col("v"))).mapInArrow(run, f"list int, id {kinds['id']}, v {kinds['v']}")


def _usable(v: Column) -> Column:
    """A vector that has a direction: not null, without null or non-finite entries, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def build_vector_index(df: DataFrame, key: str, vector: str, lists: int = 100, target: float = 0.95, k: int = 10, sample: int = SAMPLE, measured: int = MEASURED) -> VectorIndex:
    """The index of a frame's vectors, which have to be of one dimension: min(rows, lists) lists.

    Every vector with a direction is stored; others, null or zero, have no cosine and are left out.
    About `sample` vectors, drawn by a hash of their keys, fit the quantiser, and about `measured` of
    them measure recall at k; no more reach the driver, but for vectors that are repeated under one
    key. Centres are broadcast: lists x dimension numbers.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(_usable(F.col("v")))
    n = rows.count()
    share = lambda most: rows if n <= most else rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    drawn = sorted(map(tuple, share(sample).withColumn("h", F.xxhash64("key", "v")).select("h", "v").collect()))
    centres = fit_centres(unit_rows([v for _, v in drawn]) if drawn else np.zeros((0, 0)), lists)
    index = VectorIndex(key, centres, rows, np.zeros(len(centres), np.int64), 1, 1.0)
    placed = index._probing(rows.select(F.col("key").alias("id"), "v"), 1).select("list", F.col("id").alias("key"), "v")
    # Files of a list are as many as tasks write to it: a large list is cut by its keys.
    files = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // (BLOCK * 16 * max(1, len(centres)))))))
    kept = stored(placed.repartition("list", files), "vector-lists", keep=True, by=["list"]).select("list", "key", "v")
    sizes = np.zeros(len(centres), np.int64)
    for r in kept.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    index = VectorIndex(key, centres, kept, sizes, max(1, len(centres)), 1.0)
    if len(centres) < 2:
        return index
    asking = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, measured / n) * (1 << 30)))
    probes, recall = _measured(index, asking, k, target)
    return VectorIndex(key, centres, kept, sizes, probes, recall)


def _measured(index: VectorIndex, asking: DataFrame, k: int, target: float) -> tuple[int, float]:
    """The fewest probes that find the target share of the k true neighbours, and the share found."""
    near = index.neighbours(asking, "key", "v", k, same=False)  # all lists: exact
    where = near.join(index.lists.select(F.col("key").alias(index.key), "list"), index.key).select("query", "list")
    rows = where.join(asking.select(F.col("key").alias("query"), "v"), "query").select("query", "list", "v").collect()  # k rows for each measured vector
    if not rows:
        return len(index.centres), 1.0
    order = np.argsort(np.argsort(-(unit_rows([r["v"] for r in rows]) @ index.centres.T), axis=1, kind="stable"), axis=1)
    place = np.sort(order[np.arange(len(rows)), [r["list"] for r in rows]])
    probes = int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1
    return probes, float((place < probes).mean())


def recall_of(found: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """queries, wanted, found, recall: how many of the exact (query, key) rows are among the found."""
    hit = exact.select(query, key).join(found.select(query, key).withColumn("_hit", F.lit(1)), [query, key], "left")
    return hit.agg(F.countDistinct(query).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
