"""A stored inverted index with positions, kept in segments that all sessions share.

A segment is one table of postings whose files hold some blocks each, in order of term, field and
block. A block is a group of about `BLOCK` rows, by a hash of the key; a summary of each term's blocks bounds what a block can score.
A search is a filter on terms, which Parquet statistics prune to the pages that hold them, one
aggregate over the hits, and expressions; a top-k or thresholded search first drops the blocks
whose bound is too low. Texts are read only when a segment is built.

refresh() compares a table with what is indexed, row by row of signatures: new and changed rows make
a segment of their own, rows that went or changed are listed as dead, and segments are merged when
there are many, without reading texts. A manifest names the segments in force, so that a second
session, or a search after nothing changed, builds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT, Analyzer
from lodestrata.operators.retrieval import B, K1, bm25_of, top
from lodestrata.sources.kept import drop_kept, folders, read_manifest, write_kept, write_manifest
from lodestrata.sources.scratch import scratch_root, stored, temporary_tables, unshuffled

#: Changes with the tables' columns, so that no session opens an index of another layout.
LAYOUT = "2"
#: Rows of one block, about.
BLOCK = 64
#: Rows of a Parquet page, so that a few blocks can be read alone.
PAGE = "1024"
#: Segments, and share of dead rows, from which on they are merged.
MOST, DEAD = 8, 0.2
#: Blocks or terms that are named one by one in a filter; more are joined. Phrases, and their tokens, that are broadcast at most.
NAMED, SENT = 2000, 1 << 17
#: The term of the row that says how long a document's field is, and the document's signature.
WHOLE = ""
#: Bytes of texts that a task makes postings of, about, and of those that Python holds at once; postings of a merging task.
TASK, HELD, MERGED = 1 << 24, 1 << 22, 1 << 21
ORDER = ["term", "field", "block", "key"]
#: Columns of postings, those of the summary beside them, and what a summary is read as.
POSTINGS = "field string, term string, block bigint, key {}, length int, tf int, positions array<int>, signature binary"
BLOCKS = "n bigint, most int, least int, impact double, mean double"
SUMMARY = f"field string, term string, block bigint, {BLOCKS}"
NAMES, MARKS = POSTINGS.replace(",", "").split()[::2], BLOCKS.replace(",", "").split()[::2]
#: Rows of a batch that Python hands back.
OUT = 1 << 15
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class TextIndex:
    """postings: segment, field, term, block, key, length of the field, tf, positions, signature;
    summary: segment, field, term, block, n, most (tf), least (length), impact (the best part of a score,
    but for idf, under standard parameters and the segment's mean length) and that mean; dead: segment,
    key, or None; rows and mean lengths of what is in force."""

    key: str
    fields: tuple[str, ...]
    analyzer: Analyzer
    postings: DataFrame
    summary: DataFrame
    dead: DataFrame | None
    rows: int
    means: dict[str, float]
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def _live(self, postings: DataFrame) -> DataFrame:
        return postings if self.dead is None else postings.join(self.dead, ["segment", "key"], "left_anti")

    def _hits(self, names: list[str], query: list[str]) -> DataFrame:
        return self.postings.filter(F.col("term").isin(query) & F.col("field").isin(names))

    def _frequencies(self, names: list[str], query: list[str]) -> dict[tuple[str, str], int]:
        """Rows in force that have each term in each field; asked for once."""
        asked = (*names, WHOLE, *query)
        if asked in self.known:
            return self.known[asked]
        wanted = F.col("term").isin(query) & F.col("field").isin(names)
        counts = self.summary.filter(wanted).groupBy("field", "term").agg(F.sum("n").alias("n"))
        out = {(r["field"], r["term"]): r["n"] for r in counts.collect()}  # a number for each of the query's terms
        if self.dead is not None:
            gone = self._hits(names, query).join(self.dead, ["segment", "key"], "left_semi").groupBy("field", "term").count()
            for r in gone.collect():
                out[r["field"], r["term"]] -= r["count"]
        self.known[asked] = out
        return out

    def _scored(self, hits: DataFrame, fields: dict[str, float], query: list[str], k1: float, b: float) -> DataFrame:
        names = list(fields)
        known = self._frequencies(names, query)
        cells = [(i, j) for i in range(len(names)) for j in range(len(query)) if known.get((names[i], query[j]))]
        here = lambda i, j: (F.col("field") == names[i]) & (F.col("term") == query[j])
        pick = lambda value, where, name: F.max(F.when(where, F.col(value))).cast("double").alias(name)
        found = self._live(hits).groupBy("key").agg(
            *[pick("tf", here(i, j), f"_f{i}_{j}") for i, j in cells], *[pick("length", F.col("field") == n, f"_l{i}") for i, n in enumerate(names)]
        )
        df = lambda i, j: F.lit(float(known[names[i], query[j]]))
        parts = [(F.coalesce(f"_f{i}_{j}", F.lit(0.0)), F.col(f"_l{i}"), F.lit(self.means[names[i]]), df(i, j), fields[names[i]]) for i, j in cells]
        score = bm25_of(parts, F.lit(float(self.rows)), k1, b) if parts else F.lit(0.0)
        return found.select(F.col("key").alias(self.key), score.alias("bm25"))

    def search(self, fields: dict[str, float], query: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """key, bm25 of the rows with a match: boosted sum over fields and query tokens."""
        return self._scored(self._hits(list(fields), query), fields, query, k1, b)

    def bounds(self, fields: dict[str, float], query: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """block, n, bound: the most that a row of the block can score, and the postings of the query in it."""
        known = self._frequencies(list(fields), query)
        wanted = self.summary.filter(F.col("term").isin(query) & F.col("field").isin(list(fields)))
        bound = F.lit(0.0)
        for (f, t), df in known.items():
            if df:
                part = (F.col("most").cast("double"), F.col("least").cast("double"), F.lit(self.means[f]), F.lit(float(df)), fields[f])
                loose = bm25_of([part], F.lit(float(self.rows)), k1, b)
                # A mean that has grown since makes no part larger than it has grown itself.
                tight = math.log(1 + (self.rows - df + 0.5) / (df + 0.5)) * fields[f] * F.col("impact") * F.greatest(F.lit(1.0), F.lit(self.means[f]) / F.col("mean"))
                best = F.least(loose, tight) if (k1, b) == (K1, B) else loose
                bound = F.when((F.col("field") == f) & (F.col("term") == t), best).otherwise(bound)
        # A block's rows may be in several segments: of one term they count by the best of these.
        each = wanted.groupBy("block", "field", "term").agg(F.sum("n").alias("n"), F.max(bound).alias("bound"))
        return each.groupBy("block").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound"))

    def _of_blocks(self, hits: DataFrame, blocks: DataFrame) -> DataFrame:
        named = [r["block"] for r in blocks.select("block").limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            return hits.filter(F.col("block").isin(named)) if named else hits.limit(0)
        return hits.join(blocks.select("block"), "block", "left_semi")

    def search_from(self, fields: dict[str, float], query: list[str], least: float, k1: float = K1, b: float = B) -> DataFrame:
        """search() with a score of `least` or more; blocks that cannot have one are not read."""
        if least <= 0:
            return self.search(fields, query, k1, b).filter(F.col("bm25") >= least)
        blocks = self.bounds(fields, query, k1, b).filter(F.col("bound") >= least - 1e-9)
        hits = self._of_blocks(self._hits(list(fields), query), blocks)
        return self._scored(hits, fields, query, k1, b).filter(F.col("bm25") >= least)

    def top(self, fields: dict[str, float], query: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
        """The k best rows, ties by key: the most promising blocks are scored first, and then such
        whose bound reaches the k-th score found there."""
        return top(self.search_from(fields, query, self.threshold(fields, query, k, k1, b), k1, b), "bm25", self.key, k)

    def threshold(self, fields: dict[str, float], query: list[str], k: int, k1: float = K1, b: float = B) -> float:
        """A score that k rows reach: the k-th in the k blocks of the highest bounds; 0 if there are not so many."""
        first = self.bounds(fields, query, k1, b).orderBy(F.desc("bound"), "block").limit(k)
        scores = self._scored(self._of_blocks(self._hits(list(fields), query), first), fields, query, k1, b)
        best = [r["bm25"] for r in scores.orderBy(F.desc("bm25")).limit(k).collect()]
        return best[-1] if len(best) == k else 0.0

    def reads(self, fields: dict[str, float], query: list[str], k: int) -> DataFrame:
        """k, postings, read, blocks, kept: postings of the query, those that top() reads after its
        first blocks, and the same for blocks."""
        least = self.threshold(fields, query, k)
        keep = F.col("bound") >= least - 1e-9
        return self.bounds(fields, query).agg(
            F.lit(k).alias("k"), F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("read"), F.count(F.lit(1)).alias("blocks"), F.count_if(keep).alias("kept")
        )

    def phrases(self, field: str, wanted: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """key, bm25: rows that hold any of the phrases, each scored like a term by how often it occurs."""
        spark = self.postings.sparkSession
        named = spark.createDataFrame([(i, p) for i, p in enumerate(wanted)], "phrase_id int, phrase string")
        found = self.match_phrases(named, "phrase_id", "phrase", field, k1, b)
        return found.groupBy(self.key).agg(F.sum("bm25").alias("bm25"))

    def match_phrases(self, phrases: DataFrame, id_col: str, text_col: str, field: str, k1: float = K1, b: float = B) -> DataFrame:
        """id, key, hits, bm25 of all phrases in all rows. Only postings are read.

        A phrase begins where its rarest token puts it; each other token then has to follow at its
        place, by the postings of the rows found so far. Work goes with the rarest tokens' postings, and
        only postings of the phrases' tokens are shuffled. A phrase without tokens is found nowhere; equal ids have to be equal phrases.
        """
        tokens = phrases.select(F.col(id_col).alias("id"), self.analyzer.tokens(F.col(text_col)).alias("tokens")).filter(F.size("tokens") > 0).distinct()
        tokens = stored(tokens, "phrases")
        parts = tokens.select("id", F.size("tokens").alias("m"), F.posexplode("tokens").alias("at", "term"))
        few = parts.count() <= SENT
        sent = lambda df: F.broadcast(df) if few else df
        named = [r["term"] for r in parts.select("term").distinct().limit(NAMED + 1).collect()]

        def of_phrases(postings: DataFrame) -> DataFrame:
            if len(named) <= NAMED:
                return postings.filter(F.col("term").isin(named)) if named else postings.limit(0)
            return postings.join(sent(parts.select("term").distinct()), "term", "left_semi")

        counts = of_phrases(self.summary.filter(F.col("field") == field)).groupBy("term").agg(F.sum("n").alias("n"))
        rarest = parts.join(counts, "term", "left").groupBy("id", "m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term")).alias("r"))
        rarest = rarest.filter("r.n > 0").select("id", "m", F.col("r.at").alias("at"), F.col("r.term").alias("term"))
        places = of_phrases(self.postings.filter((F.col("field") == field) & (F.col("term") != WHOLE)))
        places = self._live(places).select("segment", "key", "length", "term", "positions")
        shifted = lambda: F.transform("positions", lambda p: p - F.col("at"))
        begun = places.join(sent(rarest), "term").select("id", "m", "segment", "key", "length", F.col("at").alias("anchor"), shifted().alias("starts"))
        rest = begun.filter("m > 1").join(sent(parts.select("id", "at", "term")), "id").filter(F.col("at") != F.col("anchor"))
        more = rest.join(places.drop("length"), ["segment", "key", "term"]).groupBy("id", "m", "segment", "key", "length")
        whole = more.agg(F.first("starts").alias("starts"), F.collect_list(shifted()).alias("others")).filter(F.size("others") == F.col("m") - 1)
        whole = whole.select("id", "key", "length", F.aggregate("others", F.col("starts"), lambda a, x: F.array_intersect(a, x)).alias("starts"))
        found = begun.filter("m = 1").select("id", "key", "length", "starts").unionByName(whole).filter(F.size("starts") > 0)
        found = stored(found.select("id", "key", "length", F.size("starts").cast("long").alias("hits")), "phrase-hits")
        spread = found.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("df"))
        part = (F.col("hits").cast("double"), F.col("length").cast("double"), F.lit(self.means[field]), F.col("df"), 1.0)
        score = bm25_of([part], F.lit(float(self.rows)), k1, b)
        return found.join(spread, "id").select(F.col("id").alias(id_col), F.col("key").alias(self.key), "hits", score.alias("bm25"))


def _postings(df: DataFrame, key: str, fields: list[str], analyzer: Analyzer, blocks: int) -> DataFrame:
    """All postings of a frame, with a row of the term WHOLE for each field of each row.

    Texts, not postings, are dealt to tasks, by blocks and so evenly, however frequent a term is; a
    row's terms are counted, and a task's postings sorted, where the rows are. A task has about TASK bytes
    of texts, at every size. Tokens are found once: their lines are written, which also gives the mean
    lengths. The first posting of a term in a block has the block's summary."""
    kind, spark = dict(df.dtypes)[key], df.sparkSession
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
    lines = df.select(F.col(key).alias("key"), _signature(fields).alias("signature"), block, *[analyzer.line(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    lines = stored(lines.select("*", *[_words(F.col(f"t{i}")).alias(f"n{i}") for i in range(len(fields))], sum(F.octet_length(f"t{i}") for i in range(len(fields))).cast("long").alias("size")), "lines")
    size, *means = lines.agg(F.sum("size"), *[F.avg(f"n{i}") for i in range(len(fields))]).first()
    means = dict(zip(fields, means))
    rows = lines.select("key", "signature", "block", *[f"t{i}" for i in range(len(fields))]).repartition(_tasks(spark, size or 0, TASK), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found = [], [[] for _ in fields]
        before = 0
        for batch in (piece for whole in batches for piece in _pieces(whole, len(fields))):
            n = len(batch)
            docs.append(batch.select(["key", "signature", "block"]))
            for i in range(len(fields)):
                line = batch.column(f"t{i}")
                tokens = pc.split_pattern(line, " ")
                length = np.where(pc.binary_length(line).to_numpy() == 0, 0, pc.list_value_length(tokens).to_numpy())
                flat = tokens.flatten()
                encoded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()  # an empty line splits into an empty token
                place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                row, code = np.repeat(np.arange(n), length), encoded.indices.to_numpy()
                order = np.argsort(row * max(1, len(encoded.dictionary)) + code, kind="stable")  # a row's terms, and the places of each, side by side
                row, code = row[order], code[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(row))).astype(np.int32)
                found[i].append((encoded.dictionary, code[new], (before + row[new]).astype(np.int32), tf, place[order].astype(np.int32), length.astype(np.int32)))
            before += n
        if not docs:
            return
        docs = pa.Table.from_batches(docs).combine_chunks()
        in_order = pc.sort_indices(docs, sort_keys=[("block", "ascending"), ("key", "ascending")]).to_numpy()
        rank = np.empty(len(docs), np.int64)
        rank[in_order] = np.arange(len(docs))
        yield from _sorted_postings(docs, in_order, rank, dict(sorted(zip(fields, found))), means)

    return rows.mapInArrow(run, f"{POSTINGS.format(kind)}, {BLOCKS}")


def _words(line: Column) -> Column:
    """Tokens of a line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1)


def _sorted_postings(docs: pa.Table, in_order: np.ndarray, rank: np.ndarray, parts: dict[str, list[tuple]], means: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """A task's postings in stored order: first the rows of documents, then those of the terms."""
    fields = pa.array(list(parts), pa.string())
    terms, codes, doc, tf, places, _ = zip(*[p for own in parts.values() for p in own])
    lengths = np.stack([np.concatenate([p[-1] for p in own]) for own in parts.values()])
    field = np.repeat(np.repeat(np.arange(len(parts)), [len(own) for own in parts.values()]), [len(c) for c in codes])
    encoded = pa.concat_arrays(terms).dictionary_encode()
    by_name = pc.sort_indices(encoded.dictionary).to_numpy()
    name = np.empty(len(by_name), np.int64)
    name[by_name] = np.arange(len(by_name))
    known, starts = name[encoded.indices.to_numpy()], np.cumsum([0, *map(len, terms)])
    code = np.concatenate([known[c + s] for c, s in zip(codes, starts)])
    doc, tf, places = np.concatenate(doc), np.concatenate(tf), np.concatenate(places)
    order = np.argsort((code * len(parts) + field) * len(docs) + rank[doc])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf)].astype(np.int32)), pa.array(places))
    code, field, doc, tf = code[order], field[order], doc[order], tf[order]
    names = encoded.dictionary.take(pa.array(by_name))
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    def batch(term: pa.Array, i: np.ndarray, at: np.ndarray, tf: np.ndarray, positions: pa.Array, signature: pa.Array) -> pa.RecordBatch:
        block, key = (one(docs.column(c).take(pa.array(at))) for c in ("block", "key"))
        columns = [fields.take(pa.array(i)), term, block, key, pa.array(lengths[i, at]), pa.array(tf), positions, signature]
        return _marked(pa.RecordBatch.from_arrays(columns, names=NAMES), means)

    for i in range(len(parts)):
        for j in range(0, len(in_order), OUT):
            at = in_order[j : j + OUT]
            n = len(at)
            yield batch(pa.array([WHOLE] * n, pa.string()), np.full(n, i), at, np.zeros(n, np.int32), pa.array([[]] * n, pa.list_(pa.int32())), one(docs.column("signature").take(pa.array(at))))
    for j in range(0, len(order), OUT):
        now = slice(j, j + OUT)
        yield batch(names.take(pa.array(code[now])), field[now], doc[now], tf[now], positions.take(pa.array(order[now])), pa.nulls(len(order[now]), pa.binary()))


def _marked(batch: pa.RecordBatch, means: dict[str, float]) -> pa.RecordBatch:
    """Postings in stored order with n and mean, and if n is over one most, least and impact, of its block's
    postings of the term at the first of them, else null. A block that lies in two batches has them in each; readers add up n and
    take the best bound."""
    rows = len(batch)
    group = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("field", "term")] + [batch.column("block").to_numpy()]
    new = np.flatnonzero(np.r_[rows > 0, np.any([g[1:] != g[:-1] for g in group], axis=0)][:rows])
    tf, length = batch.column("tf").to_numpy(), batch.column("length").to_numpy()
    field = batch.column("field").dictionary_encode()
    mean = np.array([means[f] or 1.0 for f in field.dictionary.to_pylist()])[field.indices.to_numpy()] if rows else np.zeros(0)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    count = np.diff(np.append(new, rows))
    own = tf[new] > 0  # not of rows of documents

    def at_first(values: np.ndarray, kind: pa.DataType, where: np.ndarray) -> pa.Array:
        whole, without = np.zeros(rows, values.dtype), np.ones(rows, bool)
        whole[new], without[new[where]] = values, False
        return pa.array(whole, kind, mask=without)

    of = lambda how, values: how.reduceat(values, new) if rows else values
    several = own & (count > 1)
    more = [(count, pa.int64(), own), (of(np.maximum, tf), pa.int32(), several), (of(np.minimum, length), pa.int32(), several), (of(np.maximum, impact), pa.float64(), several), (mean[new], pa.float64(), own)]
    return pa.RecordBatch.from_arrays([*batch.columns, *[at_first(*m) for m in more]], names=[*NAMES, *MARKS])


def _pieces(batch: pa.RecordBatch, fields: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about HELD bytes of texts, one longer text aside."""
    size = sum(pc.binary_length(batch.column(f"t{i}")).to_numpy().astype(np.int64) for i in range(fields))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // HELD)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _tasks(spark: SparkSession, size: int, each: int) -> int:
    """Tasks that take about `each` of a size; all cores have one."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def _signature(fields: list[str]) -> Column:
    """Of a row's fields; a null and an empty text are told apart by none of the scores."""
    return F.unhex(F.sha2(F.to_json(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])), 256))


def _segment(spark: SparkSession, make: Callable[[], DataFrame], root: str) -> dict:
    """Write the postings that are made, and their summary from what they have of it: without a shuffle or
    Python. What was written to make them goes first."""
    with temporary_tables(spark), _batches(spark, 1000), unshuffled(spark):  # 1,000 texts
        name = write_kept(make(), root, "postings", **{"parquet.page.row.count.limit": PAGE})
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    whole = {"most": F.coalesce("most", "tf"), "least": F.coalesce("least", "length"), "impact": F.coalesce("impact", part)}
    marked = spark.read.schema(f"{SUMMARY}, tf int, length int").parquet(f"{root}/{name}").filter("n IS NOT NULL")
    marked = marked.withColumns(whole).select("field", "term", "block", *MARKS)
    return {"postings": name, "summary": write_kept(marked, root, "summary")}


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written within."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def _opened(spark: SparkSession, root: str, manifest: dict, key: str, fields: list[str], analyzer: Analyzer) -> TextIndex:
    def united(what: str) -> DataFrame:
        read = [spark.read.schema(manifest["schemas"][what]).parquet(f"{root}/{s[what]}").withColumn("segment", F.lit(s["number"])) for s in manifest["segments"]]
        return reduce(DataFrame.unionByName, read)

    dead = [spark.read.schema(manifest["schemas"]["dead"]).parquet(f"{root}/{d}") for d in manifest["dead"]]
    means = {f: manifest["totals"].get(f, 0) / max(1, manifest["rows"]) for f in fields}
    return TextIndex(key, tuple(fields), analyzer, united("postings"), united("summary"), reduce(DataFrame.unionByName, dead) if dead else None, manifest["rows"], means)


def refresh(df: DataFrame, root: str, key: str, fields: list[str], analyzer: Analyzer = TEXT, state: str | None = None) -> TextIndex:
    """The index of a frame whose keys are unique and not null, kept at a root, brought up to date.

    state: names the state of the frame's source; while it is the one of the last time, the frame
    is not looked at. Null texts count as empty.
    """
    spark = df.sparkSession
    old = read_manifest(spark, root)
    if old and not _named(old) <= set(folders(spark, root)):
        old = None  # somebody deleted tables: begin anew
    if old and state is not None and old["state"] == state:
        return _opened(spark, root, old, key, fields, analyzer)
    if old is None:
        n = df.count()
        first = {"state": state, "segments": [], "dead": [], "next": 1, "blocks": max(1, n // BLOCK), "version": (read_manifest(spark, root) or {}).get("version", 0)}
        return _opened(spark, root, _added(df, root, first, key, fields, analyzer), key, fields, analyzer)
    index = _opened(spark, root, old, key, fields, analyzer)
    known = index._live(index.postings.filter((F.col("term") == WHOLE) & (F.col("field") == fields[0]))).select("segment", "key", F.col("signature").alias("was"))
    now = df.select(F.col(key).alias("key"), _signature(fields).alias("now"))
    differs = known.join(now, "key", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    differs = stored(differs.select("key", "segment", F.col("now").isNotNull().alias("more")), "index-changes")
    gone, more = differs.agg(F.count("segment"), F.count_if("more")).first()
    manifest = old | {"state": state}
    if gone:
        dead = differs.filter("segment IS NOT NULL").select("segment", "key")
        manifest["dead"] = [*old["dead"], write_kept(dead, root, "dead")]
        manifest["schemas"] = old["schemas"] | {"dead": _ddl(dead)}
    if more:
        changed = differs.filter("more").select(F.col("key").alias(key))
        manifest = _added(df.join(changed, key, "left_semi"), root, manifest, key, fields, analyzer, gone)
    elif gone or state != old["state"]:
        manifest = _counted(spark, root, manifest, key, fields, analyzer) if gone else write_manifest(spark, root, manifest)
    index = _opened(spark, root, manifest, key, fields, analyzer)
    lost = sum(spark.read.schema(manifest["schemas"]["dead"]).parquet(f"{root}/{d}").count() for d in manifest["dead"])
    if len(manifest["segments"]) > MOST or lost > DEAD * max(1, manifest["rows"]):
        return merge(index, root)
    return index


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _added(df: DataFrame, root: str, manifest: dict, key: str, fields: list[str], analyzer: Analyzer, gone: int = 0) -> dict:
    """A manifest with a further segment, of a frame's rows, in force."""
    spark = df.sparkSession
    segment = _segment(spark, lambda: _postings(df, key, fields, analyzer, manifest["blocks"]), root) | {"number": manifest["next"]}
    schemas = {"postings": POSTINGS.format(dict(df.dtypes)[key]), "summary": SUMMARY}
    manifest = manifest | {"segments": [*manifest["segments"], segment], "next": manifest["next"] + 1, "schemas": manifest.get("schemas", {}) | schemas}
    return _counted(spark, root, manifest, key, fields, analyzer)


def _counted(spark: SparkSession, root: str, manifest: dict, key: str, fields: list[str], analyzer: Analyzer) -> dict:
    """Put a manifest in force with rows and lengths of what it names: one pass over a row for each text."""
    index = _opened(spark, root, manifest | {"rows": 0, "totals": {}}, key, fields, analyzer)
    of = index._live(index.postings.filter(F.col("term") == WHOLE)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).collect()
    rows = max((r["n"] for r in of), default=0)
    return write_manifest(spark, root, manifest | {"rows": rows, "totals": {r["field"]: r["total"] for r in of}})


def _named(manifest: dict) -> set[str]:
    return {*manifest["dead"], *[s[w] for s in manifest["segments"] for w in ("postings", "summary")]}


def merge(index: TextIndex, root: str) -> TextIndex:
    """All segments as one, without what is dead; reads postings, no texts. The tables that no manifest
    in force names any more stay for searches that still read them, until vacuum()."""
    spark = index.postings.sparkSession
    old = read_manifest(spark, root)
    blocks = max(1, old["rows"] // BLOCK)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    postings = index._live(index.postings).select("field", "term", block, "key", "length", "tf", "positions", "signature")
    ordered = postings.repartition(_tasks(spark, index.postings.count(), MERGED), "block").sortWithinPartitions(*ORDER)
    of = postings.filter(F.col("term") == WHOLE).groupBy("field").agg(F.avg("length").alias("mean")).collect()  # one row a field
    means = {r["field"]: r["mean"] for r in of}
    marked = ordered.mapInArrow(lambda batches: (_marked(b, means) for b in batches if len(b)), f"{_ddl(ordered)}, {BLOCKS}")
    segment = _segment(spark, lambda: marked, root) | {"number": old["next"]}
    manifest = old | {"segments": [segment], "dead": [], "next": old["next"] + 1, "blocks": blocks}
    return _opened(spark, root, _counted(spark, root, manifest, index.key, list(index.fields), index.analyzer), index.key, list(index.fields), index.analyzer)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the tables of a root that its manifest in force does not name; their names."""
    manifest = read_manifest(spark, root)
    named = _named(manifest) if manifest else set()
    gone = sorted(set(folders(spark, root)) - named)
    if gone:
        drop_kept(spark, root, *gone)
    return gone


def build_index(df: DataFrame, key: str, fields: list[str], analyzer: Analyzer = TEXT) -> TextIndex:
    """The index of a frame that is not kept: one segment in this application's scratch folder."""
    return refresh(df, f"{scratch_root(df.sparkSession)}/index-{uuid.uuid4().hex}", key, fields, analyzer)
