"""Benchmark decontamination with suffix arrays over the training texts.

Each Arrow batch of documents is a shard with a suffix array of its own: word suffixes sorted by
as many words as the longest window has. Only suffixes that can match are in it: those whose first
words, as many as the shortest test window, all occur in the test set. Every test suffix is looked
up in every shard by binary search, all different windows at once; the range of equal prefixes
gives a window's occurrences. A verbatim match of more words is a run of such occurrences, and its
end is found in an order of the whole test suffixes: the neighbours of a document's suffix there
have the most words in common with it. Memory grows with the words of the test set, not with the
length of its items. Nothing is shuffled; the test set is read in blocks of bounded size.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, schema_with, small_batches, stored, unpack, whole_row

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
BLOCK_BYTES = 16 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the words: letters a-z, digits and all that is not ASCII."""
    return WORD.findall(text.lower())


class TestSet:
    """The words of test items as numbers, one after the other with a zero after each item, their
    different windows, and, made at first use, the order of all their suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.window = window
        number = self.vocabulary.setdefault
        ids = [[number(w, len(self.vocabulary) + 1) for w in words_of(text)] for _, text in items]
        lengths = np.array([len(x) for x in ids], np.int64)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.words = np.array([w for x in ids for w in (*x, 0)], np.uint32)
        self.item = np.repeat(np.arange(len(ids)), lengths + 1)
        sizes = np.minimum(lengths, window)
        #: By window length: the different windows in order, and for each the items that have it.
        self.windows: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            at = np.concatenate([self.begin[i] + np.arange(lengths[i] - size + 1) for i in mine])
            keys, which = np.unique(self._keys(at, size), return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(ids) + self.item[at])
            bounds = np.searchsorted(pairs, np.arange(1, len(keys)) * len(ids))
            self.windows[size] = keys, np.split(pairs % len(ids), bounds)
        self.depth = max(self.windows, default=0)
        self.shortest = min(self.windows, default=0)

    def _keys(self, at: np.ndarray, size: int) -> np.ndarray:
        rows = np.empty((len(at), size), ">u4")
        for k in range(size):
            rows[:, k] = self.words[at + k]
        return rows.view(f"S{4 * size}").ravel()

    @functools.cached_property
    def order(self) -> np.ndarray:
        """The places of all words in the order of the suffixes that begin there, by doubling ranks."""
        n = len(self.words)
        rank = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank, kind="stable")
        step = 1
        while step < n:
            next_rank = np.zeros(n, np.int64)
            next_rank[: n - step] = rank[step:] + 1
            # No suffix is compared across the zero at its item's end.
            next_rank[np.minimum(self._left, n) <= step - 1] = 0
            key = rank * (n + 2) + next_rank
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if step > self._left.max(initial=0):
                break
        return order[self.words[order] > 0]

    @functools.cached_property
    def _left(self) -> np.ndarray:
        """How many words follow each place in its item, that place's own included."""
        zero = np.flatnonzero(self.words == 0)
        place = np.arange(len(self.words))
        return zero[np.searchsorted(zero, place)] - place if len(zero) else place

    def _common(self, text: np.ndarray, place: int) -> int:
        """How many words a text and the suffix at a place have in common."""
        done, chunk = 0, 16
        most = min(len(text), int(self._left[place]))
        while done < most:
            a, b = text[done : min(most, done + chunk)], self.words[place + done : place + min(most, done + chunk)]
            differ = np.flatnonzero(a != b)
            if len(differ):
                return done + int(differ[0])
            done += len(a)
            chunk *= 2
        return most

    def longest(self, text: np.ndarray) -> tuple[int, int, int]:
        """Words, item and first word there of the longest beginning of a text that an item holds; of
        several the first by the item's name, then by place."""
        order = self.order
        low, high, best, at = 0, len(order), 0, -1
        while low < high:
            mid = (low + high) // 2
            place = int(order[mid])
            k = self._common(text, place)
            if k > best:
                best, at = k, mid
            theirs, ours = (int(self.words[place + k]) if k < self._left[place] else 0), (int(text[k]) if k < len(text) else 0)
            low, high = (mid + 1, high) if theirs < ours else (low, mid)
        if not best:
            return 0, -1, -1
        first = last = at
        head = text[:best]
        while first > 0 and self._common(head, int(order[first - 1])) == best:
            first -= 1
        while last + 1 < len(order) and self._common(head, int(order[last + 1])) == best:
            last += 1
        found = ((self.names[self.item[p]], int(p - self.begin[self.item[p]]), int(self.item[p])) for p in order[first : last + 1].tolist())
        _, word, item = min(found)
        return best, item, word


class Shard:
    """Word numbers of some documents, 0 for words outside the test set and between documents."""

    def __init__(self, texts: list[bytes], test: TestSet):
        number = test.vocabulary.get
        parts, self.n_words = [], []
        for t in texts:
            words = words_of(t)
            self.n_words.append(len(words))
            parts.append(np.fromiter((number(w, 0) for w in words), np.uint32, len(words)))
            parts.append(np.zeros(1, np.uint32))
        depth = max(test.depth, 1)
        self.words = np.concatenate([*parts, np.zeros(depth, np.uint32)])
        self.begin = np.cumsum([0, *[n + 1 for n in self.n_words]])[:-1]
        # How many known words follow at each place.
        zero = np.flatnonzero(self.words == 0)
        place = np.arange(len(self.words) - depth)
        run = zero[np.searchsorted(zero, place)] - place
        self.places = place[run >= max(test.shortest, 1)]
        self.run = run[self.places]
        order = np.argsort(self._prefix(depth), kind="stable")
        self.places, self.run = self.places[order], self.run[order]

    def _prefix(self, depth: int) -> np.ndarray:
        """The first words as one fixed-width byte string, cut at the first unknown word."""
        rows = np.empty((len(self.places), depth), ">u4")
        for k in range(depth):
            rows[:, k] = np.where(self.run > k, self.words[self.places + k], 0)
        return rows.view(f"S{4 * depth}").ravel()

    def ranges(self, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of a length: the range of places whose words begin with it."""
        prefixes = self._prefix(size)
        return np.searchsorted(prefixes, keys, "left"), np.searchsorted(prefixes, keys, "right")

    def longest(self, doc: int, starts: list[tuple[int, int, int]], test: TestSet) -> tuple[int, str, int, int]:
        """Words, item, first word there and first word here of a document's longest verbatim match;
        of equally long ones the first here. starts: place, length and first item by name of each window
        found; a window of fewer words than the test set's is a whole item.

        No match that begins at a place is longer than the run of full windows from there on, so
        places whose run is too short are passed over."""
        begin, n = int(self.begin[doc]), self.n_words[doc]
        text = self.words[begin : begin + n]
        full = sorted({p for p, size, _ in starts if size == test.window})
        reach = dict.fromkeys(full, 0)
        for p in reversed(full):
            reach[p] = reach.get(p + 1, 0) + 1
        best: tuple[int, int, int, int] = (0, -1, -1, -1)
        for p, size, owner in sorted(starts):
            may = reach[p] + size - 1 if size == test.window else size
            if may > best[0]:
                words, item, word = test.longest(text[p - begin : p - begin + may]) if size == test.window else (size, owner, 0)
                if words > best[0]:
                    best = words, item, word, p - begin
        return best[0], test.names[best[1]], best[2], best[3]


MATCH = "struct<words:bigint,item:string,item_word:bigint,word:bigint>"


_built: dict[tuple[str, int], TestSet] = {}


def _test_set(block: str, items: Broadcast, window: int) -> TestSet:
    """A block's test set, built once in each worker, which keeps that of its last block."""
    if (block, window) not in _built:
        _built.clear()
        _built[block, window] = TestSet(items.value, window)
    return _built[block, window]


def _scan(block: str, items: Broadcast, window: int, longest: bool):
    """What one block of test items finds in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _test_set(block, items, window)
        for batch in batches:
            shard = Shard(batch.column("text").to_pylist(), test)
            change = np.zeros(len(shard.words) + 1, np.int64)
            of_doc: list[set[int]] = [set() for _ in shard.n_words]
            starts: list[list[tuple[int, int, int]]] = [[] for _ in shard.n_words]
            for size, (keys, owners) in test.windows.items():
                low, high = shard.ranges(keys, size)
                for w in np.flatnonzero(high > low).tolist():
                    places = shard.places[low[w] : high[w]]
                    change[places] += 1
                    change[places + size] -= 1
                    docs = np.searchsorted(shard.begin, places, "right") - 1
                    for d in np.unique(docs).tolist():
                        of_doc[d].update(owners[w].tolist())
                    if longest:
                        owner = min(owners[w].tolist(), key=lambda i: test.names[i])
                        for d, p in zip(docs.tolist(), places.tolist()):
                            starts[d].append((p, size, owner))
            hit = np.cumsum(change)[:-1] > 0
            marks = [np.packbits(hit[b : b + n]).tobytes() if o else b"" for b, n, o in zip(shard.begin, shard.n_words, of_doc)]
            names = [[test.names[i] for i in sorted(o)] for o in of_doc]
            columns = [batch.column("id"), pa.array(shard.n_words, pa.int64()), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string()))]
            labels = ["id", "n_words", "marks", "items"]
            if longest:
                found = [dict(zip(("words", "item", "item_word", "word"), shard.longest(d, s, test))) if s else None for d, s in enumerate(starts)]
                columns.append(pa.array(found, pa.struct([("words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64())])))
                labels.append("longest")
            if "row" in batch.schema.names:
                columns.append(batch.column("row"))
                labels.append("row")
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    return run


def _blocks(tests: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in blocks of at most `most` bytes (or one longer item), read by partition."""
    rows = tests.select(col(item_col).cast("string").alias("i"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((r["i"] if r["i"] is not None else "null", text))
        held += len(text)
    yield block


def find_overlap(
    docs: DataFrame,
    tests: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep_rows: bool = False,
    longest: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each row: id, n_words, n_hit, items (sorted array of item ids as strings), and with
    longest also longest: words, item, item_word and word of the longest verbatim match of a window
    or more (both places from zero; of equally long ones the first in the document, then by item
    and place there), null without one.

    A window is `window` consecutive words of an item, or all of a shorter one. A document word
    inside any occurrence of a window is hit. An item or document without words, a null text
    included, matches nothing. Items with equal texts are found alike; a null item id is named
    "null". Texts of any length are searched whole. Repeated rows are searched each. Empty
    tables are allowed on both sides. With keep_rows a struct of all columns is carried as row.

    Blocks of the test set beyond the first are searched by passes of their own over the
    documents, and joined by a number that each document row has in a written table. The driver
    holds one block at a time; workers get it by broadcast, of block_bytes or one longer item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary").alias("text")
    blocks = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in _blocks(tests, item_col, item_text_col, block_bytes)]
    if len(blocks) == 1:
        carried = [whole_row(docs).alias("row")] if keep_rows else []
        source = docs.select(col(id_col).alias("id"), text(col(text_col)), *carried)
        found = _pass(source, *blocks[0], window, longest)
    else:
        number = F.struct(F.monotonically_increasing_id().alias("n"), col(id_col).alias("id")).alias("id")
        numbered = stored(docs.select(number, whole_row(docs).alias("row") if keep_rows else text(col(text_col))), "numbered-documents")
        if keep_rows:
            numbered = numbered.select("id", text(F.col("row").getField(text_col)), "row")
        found = None
        for i, b in enumerate(blocks):
            one = _pass(numbered if i == 0 else numbered.drop("row"), *b, window, longest)
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        keep = [F.first("row", ignorenulls=True).alias("row")] if keep_rows else []
        better = F.struct("longest.words", -F.col("longest.word"))
        more = [F.max_by("longest", better).alias("longest")] if longest else []
        found = found.groupBy("id").agg(
            F.max("n_words").alias("n_words"), F.collect_list("marks").alias("each"), F.flatten(F.collect_list("items")).alias("items"), *more, *keep
        ).withColumn("id", F.col("id.id"))
        found = found.withColumn("marks", _any_mark(F.col("each"))).drop("each")
    hits = F.coalesce(_ones(F.col("marks")), F.lit(0)).cast("long")
    out = found.select(
        F.col("id").alias(id_col) if not keep_rows else F.col("id"),
        "n_words",
        hits.alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        *(["longest"] if longest else []),
        *(["row"] if keep_rows else []),
    )
    return out


def _pass(source: DataFrame, block: str, items: Broadcast, window: int, longest: bool) -> DataFrame:
    more = "n_words bigint, marks binary, items array<string>"
    more += f", longest {MATCH}" if longest else ""
    schema = schema_with(source, ["id"], more)
    schema = schema.add(source.schema["row"]) if "row" in source.columns else schema
    return source.mapInArrow(_scan(block, items, window, longest), schema)


def _ones(marks):
    """Bits set in a binary value."""
    digits = F.split(F.hex(marks), "")
    per = F.array(*[F.lit(bin(i).count("1")) for i in range(16)])
    count = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d == "", 0).otherwise(F.element_at(per, F.conv(d, 16, 10).cast("int") + 1)))
    return F.when(F.length(marks) > 0, count).otherwise(F.lit(0))


def _any_mark(each):
    """Bitwise or of binary values of one length; empty ones count as zeros."""

    @F.pandas_udf("binary")
    def union(s):
        import pandas as pd

        def one(values):
            values = [np.frombuffer(v, np.uint8) for v in values if len(v)]
            return np.bitwise_or.reduce(values).tobytes() if values else b""

        return pd.Series([one(v) for v in s])

    return union(each)


def overlap_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, a digest of the items, the verdict and the longest match where that was asked for, one
    row for each of find_overlap()."""
    match = {"words": "longest_words", "item": "longest_item", "item_word": "longest_item_word", "word": "longest_word"}
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *([F.col(f"longest.{c}").alias(name) for c, name in match.items()] if "longest" in found.columns else []),
    )


def drop_contaminated(docs: DataFrame, tests: DataFrame, **kw) -> DataFrame:
    """The rows without a hit word, with all their columns."""
    return find_overlap(docs, tests, keep_rows=True, **kw).filter("n_hit = 0").select(*unpack("row", docs.columns))
