"""Packing by concatenate and cut.

First pass: each partition tokenises its documents, adds the end token, and writes the ids with
their start within the partition. Prefix sums over the partitions' token totals (one row for
each input split) give every partition its global offset. Second pass: a document's global
start says where the fixed windows cut it; a piece that a window boundary ends is a record of
its own. Every sequence but the last is full, so padding is less than one sequence in all.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, small_batches, stored

SEQUENCE, END_ID = 2048, 1
CACHED_WORDS = 1_000_000
TAIL = re.compile(rb"(?<=[a-z])[.,;:!?|&%$*#]+(?=\s|\Z)")


class WordEncoder:
    """Ids of whole texts, put together from those of their words.

    For tokenizers that drop white space and never look across it: texts are cut at
    [\\x20\\x09-\\x0D] only, and other white space stays within a word for the tokenizer itself.
    Words are encoded once while the caches hold them; the caches are bounded.
    """

    def __init__(self, path: str, special_as_text: bool = False, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cached = cached
        self.cache: dict[bytes, bytes] = {}
        marks = [] if special_as_text else sorted((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark, self.mark_id = (marks[0][0].encode(), marks[0][1]) if marks else (b"", -1)
        sample = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Abc", "abc", ".,", "abc.,")]
        self.splits = sample[0] == sample[1] and sample[1] + sample[2] == sample[3]

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words: as one text with a special token between them, which costs far less than
        a call for each; words that could hold that token themselves go one by one."""
        mark = self.mark
        plain = [w for w in words if mark not in w] if mark else []
        out = {}
        if plain:
            text = (b" " + mark + b" ").join(plain).decode()
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            out = {w: part.tobytes() for w, part in zip(plain, self._between(ids), strict=True)}
        for w in words:
            if w not in out:
                ids = self.tokenizer.encode(w.decode(), add_special_tokens=False).ids
                out[w] = np.asarray(ids, self.dtype).tobytes()
        return out

    def _between(self, ids: np.ndarray) -> list[np.ndarray]:
        stops = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
        begins = [0, *[x + 1 for x in stops[:-1]]]
        return [ids[a:b] for a, b in zip(begins, stops)]

    def _words(self, text: bytes) -> list[bytes]:
        """Words in lower case, ASCII punctuation after an ASCII letter at a word's end apart from it:
        the tokenizer makes the same cut."""
        if not self.splits or (self.mark and self.mark in text):
            return text.split()
        return TAIL.sub(rb" \g<0>", text.lower()).split()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of little-endian unsigned numbers."""
        cache = self.cache
        known = cache.get
        out, again, missing = [], [], {}
        for i, text in enumerate(texts):
            words = self._words(text)
            parts = list(map(known, words))
            try:
                out.append(b"".join(parts))
            except TypeError:  # None where a word is new
                holes = [k for k, p in enumerate(parts) if p is None]
                new = [words[k] for k in holes]
                missing.update(dict.fromkeys(new))
                again.append((i, parts, holes, new))
                out.append(b"")
        if again:
            fresh = self._new(list(missing))
            for i, parts, holes, new in again:
                for k, w in zip(holes, new):
                    parts[k] = fresh[w]
                out[i] = b"".join(parts)
            cache.update(fresh)
            if len(cache) > self.cached:
                for w in list(cache)[: len(cache) - self.cached // 2]:
                    del cache[w]
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, special_as_text: bool) -> WordEncoder:
    """One for each Python worker: its caches stay warm from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, special_as_text)


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int | None, special_as_text: bool = False) -> DataFrame:
    """One row for each document: id, part, start (within the part), n, ids (bytes), wide."""
    small_batches(docs.sparkSession)
    source = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, special_as_text)
        end = b"" if end_id is None else np.asarray([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in encoder.encode_all(batch.column("text").to_pylist())]
            n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), width > 2))],
                names=["id", "part", "start", "n", "ids", "wide"],
            )

    return source.mapInArrow(run, f"id {id_type}, part int, start bigint, n bigint, ids binary, wide boolean")


def _cutter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            n = batch.column("n").to_numpy()
            count = np.where(n > 0, (first + n - 1) // length - first // length + 1, 0)
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = first[row] // length + nth
            begin = np.maximum(first[row], sequence * length)
            stop = np.minimum(first[row] + n[row], (sequence + 1) * length)
            ids, wide = batch.column("ids"), batch.column("wide")
            pieces = []
            for r, a, b in zip(row.tolist(), (begin - first[row]).tolist(), (stop - first[row]).tolist()):
                if wide[r].as_py():
                    pieces.append(ids[r].as_buffer()[4 * a : 4 * b].to_pybytes())
                else:
                    pieces.append(np.frombuffer(ids[r].as_buffer(), "<u2", b - a, 2 * a).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(begin - first[row]), pa.array(stop - begin), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length), pa.array(pieces, pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = SEQUENCE,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_as_text: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds the piece's tokens as little-endian unsigned 32-bit numbers. A null text counts as
    empty; an empty document is its end token alone, or no piece without end_id. Texts of any
    length are cut as often as needed. Repeated rows and null identifiers are documents of their
    own. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tokens = stored(tokenise(docs, tokenizer_path, id_col, text_col, end_id, special_as_text), "tokens")
    id_type = tokens.schema["id"].dataType.simpleString()
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each input split.
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), "part").select("id", (F.col("offset") + F.col("start")).alias("first"), "n", "ids", "wide")
    small_batches(spark)
    out = placed.mapInArrow(_cutter(length), f"id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The training sequences of pack(): sequence_id, ids (array of `length` ids), n_tokens before padding.

    A sequence gathers at most `length` pieces.
    """
    small_batches(pieces.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                sizes.append(len(ids))
                rows.append(np.pad(ids, (0, length - len(ids)), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["sequence_id", "ids", "n_tokens"])

    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(run, "sequence_id bigint, ids array<int>, n_tokens bigint")
