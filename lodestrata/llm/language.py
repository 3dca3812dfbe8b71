"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass: each task counts the hashed n-grams of its texts by language in a dense
array and hands on the cells above zero, which Spark sums. The smoothed log-probability matrix,
a row of `features` numbers for each language, is broadcast in blocks of at most `BLOCK`
languages, so its size is bounded however many labels there are; a text's scores are the sums
of the matrix over its n-grams, taken for a whole batch of texts at once.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, small_batches, stored
from lodestrata.llm.lm import held_out

FEATURES = 1 << 15
ORDERS = 3
#: Languages of one broadcast block: 64 x 32768 numbers of 8 bytes are 16 MB.
BLOCK = 64
SMOOTHING = 0.1
UNKNOWN = "und"
#: Code points that one step of a batch works on.
STEP = 1 << 18
SPACE = 32
# Multipliers of the n-gram hash, one for each place, and the one that mixes the sum.
PLACES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
MIX = 0x27D4EB2F


@functools.cache
def _folded() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter or mark, else a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def pieces(text: str) -> Iterator[np.ndarray]:
    """Folded code points of a text in pieces of bounded length, with one space for every run of
    anything but letters and one at the end. Each piece has the two code points before it (two
    spaces, at the start) in front, so that all n-grams that end in it are in it."""
    fold = _folded()
    before = np.array([SPACE, SPACE], np.uint32)
    for at in range(0, max(1, len(text)), STEP):
        x = fold[np.frombuffer(text[at : at + STEP].encode("utf-32-le", "surrogatepass"), "<u4")]
        x = np.concatenate([before[1:], x, [np.uint32(SPACE)]]) if at + STEP >= len(text) else np.concatenate([before[1:], x])
        gap = x == SPACE
        x = x[1:][~(gap[1:] & gap[:-1])]
        if len(x):
            x = np.concatenate([before, x])
            yield x
            before = x[-2:]


def hashed(x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Cells of the n-grams that end at each place of some pieces put together, one array for each
    order. The two code points before a piece end none: their cell is FEATURES, which stands for nothing."""
    out = []
    total = np.zeros(len(x), np.uint32)
    for n in range(ORDERS):
        part = x * np.uint32(PLACES[n])
        total[n:] += part[: len(x) - n]
        h = total + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(MIX)
        cell = (h >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.intp)
        cell[begin] = cell[begin + 1] = FEATURES
        out.append(cell)
    return out


def _steps(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows, begins and cells of as many pieces at a time as make about STEP code points."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        lengths = np.array([len(p) for p in parts])
        begin = np.cumsum(lengths) - lengths
        return np.array(rows), begin, hashed(np.concatenate(parts), begin)

    for i, t in enumerate(texts):
        for p in pieces(t):
            rows.append(i)
            parts.append(p)
            size += len(p)
            if size >= STEP:
                yield flush()
                rows, parts, size = [], [], 0
    if parts:
        yield flush()


def count_ngrams(training: DataFrame) -> DataFrame:
    """lang, cell, n of rows with text and lang; the cell -1 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                at = np.flatnonzero(counts)
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int8)), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(at - 1, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "cell", "n"])
            seen.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                counts = seen.setdefault(lang, np.zeros(FEATURES + 2, np.int64))
                counts[0] += len(own)
                for _, _, cells in _steps(own):
                    for cell in cells:
                        counts[1:] += np.bincount(cell, minlength=FEATURES + 1)
                counts[-1] = 0
                if len(seen) >= BLOCK:
                    yield from out()
        yield from out()

    return training.mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def _matrix(counts: DataFrame, langs: list[str], texts: int, all_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the cells, by language, with a column of zeros at the end; log priors."""
    place = {lang: i for i, lang in enumerate(langs)}
    n, prior = np.zeros((len(langs), FEATURES + 1)), np.zeros(len(langs))
    for r in counts.filter(F.col("lang").isin(langs)).toLocalIterator():
        if r["cell"] < 0:
            prior[place[r["lang"]]] = np.log((r["n"] + 1) / (texts + all_langs))
        else:
            n[place[r["lang"]], r["cell"]] = r["n"]
    logs = np.log(n + SMOOTHING) - np.log(n[:, :-1].sum(1, keepdims=True) + SMOOTHING * FEATURES)
    logs[:, -1] = 0
    return logs, prior


def _scored(rows: DataFrame, langs: list[str], logs: np.ndarray, prior: np.ndarray) -> DataFrame:
    """rows with best (log score), lang_pred and all (log of the sum of all scores) brought up to date
    with a block of languages."""
    table = rows.sparkSession.sparkContext.broadcast((langs, logs, prior))
    carried = ["id", "held_out", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = table.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = np.tile(prior[:, None], (1, len(texts)))
            at = [i for i, t in enumerate(texts) if t is not None]
            for row, begin, cells in _steps([texts[i] for i in at]):
                row = np.array(at)[row]
                for lang in range(len(langs)):
                    for cell in cells:
                        np.add.at(score[lang], row, np.add.reduceat(logs[lang].take(cell), begin))
            top, before = score.argmax(0) if len(texts) else np.zeros(0, int), np.array(batch.column("best"))
            best = score[top, np.arange(len(texts))]
            whole = np.logaddexp(np.array(batch.column("whole")), np.logaddexp.reduce(score, axis=0))
            # Languages come in order, so that of equal ones the first name stays.
            names = [langs[k] if b > a else old for k, a, b, old in zip(top.tolist(), before.tolist(), best.tolist(), batch.column("lang_pred").to_pylist())]
            more = [pa.array(np.maximum(before, best)), pa.array(whole), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *more], names=[*carried, "best", "whole", "lang_pred"])

    return rows.mapInArrow(run, rows.schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """For each row: id, held_out, lang_pred, score (the prediction's posterior, 0 to 1).

    Learns from rows with a text and a language whose crc32(id as text) mod folds is not fold;
    a prediction looks at the text alone. A null text, one without a letter, and any text if
    nothing was learned, is `und` with score 0. A null identifier counts as an empty one; repeated
    rows are counted, and predicted, each; of equal scores the first language in order is taken.
    Texts of any length are read whole, in pieces. An empty table gives an empty result. Other
    columns are ignored, whatever their names. With over BLOCK languages the texts are scored in
    as many passes of one plan as there are blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = held_out(col(id_col), folds, fold)
    text = col(text_col).cast("string")
    training = docs.filter(~out & text.isNotNull() & col(lang_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"), text.alias("text"))
    counts = stored(count_ngrams(training), "ngram-counts")
    learned = sorted((r["lang"], r["n"]) for r in counts.filter("cell < 0").select("lang", "n").collect())  # one row a language
    texts = sum(n for _, n in learned)
    # A text without letters goes to no worker.
    rows = docs.select(
        col(id_col).alias("id"), out.alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("text"),
        F.lit(float("-inf")).alias("best"), F.lit(float("-inf")).alias("whole"), F.lit(UNKNOWN).alias("lang_pred"),
    )
    names = [lang for lang, _ in learned]
    for i in range(0, len(names), BLOCK):
        block = names[i : i + BLOCK]
        rows = _scored(rows, block, *_matrix(counts, block, texts, len(names)))
    known = F.col("text").isNotNull() & F.lit(bool(names))
    return rows.select(
        F.col("id").alias(id_col),
        "held_out",
        F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.least(F.lit(1.0), F.exp(F.col("best") - F.col("whole")))).otherwise(0.0).alias("score"),
    )
