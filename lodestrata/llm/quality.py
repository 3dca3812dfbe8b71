"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The votes are
counted by pattern over all documents (at most 3 ** labellers patterns, whatever the corpus),
and expectation-maximisation over the patterns estimates each labeller's accuracy and the share
of good documents, without any true label. The posterior of a document's votes is its soft label
for a linear scorer over hashed word shapes, fitted on a sample of about `sample` documents.
The scorer then judges every document by its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, schema_with, small_batches, unpack, whole_row

FEATURES = 1024
SAMPLE = 10_000
#: Below one half: a rejected document is lost for good, so doubt keeps it.
KEEP = 0.35

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    w.encode()
    for w in "the and of to in is it that for with as was on be by are this at from a he not or have an but "
    "le la les de des et un une en est que qui dans pour sur pas au du ce il elle avec ne "
    "der die das und ist in zu den mit von ein eine nicht auf für im dem sich auch "
    "el los las y es por para con una se del al lo su no como más".split()
)
LOWER, UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHAPE = bytes.maketrans(LOWER + UPPER + b"0123456789" + bytes(range(128, 256)), b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 128)
SYMBOLS = frozenset(b"%$&*#@^~<>{}\\=+_`")


def shapes(text: bytes) -> list[bytes]:
    """Words with each run of small letters, capitals or digits as one sign."""
    s = text.translate(SHAPE)
    for c in (b"a", b"A", b"0"):
        while c + c in s:
            s = s.replace(c * 8, c).replace(c + c, c)
    return s.split()


@dataclass
class Facts:
    """What the labellers look at; shares are of words."""

    words: int
    capital: float
    symbol: float
    bars: float
    shouted: float
    stop: float
    plain: float
    distinct: float
    mean_length: float
    ended: float
    digits: float
    repeated: float
    lines: int
    distinct_lines: float


def facts_of(text: bytes, shape: list[bytes]) -> Facts:
    words = text.lower().split()
    n = max(1, len(words))
    count = Counter(shape)
    part = lambda test: sum(k for s, k in count.items() if test(s)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return Facts(
        len(words),
        part(lambda s: s[:1] == b"A" and b"a" not in s and s != b"A"),
        part(lambda s: any(c in SYMBOLS for c in s)),
        part(lambda s: s == b"|"),
        part(lambda s: s.endswith(b"!!")),
        sum(w in STOP_WORDS for w in words) / n,
        part(lambda s: s.rstrip(b".,;:?!").strip(b"'\"()-") in (b"a", b"Aa", b"A")),
        len(set(words)) / n,
        sum(map(len, words)) / n,
        part(lambda s: s[-1:] in (b".", b"?", b"!") and s[-2:] != b"!!"),
        part(lambda s: b"0" in s),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(lines),
        len(set(lines)) / max(1, len(lines)),
    )


def _vote(good: bool, bad: bool) -> int:
    return 1 if good and not bad else (-1 if bad else 0)


LABELLERS = {
    "capitals": lambda f: _vote(f.capital < 0.05, f.capital > 0.3),
    "symbols": lambda f: _vote(f.symbol < 0.02, f.symbol > 0.2),
    "bars": lambda f: _vote(False, f.bars > 0.1),
    "shouting": lambda f: _vote(False, f.shouted > 0.1),
    "stop_words": lambda f: 0 if f.words < 15 else _vote(f.stop > 0.06, f.stop < 0.01),
    "plain_words": lambda f: _vote(f.plain > 0.9, f.plain < 0.6),
    "distinct_words": lambda f: 0 if f.words < 50 else _vote(f.distinct > 0.3, f.distinct < 0.15),
    "word_length": lambda f: 0 if f.words < 10 else _vote(3 <= f.mean_length <= 9, f.mean_length < 2 or f.mean_length > 15),
    "sentence_ends": lambda f: 0 if f.words < 30 else _vote(f.ended > 0.02, f.ended == 0),
    "digits": lambda f: _vote(False, f.digits > 0.3),
    "repeated_words": lambda f: 0 if f.words < 10 else _vote(f.repeated < 0.1, f.repeated > 0.3),
    "lines": lambda f: 0 if f.lines < 5 else _vote(f.distinct_lines > 0.9, f.distinct_lines < 0.4),
}


def votes_of(facts: Facts) -> tuple[int, ...]:
    """One vote of each labeller: 1 good, -1 bad, 0 none. A text without words has no votes."""
    return tuple(f(facts) for f in LABELLERS.values()) if facts.words else (0,) * len(LABELLERS)


def features_of(shape: list[bytes], facts: Facts) -> np.ndarray:
    """Shares of hashed shapes and of pairs of neighbouring shapes, hashed tenths of the facts that
    are shares, and a constant in place 0."""
    out = np.zeros(FEATURES, np.float32)
    out[0] = 1
    if shape:
        for s, k in Counter(shape).items():
            out[1 + zlib.crc32(s) % (FEATURES - 1)] += k / len(shape)
        for (a, b), k in Counter(zip(shape, shape[1:])).items():
            out[1 + zlib.crc32(a + b" " + b) % (FEATURES - 1)] += k / len(shape)
        long = b"long" if facts.words >= 50 else b"short"
        for name in ("capital", "symbol", "bars", "shouted", "stop", "plain", "distinct", "ended", "digits", "repeated", "distinct_lines"):
            tenth = int(10 * getattr(facts, name))
            out[1 + zlib.crc32(b"%s %s %d" % (long, name.encode(), tenth)) % (FEATURES - 1)] += 0.3
    return out


def described(text: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    shape = shapes(text)
    facts = facts_of(text, shape)
    return votes_of(facts), features_of(shape, facts)


@dataclass
class LabelModel:
    """good: prior share; table[j, y, v + 1]: chance that labeller j, if it votes, votes v when the
    class is y (1 good). A labeller without a vote says nothing of a document."""

    good: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        logs = [np.log(p) + np.where(votes != 0, np.log(self.table[j, y, votes + 1]), 0).sum(1) for y, p in ((0, 1 - self.good), (1, self.good))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller that votes is right."""
        t, g = self.table, self.good
        right = g * t[:, 1, 2] + (1 - g) * t[:, 0, 0]
        cast = g * (t[:, 1, 2] + t[:, 1, 0]) + (1 - g) * (t[:, 0, 0] + t[:, 0, 2])
        return dict(zip(LABELLERS, (right / cast).tolist()))


def fit_labels(votes: np.ndarray, times: np.ndarray, rounds: int = 100, prior: float = 1.0) -> LabelModel:
    """EM from a start in which a vote for bad weighs as much as three for good; prior smooths all tables."""
    for_, against = (votes > 0).sum(1), (votes < 0).sum(1)
    q = 1 / (1 + np.exp(-(for_ - 3.0 * against)))
    model = None
    for _ in range(rounds):
        table = np.zeros((votes.shape[1], 2, 3))
        for y, w in ((0, times * (1 - q)), (1, times * q)):
            for v in (-1, 1):
                table[:, y, v + 1] = ((votes == v) * w[:, None]).sum(0) + prior
            table[:, y, 1] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, 1] = 1
        good = float(np.clip(((times * q).sum() + prior) / (times.sum() + 2 * prior), 1e-6, 1 - 1e-6))
        model = LabelModel(good, table)
        new = model.posterior(votes)
        done = not len(q) or np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return model


def fit_scorer(x: np.ndarray, q: np.ndarray, times: np.ndarray, steps: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels q (chance of good) of rows that occur so many times, by
    Adam on the whole sample; the two classes weigh the same."""
    mass = np.array([(times * (1 - q)).sum(), (times * q).sum()])
    weigh = np.where(mass > 0, 0.5 / np.maximum(mass, 1e-9), 0)
    up, down = (weigh[1] * times * q).astype(np.float32), (weigh[0] * times * (1 - q)).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((up + down) * p - up) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w = w.astype(np.float32)
    return w


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior chance of good by votes, and the scorer's; of a text without words zero."""
        if not texts:
            return np.zeros(0), np.zeros(0)
        each = [described(t) for t in texts]
        votes, x = np.array([a for a, _ in each], np.int64), np.stack([b for _, b in each])
        p = 1 / (1 + np.exp(-np.clip((x @ self.weights).astype(float), -30, 30)))
        worded = x[:, 1:].any(1)
        return np.where(worded, self.labels.posterior(votes), 0.0), np.where(worded, p, 0.0)


def _texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *more)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Label model over all documents, scorer on about `sample` of them, taken by a hash of the row.

    Repeated rows of the sample are one with their number as its weight, so however often a row is
    repeated, about `sample` rows at most reach the driver."""
    small_batches(docs.sparkSession)
    source = _texts(docs, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            seen.update(bytes(v + 1 for v in votes_of(facts_of(t, shapes(t)))) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    patterns = source.select("text").mapInArrow(vote, "votes binary, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not patterns:
        return Classifier(fit_labels(np.zeros((0, len(LABELLERS)), np.int64), np.zeros(0)), np.zeros(FEATURES))
    patterns.sort(key=lambda r: bytes(r["votes"]))
    votes = np.array([list(r["votes"]) for r in patterns], np.int64) - 1
    times = np.array([r["n"] for r in patterns], float)
    labels = fit_labels(votes, times)
    share = min(1.0, sample / times.sum())
    chosen = source if share == 1 else source.filter(F.pmod(F.xxhash64("id", F.crc32("text")), F.lit(1 << 30)) < int(share * (1 << 30)))

    chosen = chosen.groupBy("id", "text").agg(F.count(F.lit(1)).alias("times"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            each = [described(t) for t in texts]
            v = np.array([a for a, _ in each], np.int64).reshape(len(texts), len(LABELLERS))
            x = [b.astype(np.float16).tobytes() for _, b in each]
            yield pa.RecordBatch.from_arrays([pa.array(labels.posterior(v)), pa.array(x, pa.binary()), batch.column("times")], names=["q", "x", "times"])

    rows = chosen.mapInArrow(describe, "q double, x binary, times bigint").collect()
    rows.sort(key=lambda r: (r["q"], bytes(r["x"]), r["times"]))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    return Classifier(labels, fit_scorer(x, np.array([r["q"] for r in rows]), np.array([r["times"] for r in rows], float)))


def _scored(source: DataFrame, model: Classifier, carried: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, quality = model.judge(batch.column("text").to_pylist())
            columns = [*[batch.column(c) for c in carried], pa.array(weak), pa.array(quality)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "weak_label", "quality"])

    return source.mapInArrow(run, schema_with(source, carried, "weak_label double, quality double"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP, sample: int = SAMPLE, model: Classifier | None = None) -> DataFrame:
    """For each row: id, weak_label (posterior chance of good by votes), quality (the scorer's
    chance of good), kept (quality at or above the threshold).

    A null text, or one without words, has quality zero and is not kept. Texts of any length are
    judged whole; equal texts are judged alike; null identifiers are carried. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    model = model or fit(docs, id_col, text_col, sample)
    out = _scored(_texts(docs, id_col, text_col), model, ["id"])
    return out.select(F.col("id").alias(id_col), "weak_label", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP, sample: int = SAMPLE, model: Classifier | None = None) -> DataFrame:
    """The rows that classify() keeps, with all their columns."""
    model = model or fit(docs, id_col, text_col, sample)
    out = _scored(_texts(docs, id_col, text_col, whole_row(docs).alias("row")), model, ["row"])
    return out.filter(F.col("quality") >= threshold).select(*unpack("row", docs.columns))
