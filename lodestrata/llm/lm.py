"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Exact counts of all training tokens come first. The most frequent words are outcomes of the
neural model by themselves; all others fall into tail outcomes by a hash of their last bytes,
and within an outcome a word has its add-one share of the counts, with one place for words never
seen. The neural part predicts the outcome from the outcomes before it: position weights times
input vectors, summed, against output vectors, plus a bias. Replicas train on every partition's
tokens from a common warm start and are averaged by their numbers of tokens. Scoring normalises
over all outcomes by batched matrix products, so the probabilities of all words, the unseen
places included, sum to one.

What workers hold is bounded by parameters (outcomes, dimensions, FREQUENT words). Counts of the
remaining words stay distributed and are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, small_batches, stored

END = b""
HELD = 400_000  # distinct words that a counting task holds before it passes them on


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. suffix: bytes of a word that decide its tail outcome."""

    top: int = 256
    tail: int = 128
    dim: int = 16
    context: int = 4
    suffix: int = 2
    noise: int = 64
    batch: int = 2048
    rate: float = 0.1
    frequent: int = 100_000
    warm_tokens: int = 2_000_000
    seed: int = 7

    @property
    def outcomes(self) -> int:
        return self.top + self.tail


@dataclass
class Model:
    """Input vectors (one more for the place before a text), output vectors, position weights,
    biases, and the squared-gradient sums of each."""

    shape: Shape
    values: list[np.ndarray] = field(default_factory=list)
    squares: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def start(shape: Shape, log_share: np.ndarray) -> Model:
        rng = np.random.default_rng(shape.seed)
        c, d = shape.outcomes, shape.dim
        values = [
            (rng.normal(size=(c + 1, d)) * 0.1).astype("f4"),
            (rng.normal(size=(c, d)) * 0.1).astype("f4"),
            np.full((shape.context, d), 1 / shape.context, "f4"),
            log_share.astype("f4").copy(),
        ]
        return Model(shape, values, [np.full_like(v, 1e-2) for v in values])

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (*self.values, *self.squares)])

    def unpack(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for v in (*self.values, *self.squares):
            out.append(flat[at : at + v.size].reshape(v.shape).astype("f4"))
            at += v.size
        return Model(self.shape, out[: len(self.values)], out[len(self.values) :])

    def step(self, x: np.ndarray, y: np.ndarray, log_noise: np.ndarray, noise: np.ndarray) -> None:
        """One ascent step on the NCE objective; the noise words are shared by the batch."""
        inputs, outputs, places, bias = self.values
        by_place = places[:, None, :] * inputs
        predicted = by_place[0].take(x[:, 0], 0)
        for j in range(1, len(by_place)):
            predicted += by_place[j].take(x[:, j], 0)
        of_true, of_noise = outputs.take(y, 0), outputs[noise]
        shift = bias - log_noise - np.float32(np.log(len(noise)))
        true = np.einsum("bd,bd->b", predicted, of_true) + shift[y]
        down = predicted @ -of_noise.T
        down -= shift[noise]
        with np.errstate(over="ignore"):  # beyond exp's range the quotient is zero, as it should be
            up = 1 / (1 + np.exp(true))
            np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        back = down @ of_noise
        back += up[:, None] * of_true
        scale = np.float32(len(y) ** -0.5)
        # Outcomes that do not occur have no gradient, and so stay as they are.
        of_outputs = _summed(y, up[:, None] * predicted, len(bias)) + _summed(noise, (predicted.T @ down).T, len(bias))
        of_bias = np.bincount(y, up, len(bias)) + np.bincount(noise, np.ones(len(y), "f4") @ down, len(bias))
        self._move(1, of_outputs * scale)
        self._move(3, of_bias.astype("f4") * scale)
        # Sums by place and outcome give both other gradients: of the places and of the input vectors.
        sums = np.stack([_summed(x[:, j], back, len(inputs)) for j in range(len(places))])
        of_places = np.einsum("ncd,cd->nd", sums, inputs)
        self._move(0, np.einsum("ncd,nd->cd", sums, places) * scale)
        self._move(2, of_places / len(y), 0.1)

    def _move(self, i: int, grad: np.ndarray, slower: float = 1.0) -> None:
        self.squares[i] += grad * grad
        self.values[i] += np.float32(self.shape.rate * slower) * grad / np.sqrt(self.squares[i])

    def train(self, x: np.ndarray, y: np.ndarray, log_share: np.ndarray, rng: np.random.Generator) -> None:
        share = np.cumsum(np.exp(log_share))
        log_share = log_share.astype(np.float32)
        order = rng.permutation(len(y))
        x, y = x.T.astype(_index_type(self.shape)).take(order, 1).T, y[order]
        for at in range(0, len(y), self.shape.batch):
            rows = slice(at, at + self.shape.batch)
            noise = np.minimum(np.searchsorted(share, rng.random(self.shape.noise) * share[-1]), len(share) - 1)
            self.step(x[rows], y[rows], log_share, noise)

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, batch: int = 256) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of outcomes y after contexts x.

        The exponential of a score is a product over the places of a context, so exponentials are
        taken of a table of all outcomes for each place, not for each token. Tokens after the same
        outcome go together: its row of the table, with the biases, is multiplied in with the sum.
        The largest entry of each row is taken off, so that no factor is above one; the few tokens
        where no product of the factors stays far above zero get exponentials of their own.
        """
        inputs, outputs, places, bias = self.values
        tables = [(inputs * p) @ outputs.T for p in places]
        tables[0] += bias
        for t in tables:
            t -= t.max(1)[:, None]
        true = sum(t.ravel().take(x[:, j].astype(np.intp) * t.shape[1] + y) for j, t in enumerate(tables))
        nearest, *others = [np.exp(t) for t in tables]
        order = np.argsort(x[:, 0], kind="stable")
        places_of = [x[:, j].take(order) for j in range(1, len(tables))]
        ends = np.cumsum(np.bincount(x[:, 0], minlength=len(nearest))).tolist()
        total = np.empty(len(y))
        for row, a, z in zip(nearest, [0, *ends], ends):
            for at in range(a, z, batch):
                rows, each = slice(at, min(z, at + batch)), None
                for t, at_place in zip(others, places_of):
                    factor = t.take(at_place[rows], 0)
                    each = factor if each is None else np.multiply(each, factor, out=each)
                total[order[rows]] = row.sum() if each is None else each @ row
        far = np.flatnonzero(total < 1e-26)
        total[far] = 1
        out = true - np.log(total)
        out[far] = self._log_probabilities_far(tables, x[far], y[far])
        return out

    @staticmethod
    def _log_probabilities_far(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray, batch: int = 1024) -> np.ndarray:
        """The same by each token's own scores, their largest taken off."""
        out = np.empty(len(y))
        for at in range(0, len(y), batch):
            xs, ys = x[at : at + batch], y[at : at + batch]
            scores = sum(t[xs[:, j]] for j, t in enumerate(tables))
            scores -= scores.max(1)[:, None]
            out[at : at + batch] = scores[np.arange(len(ys)), ys] - np.log(np.exp(scores).sum(1))
        return out


def _index_type(shape: Shape) -> type:
    """The smallest type for a place and an outcome in one number: sixteen bits are sorted fastest."""
    return np.uint16 if shape.context * (shape.outcomes + 1) <= 1 << 16 else np.int64


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows for each number below n."""
    index = index.astype(np.intp)
    return np.stack([np.bincount(index, c, n) for c in rows.T.astype("f8", order="C")], 1, dtype="f4", casting="same_kind")


def _slices(texts: pa.Array, most: int = 16 << 20) -> Iterator[pa.Array]:
    """The texts in turn, about as many bytes at once as given, or one text that is longer."""
    part = np.cumsum(pc.binary_length(texts).to_numpy()) // most
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
    for a, z in zip([0, *ends], ends):
        if z > a:
            yield texts.slice(a, z - a)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (bytes), A-Z lower-cased, and the number of each text's words."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))
    offsets, words = parts.offsets.to_numpy(), parts.values
    # White space at either end of a text leaves an empty part there.
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[offsets[1:]] - before[offsets[:-1]]


def _bytes(words: pa.Array) -> pa.Array:
    return words.view(pa.large_binary()).cast(pa.binary()) if pa.types.is_large_string(words.type) else words.view(pa.binary())


class Lexicon:
    """Frequent words with their outcomes and counts; outcomes of all other words by hash."""

    def __init__(self, shape: Shape, words: list[bytes], counts: np.ndarray):
        self.shape = shape
        self.words = pa.array(words, pa.binary())
        self.outcome = np.concatenate([np.arange(len(words), dtype=np.uint16)[: shape.top], self.tails(self.words[shape.top :])])
        self.log_count = np.log10(counts + 1.0)

    def tails(self, words: pa.Array) -> np.ndarray:
        """The outcome of each word's last bytes."""
        suffix = pc.binary_slice(words, -self.shape.suffix).dictionary_encode()
        each = [self.shape.top + zlib.crc32(x) % self.shape.tail for x in suffix.dictionary.to_pylist()]
        return np.array(each, np.uint16)[suffix.indices.to_numpy()]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """For all tokens of the texts: place in the frequent list or -1, outcome, and number of the
        word; the words by number, and the number of tokens of each text. An end follows each
        text's words."""
        words, sizes = _words(texts)
        words = words.dictionary_encode()
        every = pa.concat_arrays([_bytes(words.dictionary), pa.array([END], pa.binary())])
        sizes = sizes + 1
        token = np.full(len(words) + len(sizes), len(every) - 1, np.int64)
        is_word = np.ones(len(token), bool)
        is_word[np.cumsum(sizes) - 1] = False
        token[is_word] = words.indices.to_numpy()
        place = pc.fill_null(pc.index_in(every, value_set=self.words), -1).to_numpy()
        outcome = self.tails(every)
        outcome[place >= 0] = self.outcome[place[place >= 0]]
        return place[token], outcome[token], token, every, sizes


def contexts(outcome: np.ndarray, sizes: np.ndarray, shape: Shape) -> np.ndarray:
    """The outcomes before each token, nearest first, none from another text."""
    out = np.full((shape.context, len(outcome)), shape.outcomes, _index_type(shape))
    begin = np.cumsum(sizes) - sizes
    for j in range(shape.context):
        out[j, j + 1 :] = outcome[: max(0, len(outcome) - j - 1)]
        for k in range(j + 1):
            out[j, begin[sizes > k] + k] = shape.outcomes
    return out.T


def _outcomes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes of all texts of a batch of encoded texts, and their numbers."""
    every = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.column("outcomes")]
    return np.concatenate(every) if every else np.zeros(0, np.uint16), np.array([len(v) for v in every], np.int64)


def held_out(id_column: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training: the CRC-32 of its identifier's text; null: of no text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def count_words(texts: DataFrame) -> DataFrame:
    """word (bytes; the end is empty), c: exact counts over the column text (bytes)."""

    def merged(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return pa.table({"word": found["word"], "c": found["c_sum"]}).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for texts in _slices(batch.column("text")):
                found = _words(texts)[0].value_counts()
                held.append(pa.table({"word": _bytes(found.field(0)), "c": found.field(1)}))
                held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(texts)], pa.int64())}))
                if sum(map(len, held)) > 2 * HELD:
                    held = [merged(held)]
                    if len(held[0]) > HELD:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from merged(held).to_batches()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _replicas(encoded: DataFrame, flat: np.ndarray, shape: Shape, log_share: np.ndarray) -> DataFrame:
    """One row for each partition that has tokens: n, values (n times its trained parameters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.start(shape, log_share).unpack(flat)
        rng = np.random.default_rng([shape.seed, TaskContext.get().partitionId()])
        n = 0
        for batch in batches:
            outcome, sizes = _outcomes(batch)
            model.train(contexts(outcome, sizes, shape), outcome, log_share, rng)
            n += len(outcome)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(model.pack().astype("f8") * n).tobytes()], pa.binary())], names=["n", "values"])

    return encoded.select("outcomes").mapInArrow(run, "n bigint, values binary")


def _averaged(replicas: DataFrame, model: Model, groups: int = 16) -> Model:
    """Weighted mean of the replicas: summed in a few tasks, then over those on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, v in zip(batch.column("n").to_pylist(), batch.column("values")):
                x = np.frombuffer(v.as_buffer(), "f8")
                n, total = n + k, x.copy() if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "values"])

    rows = replicas.repartition(groups).mapInArrow(run, "n bigint, values binary").collect()
    if not rows:
        return model
    total = sum(np.frombuffer(bytes(r["values"]), "f8") for r in rows)
    return model.unpack(total / sum(r["n"] for r in rows))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words (runs between [\\x20\\x09-\\x0D], A-Z lower-cased) and one end.
    Counts and training cover all documents that are not held out; a warm start before that takes
    about shape.warm_tokens of them. base_score is the add-one unigram log10 probability, score
    the model's. A null or empty text is its end alone. Repeated rows are scored, and counted,
    each. An empty table gives an empty result; without training documents every word is unseen.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shape = shape or Shape()
    source = docs.select(
        col(id_col).alias("id"),
        held_out(col(id_col)).alias("held_out"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    training = source.filter("NOT held_out")
    counts = stored(count_words(training.select("text")), "lm-counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    first = _most_frequent(counts, shape.frequent)
    lexicon = Lexicon(shape, [w for w, _ in first], np.array([c for _, c in first], np.int64))
    top = [w for w, _ in first[: shape.top]]
    share, kinds = np.zeros(shape.outcomes), np.zeros(shape.outcomes)
    for i, (_, c) in enumerate(first[: shape.top]):
        share[i], kinds[i] = c, 1
    suffix = F.substring("word", -shape.suffix, shape.suffix)
    tail = counts.filter(~F.col("word").isin(top)) if top else counts
    for r in tail.groupBy((F.crc32(suffix) % shape.tail).cast("int").alias("t")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        share[shape.top + r["t"]], kinds[shape.top + r["t"]] = r["c"], r["k"]
    del first
    words = spark.sparkContext.broadcast(lexicon)
    encoded = stored(_encoded(source, words, share, kinds, n, v), "lm-encoded")
    log_share = np.log((share + 1) / (share + 1).sum())
    model = Model.start(shape, log_share)
    training = encoded.filter("NOT held_out")
    part = min(1.0, shape.warm_tokens / max(1, n))
    warm = training if part == 1 else training.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(part * 1_000_000))
    # Rows are drawn and ordered by their numbers in the written table: repeated or null ids are drawn
    # each by itself, and a task that runs again sees the same order.
    warm = warm.select("row", "outcomes").repartition(1).sortWithinPartitions(F.xxhash64("row"))
    model = _averaged(_replicas(warm, model.pack(), shape, log_share), model, 1)
    model = _averaged(_replicas(training, model.pack(), shape, log_share), model)
    return _with_rare(_scored(encoded, model), encoded, counts, n).withColumnRenamed("id", id_col)


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most `most` words with their counts, the most frequent first: all words from that
    sixteenth of a power of two on from which they are so few. Nothing more reaches the driver."""
    step = F.floor(16 * F.log2("c")).cast("int")
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        total += k
        if total > most:
            break
        least = s
    if least is None:
        return []
    rows = [(bytes(r["word"]), r["c"]) for r in counts.filter(step >= least).collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0]))


def _encoded(source: DataFrame, lexicon, share: np.ndarray, kinds: np.ndarray, n: int, v: int) -> DataFrame:
    """Each text's outcomes, and all of its scores but the neural part and the counts of words
    outside the frequent list, which go along as rare."""
    shape = lexicon.value.shape
    base_scale = np.log10(n + v + 1)
    # A top word is its outcome; a tail word has its share of its outcome.
    scale = np.where(np.arange(shape.outcomes) < shape.top, 0.0, np.log10(share + kinds + 1))
    rows = source.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for whole in batches:
            at = 0
            for texts in _slices(whole.column("text")):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                place, outcome, token, every, sizes = words.read(texts)
                begin = np.cumsum(sizes) - sizes
                known = place >= 0
                log_count = np.zeros(len(place))
                log_count[known] = words.log_count[place[known]]
                inner = np.where(outcome < shape.top, 0.0, log_count) - scale[outcome]
                # Each text's words outside the frequent list, by the text and the word's number.
                rare, times = np.unique(np.repeat(np.arange(len(sizes)) * len(every), sizes)[~known] + token[~known], return_counts=True)
                pairs = pa.StructArray.from_arrays([every.take(pa.array(rare % len(every))), pa.array(times, pa.int64())], names=["word", "tf"])
                ends = np.searchsorted(rare, np.arange(len(sizes) + 1) * len(every))
                ids = pa.py_buffer(outcome.astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in ("row", "id", "held_out")], pa.array(sizes), pa.array(np.add.reduceat(known, begin, dtype=np.int64)),
                        pa.array(np.add.reduceat(log_count, begin) - sizes * base_scale), pa.array(np.add.reduceat(inner, begin)),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.append(begin, len(place)) * 2).astype(np.int32)), ids]),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "inner", "outcomes", "rare"],
                )

    schema = f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, inner double, outcomes binary, rare array<struct<word:binary,tf:bigint>>"
    return rows.mapInArrow(run, schema)


def _scored(encoded: DataFrame, model: Model) -> DataFrame:
    """The neural part added: row, id, held_out, n_tokens, n_known, base_score, score."""
    shape, flat = model.shape, model.pack()
    small_batches(encoded.sparkSession)
    columns = ["row", "id", "held_out", "n_tokens", "n_known", "base_score"]
    rows = encoded.select(*columns, "inner", "outcomes")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model.start(shape, np.zeros(shape.outcomes)).unpack(flat)
        for batch in batches:
            outcome, sizes = _outcomes(batch)
            logs = net.log_probabilities(contexts(outcome, sizes, shape), outcome)
            score = np.add.reduceat(logs, np.cumsum(sizes) - sizes) / np.log(10) if len(sizes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score + batch.column("inner").to_numpy())], names=[*columns, "score"])

    return rows.mapInArrow(run, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _with_rare(scored: DataFrame, encoded: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Add what the counts of rare words give; a word without a count adds nothing to either score."""
    pairs = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    found = pairs.join(counts, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("tf").alias("seen"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
