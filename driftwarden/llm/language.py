"""Language of a text by a small convolutional network over its bytes.

A text is cut into windows of a fixed number of bytes. Each byte becomes a short vector; filters of several
widths run over a window, the largest answer of each filter is kept, and a softmax layer over these answers
gives a probability per language. A text's scores are the mean over all its windows of the logarithms of their probabilities,
weighted by how full a window is. The network is trained in numpy, in one task, on a bounded sample of labelled texts;
it is a few thousand numbers, and every window of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import fresh, map_batches, texts_bytes

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 16  # of each width
BYTE_SIZE = 8
# Labelled texts per language that the network is fitted on, at most about, and windows taken of each.
SAMPLE_TEXTS = 1500
SAMPLE_WINDOWS = 4
# Languages that are learned, the most frequent ones first.
LANGUAGES = 500
# Passes over the sample, more where these are fewer than STEPS batches.
EPOCHS = 6
STEPS = 500
BATCH = 64
RATE = 0.004
DECAY = 1e-4
# Windows that go through the network together.
TOGETHER = 64
UNKNOWN = "und"
LETTER = r"\p{L}"


def windows(raw: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW bytes; the last row is filled up with zeros."""
    rows = -(-len(raw) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(rows, WINDOW)


def sample_windows(raw: bytes, most: int = SAMPLE_WINDOWS) -> np.ndarray:
    """``most`` windows spread evenly over a text, or all."""
    count = -(-len(raw) // WINDOW)
    chosen = range(count) if count <= most else (i * count // most for i in range(most))
    return np.concatenate([windows(raw[i * WINDOW : (i + 1) * WINDOW]) for i in chosen]) if count else windows(b"")


def width_mask() -> np.ndarray:
    """Which of the places of the widest filter (first axis) each filter uses (second axis)."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.repeat(np.arange(max(WIDTHS)), BYTE_SIZE)[:, None] < widths[None, :]).astype(np.float32)


def largest(answers: np.ndarray) -> np.ndarray:
    """Maximum over the second axis, by halves: several times faster than max(1) on short last axes."""
    while answers.shape[1] > 1:
        half = answers.shape[1] // 2
        rest = answers[:, 2 * half :]
        answers = np.maximum(answers[:, :half], answers[:, half : 2 * half])
        if rest.shape[1]:
            answers[:, 0] = np.maximum(answers[:, 0], rest[:, 0])
    return answers[:, 0]


class Network:
    """Byte vectors, filters of several widths with biases, and a softmax layer over their largest answers.

    All filters lie in one matrix as wide as the widest; narrower ones are 0 beyond their width.
    """

    def __init__(self, names: list[str], weights: list[np.ndarray]):
        """``weights``: byte vectors (that of byte 0 is 0), filters, their biases, the layer, its biases."""
        self.names, self.weights = names, weights

    @classmethod
    def start(cls, names: list[str], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        vectors, mask = rng.normal(0, 0.5, (256, BYTE_SIZE)), width_mask()
        vectors[0] = 0  # what fills a window up says nothing
        filters = rng.normal(0, 1, mask.shape) * mask * (2 / mask.sum(0)) ** 0.5
        hidden = mask.shape[1]
        layer = rng.normal(0, (1 / hidden) ** 0.5, (hidden, len(names)))
        return cls(names, [w.astype(np.float32) for w in (vectors, filters, np.zeros(hidden), layer, np.zeros(len(names)))])

    def spans(self, rows: np.ndarray) -> np.ndarray:
        """(row, place, vectors of the bytes from there on)."""
        more = np.concatenate([rows, np.zeros((len(rows), max(WIDTHS) - 1), np.uint8)], 1)
        vectors = self.weights[0].take(more, axis=0)
        shape = (len(rows), WINDOW, max(WIDTHS) * BYTE_SIZE)
        return np.lib.stride_tricks.as_strided(vectors, shape, vectors.strides)

    def answers(self, spans: np.ndarray) -> np.ndarray:
        flat = spans.reshape(-1, spans.shape[2]) @ self.weights[1]
        return flat.reshape(len(spans), WINDOW, -1)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.names)), np.float32)
        for at in range(0, len(rows), TOGETHER):
            hidden = np.maximum(largest(self.answers(self.spans(rows[at : at + TOGETHER]))) + self.weights[2], 0)
            z = hidden @ self.weights[3] + self.weights[4]
            z -= z.max(1, keepdims=True)
            out[at : at + TOGETHER] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over the rows."""
        spans = self.spans(rows)
        answers = self.answers(spans)
        place, n = answers.argmax(1), np.arange(len(rows))[:, None]
        hidden = np.maximum(np.take_along_axis(answers, place[:, None], 1)[:, 0] + self.weights[2], 0)
        z = hidden @ self.weights[3] + self.weights[4]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), labels] -= 1
        p /= len(rows)
        back = (p @ self.weights[3].T) * (hidden > 0)
        filters = np.einsum("nfs,nf->sf", spans[n, place], back) * width_mask()
        width = max(WIDTHS)
        down = (back[:, :, None] * self.weights[1].T).reshape(-1, BYTE_SIZE)
        more = np.concatenate([rows, np.zeros((len(rows), width - 1), np.uint8)], 1)
        bytes_ = np.zeros_like(self.weights[0])
        np.add.at(bytes_, more[n[:, :, None], place[:, :, None] + np.arange(width)].ravel(), down)
        bytes_[0] = 0
        return [bytes_, filters, back.sum(0), hidden.T @ p, p.sum(0)]

    def fit(self, rows: np.ndarray, labels: np.ndarray, seed: int = 12) -> None:
        """Adam steps over small batches; the rate falls to nothing."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        batches = -(-len(rows) // BATCH)
        epochs = max(EPOCHS, -(-STEPS // batches))
        steps, step = epochs * batches, 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                rate = RATE * (1 - step / steps)
                step += 1
                for w, g, m, v in zip(self.weights, self.gradients(rows[some], labels[some]), first, second):
                    g = g + DECAY * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def to_bytes(self) -> bytes:
        names = "\x00".join(self.names).encode()
        return len(names).to_bytes(8, "little") + names + b"".join(w.astype("<f4").tobytes() for w in self.weights)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        size = int.from_bytes(raw[:8], "little")
        names, at = raw[8 : 8 + size].decode().split("\x00"), 8 + size
        weights = []
        for like in cls.start(names).weights:
            weights.append(np.frombuffer(raw, "<f4", like.size, at).reshape(like.shape).astype(np.float32))
            at += 4 * like.size
        return cls(names, weights)


def held_out(key: Column) -> Column:
    """Whether a document never takes part in learning: crc32 of its id as text leaves 1 by three."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> bytes | None:
    """Fit a network on about SAMPLE_TEXTS texts per language at most, chosen by the hash of their id.

    Held-out documents, those without a language, with a null id, or without a letter don't count. Of languages,
    the LANGUAGES with most documents are learned. None if there are none.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key"))
    rows = rows.filter(known & F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    # At most LANGUAGES shares, so they fit into the plan.
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(1.0, SAMPLE_TEXTS / r.n) * (1 << 30)))])
    # Copies of a text have the same hash, so they are taken or left together.
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    sample = rows.filter(draw < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))).select("key", "text", "lang")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sample_windows(t).tobytes() for t in texts_bytes(batch)]
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * len(found), pa.int32()), batch.column("key"), batch.column("lang"), pa.array(found, pa.binary())],
            names=["one", "key", "lang", "windows"],
        )

    def fit(_: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("key", "ascending"), ("windows", "ascending")])
        names = sorted(set(rows.column("lang").to_pylist()))
        number = {x: i for i, x in enumerate(names)}
        found = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in rows.column("windows").to_pylist()]
        labels = np.repeat([number[x] for x in rows.column("lang").to_pylist()], [len(w) for w in found])
        network = Network.start(names)
        network.fit(np.concatenate(found), labels)
        return pa.table({"model": pa.array([network.to_bytes()], pa.binary())})

    # At most LANGUAGES x SAMPLE_TEXTS x SAMPLE_WINDOWS x WINDOW bytes.
    listed = map_batches(sample, cut, "one int, key string, lang string, windows binary").dropDuplicates(["lang", "windows"])
    made = listed.groupBy("one").applyInArrow(fit, "model binary").collect()
    return made[0].model if made else None


def predict(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, probability) per text, from all its windows."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    total = np.zeros((len(texts), len(network.names)))
    full = np.zeros(len(texts))
    for numbers, rows in window_slices(texts):
        fill = (rows != 0).sum(1) / WINDOW
        np.add.at(total, numbers, network.log_probabilities(rows) * fill[:, None])
        np.add.at(full, numbers, fill)
    mean = total / np.maximum(full, 1e-9)[:, None]
    best = mean.argmax(1)
    p = np.exp(mean - mean.max(1, keepdims=True))
    score = p.max(1) / p.sum(1)
    return best, np.where(counts > 0, score, 0.0)


def window_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, windows), a few thousand at a time, also within one long text."""
    most, held, numbers, size = 64 * TOGETHER, [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text), most * WINDOW):
            rows = windows(text[at : at + most * WINDOW])
            held.append(rows)
            numbers.append(np.full(len(rows), number))
            size += len(rows)
            if size >= most:
                yield np.concatenate(numbers), np.concatenate(held)
                held, numbers, size = [], [], 0
    if held:
        yield np.concatenate(numbers), np.concatenate(held)


def with_language(docs: DataFrame, model: bytes | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, the predicted language and its probability.

    A null text, one without a letter, and every text where no language was learned is "und" with score 0. Rows keep their
    columns, whatever their names; only columns called like ``into`` are replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Network] = []
    kept = [c for c in docs.columns if c not in into]
    (read,) = fresh(docs.columns, "read")
    rows = docs.select(*kept, F.col(text).alias(read))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1).cast(pa.string())
        told = pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)
        names, scores = np.full(len(told), UNKNOWN, object), np.zeros(len(told))
        if shared.value is not None and told.any():
            if not made:
                made.append(Network.from_bytes(shared.value))
            best, p = predict(made[0], [t for t, some in zip(column.cast(pa.binary()).to_pylist(), told) if some])
            names[told] = np.array(made[0].names, object)[best]
            scores[told] = p
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], names=[*kept, *into])

    schema = rows.drop(read).schema.add(into[0], "string").add(into[1], "double")
    return map_batches(rows, run, schema)
