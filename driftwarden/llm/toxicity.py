"""Toxicity scores by a factorisation machine over hashed terms.

Terms are a text's distinct words and their beginnings, hashed into a fixed number of buckets. Beside a
weight, each bucket has a short vector; the products of the vectors of all pairs of terms that
meet in a text add to the score, so a pair can count for more (or less) than its two words alone. The model
is fitted in one task on a bounded sample of labelled rows and has a fixed size; every text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import fresh, map_batches
from driftwarden.llm.decontaminate import FOLD

BUCKETS = 1 << 18
FACTORS = 4
# Labelled rows that a model is fitted on, at most about; the rest only differ by their hash.
SAMPLE_ROWS = 20_000
# Likelihood-ratio statistic (one degree of freedom) from which a term is tied to the label and gets a weight.
EVIDENCE = 15.0
# Buckets whose pairs are looked at for terms that say something together only, the rows that such a bucket is in (and
# is not in) at least, and the squared ratio from which a pair counts; among a million pairs chance hardly reaches it.
PAIR_TERMS = 1500
PAIR_SUPPORT = 30
PAIR_EVIDENCE = 45.0
EPOCHS = 12
RATE = 0.2
DECAY = 1e-3
SPREAD = 0.02
BATCH = 32
KEPT_WORDS = 300_000
PREFIXES = (3, 4, 5)


def text_words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(FOLD).split())


def word_terms(word: bytes) -> list[int]:
    """Buckets of a word and of its first three, four and five characters."""
    letters = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(f"p{n}{letters[:n]}".encode() for n in PREFIXES if len(letters) > n)]
    return [xxhash.xxh64_intdigest(p) % BUCKETS for p in parts]


def text_terms(text: str) -> np.ndarray:
    found = {t for w in text_words(text) for t in word_terms(w)}
    return np.array(sorted(found), np.int32)


def evidence(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per bucket, twice the log likelihood ratio of "label depends on the term" against "it doesn't"."""
    every = np.concatenate(rows)
    ones = np.repeat(labels, [len(r) for r in rows])
    seen = np.bincount(every, minlength=BUCKETS).astype(float)
    with_label = np.bincount(every, ones, BUCKETS)
    n, n1 = float(len(rows)), float(labels.sum())
    total = np.zeros(BUCKETS)
    cells = ((with_label, seen, n1), (seen - with_label, seen, n - n1), (n1 - with_label, n - seen, n1), (n - n1 - seen + with_label, n - seen, n - n1))
    for have, row, column in cells:
        want = row * column / n
        total += np.where(have > 0, have * np.log(np.maximum(have, 1e-12) / np.maximum(want, 1e-12)), 0.0)
    return 2 * total


def pair_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that matter through another one: the label's rate with both is not what either alone would make it.

    Over all pairs of the PAIR_TERMS most evenly spread buckets, the contrast of the four rates (both, one, the
    other, neither) is held against its own spread; a pair whose squared ratio reaches PAIR_EVIDENCE brings both in.
    """
    n = len(rows)
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    even = np.minimum(seen, n - seen)
    terms = np.flatnonzero(even >= PAIR_SUPPORT)
    terms = np.sort(terms[np.argsort(-even[terms], kind="stable")[:PAIR_TERMS]])
    if len(terms) < 2:
        return terms[:0]
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(len(terms))
    both, ones = np.zeros((2, len(terms), len(terms)))
    for at in range(0, n, 1000):
        some = rows[at : at + 1000]
        bits = np.zeros((len(some), len(terms)), np.float32)
        here = place[np.concatenate(some)]
        bits[np.repeat(np.arange(len(some)), [len(r) for r in some])[here >= 0], here[here >= 0]] = 1
        both += bits.T @ bits
        ones += bits.T @ (bits * labels[at : at + 1000, None].astype(np.float32))
    single, single_ones = np.diag(both).copy(), np.diag(ones).copy()
    cells = [
        (both, ones, 1),
        (single[:, None] - both, single_ones[:, None] - ones, -1),
        (single[None, :] - both, single_ones[None, :] - ones, -1),
        (n - single[:, None] - single[None, :] + both, labels.sum() - single_ones[:, None] - single_ones[None, :] + ones, 1),
    ]
    contrast, spread = np.zeros_like(both), np.zeros_like(both)
    for count, with_label, sign in cells:
        rate = (with_label + 0.5) / (count + 1)
        contrast += sign * rate
        spread += rate * (1 - rate) / (count + 1)
    strong = contrast * contrast >= PAIR_EVIDENCE * spread
    np.fill_diagonal(strong, False)
    return terms[strong.any(1)]


class Machine:
    """score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>), over the known terms i, j of a text."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        """``terms``: the buckets with a weight, ascending."""
        self.bias, self.terms, self.weights, self.vectors = bias, terms, weights, vectors

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the model for those of the buckets that it knows."""
        at = np.searchsorted(self.terms, ids)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == ids] if len(self.terms) else at[:0]

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
        """Logistic loss, AdaGrad steps over small batches; the rarer class weighs up to four times.

        Without rows, or with one class alone, the model returns the smoothed rate of label 1 for every text.
        """
        rng = np.random.default_rng(seed)
        n, ones = len(rows), float(labels.sum())
        rate = (ones + 0.5) / (n + 1.0) if n else 0.5
        bias = float(np.log(rate / (1 - rate)))
        terms = np.empty(0, np.int64)
        if n and 0 < ones < n:
            alone = np.flatnonzero(evidence(rows, labels) >= EVIDENCE)
            terms = np.union1d(alone, pair_terms(rows, labels))
        model = cls(bias, terms, np.zeros(len(terms)), rng.normal(0, SPREAD, (len(terms), FACTORS)))
        if not len(terms):
            return model
        found = [model.known(r) for r in rows]
        heavy = min(4.0, (n - ones) / ones)
        w, v = model.weights, model.vectors
        gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                some = order[at : at + BATCH]
                ids = np.concatenate([found[i] for i in some])
                doc = np.repeat(np.arange(len(some)), [len(found[i]) for i in some])
                total = np.zeros((len(some), FACTORS))
                np.add.at(total, doc, v[ids])
                squares = np.bincount(doc, (v[ids] ** 2).sum(1), len(some))
                z = model.bias + np.bincount(doc, w[ids], len(some)) + 0.5 * ((total**2).sum(1) - squares)
                y = labels[some]
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, heavy, 1.0)
                used, where = np.unique(ids, return_inverse=True)
                dw = np.bincount(where, error[doc], len(used)) + DECAY * w[used]
                dv = DECAY * v[used]
                np.add.at(dv, where, error[doc, None] * (total[doc] - v[ids]))
                gw[used] += dw * dw
                gv[used] += dv * dv
                w[used] -= RATE * dw / np.sqrt(gw[used])
                v[used] -= 0.1 * RATE * dv / np.sqrt(gv[used])
                gb += float(error.sum()) ** 2
                model.bias -= RATE * float(error.sum()) / np.sqrt(gb)
        return model

    def score_terms(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, ids in enumerate(rows):
            at = self.known(ids)
            v = self.vectors[at]
            z = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def to_bytes(self) -> bytes:
        return b"".join(
            [
                np.array([self.bias], "<f8").tobytes(),
                np.array([len(self.terms)], "<i8").tobytes(),
                self.terms.astype("<i8").tobytes(),
                self.weights.astype("<f8").tobytes(),
                self.vectors.astype("<f8").tobytes(),
            ]
        )

    @classmethod
    def from_bytes(cls, raw: bytes) -> Machine:
        bias, n = float(np.frombuffer(raw, "<f8", 1)[0]), int(np.frombuffer(raw, "<i8", 1, 8)[0])
        terms, weights = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<f8", n, 16 + 8 * n)
        return cls(bias, terms, weights, np.frombuffer(raw, "<f8", n * FACTORS, 16 + 16 * n).reshape(n, FACTORS))


def held_out(key: Column) -> Column:
    """Whether a document never takes part in learning: crc32 of its id as text leaves no rest by five."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """Fit a model on about SAMPLE_ROWS labelled documents at most, chosen by the hash of their id.

    Null labels, null ids and held-out documents don't count; an id with several labels has the larger.
    The model has a few numbers per term tied to the label, at most ``BUCKETS`` terms.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    n = known.count()
    if n > SAMPLE_ROWS:
        share = int(SAMPLE_ROWS / n * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < share)
    # About SAMPLE_ROWS rows of two numbers.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")

    def to_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_terms(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * len(found), pa.int32()), batch.column("key").cast(pa.string()), batch.column("label"), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())],
            names=["one", "key", "label", "terms"],
        )

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("terms", "ascending")])
        terms = [np.frombuffer(t, "<i4") for t in rows.column("terms").to_pylist()]
        labels = (rows.column("label").to_numpy() > 0).astype(float)
        return pa.table({"model": pa.array([Machine.fit(terms, labels).to_bytes()], pa.binary())})

    listed = map_batches(rows.select("key", "text", "label"), to_terms, "one int, key string, label int, terms binary")
    model = listed.groupBy("one").applyInArrow(fit, "model binary").collect()
    return model[0].model if model else Machine.fit([], np.empty(0)).to_bytes()


class Scorer:
    """Scores texts; remembers which rows of the model a word stands for."""

    def __init__(self, raw: bytes):
        self.model = Machine.from_bytes(raw)
        self.place = {int(t): i for i, t in enumerate(self.model.terms)}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words = {}
        for w in words:
            self.words[w] = tuple(self.place[t] for t in word_terms(w) if t in self.place)

    def score(self, texts: list[str]) -> np.ndarray:
        out, model = np.empty(len(texts)), self.model
        for i, text in enumerate(texts):
            words = text_words(text)
            fresh = [w for w in words if w not in self.words]
            if fresh:
                self._learn(fresh)
                if len(fresh) < len(words) and any(w not in self.words for w in words):
                    self._learn([w for w in words if w not in self.words])
            at = np.array(sorted(set().union(*map(self.words.__getitem__, words))), np.int64) if words else np.empty(0, np.int64)
            v = model.vectors[at]
            z = model.bias + model.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def with_scores(docs: DataFrame, model: bytes, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, from 0 to 1. A null text scores as an empty one.

    Every row keeps its place and its columns, whatever their names; only a column called like ``into`` is
    replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Scorer] = []
    kept = [c for c in docs.columns if c != into]
    (scored,) = fresh(docs.columns, "scored")
    rows = docs.select(*kept, F.col(text).alias(scored))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(shared.value))
        scores = made[0].score([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*kept, into])

    schema = rows.drop(scored).schema.add(into, "double")
    return map_batches(rows, run, schema)
