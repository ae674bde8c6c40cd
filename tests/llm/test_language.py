import random
import zlib

import numpy as np
import pytest

from driftwarden.llm import language, queries


def test_gradients():
    """Against differences of the loss in every kind of weight."""
    rng = np.random.default_rng(1)
    network = language.Network.start(["a", "b", "c"])
    rows = rng.integers(1, 256, (6, language.WINDOW)).astype(np.uint8)
    rows[3, 40:] = 0
    labels = rng.integers(0, 3, 6)
    exact = network.gradients(rows, labels)
    assert not exact[0][0].any() and not (exact[1] * (1 - language.width_mask())).any()

    def loss():
        return -network.log_probabilities(rows)[np.arange(6), labels].astype(float).mean()

    for weights, gradient in zip(network.weights, exact):
        for at in np.argsort(-np.abs(gradient).ravel())[:5]:
            place = np.unravel_index(at, weights.shape)
            old, step = weights[place], 1e-2
            weights[place] = old + step
            up = loss()
            weights[place] = old - step
            down = loss()
            weights[place] = old
            assert (up - down) / (2 * step) == pytest.approx(gradient[place], rel=0.05, abs=2e-3)


def test_largest():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 128):
        a = rng.normal(size=(4, n, 5)).astype(np.float32)
        np.testing.assert_array_equal(language.largest(a.copy()), a.max(1))


def test_every_window_of_a_text_counts():
    """By hand: the mean of the log probabilities of all windows, weighted by their fill."""
    network = language.Network.start(["a", "b"])
    texts = [b"x", b"ab" * 64, b"hello world " * 500, b"", "ü".encode() * 200_000]
    best, score = language.predict(network, texts)
    for text, found, p in zip(texts, best, score):
        if not text:
            assert p == 0
            continue
        total, full = np.zeros(2), 0.0
        for at in range(0, len(text), language.WINDOW):
            part = text[at : at + language.WINDOW]
            total += network.log_probabilities(language.windows(part))[0] * len(part) / language.WINDOW
            full += len(part) / language.WINDOW
        odds = np.exp(total / full - (total / full).max())
        assert found == total.argmax() and p == pytest.approx(odds.max() / odds.sum(), abs=1e-4)


def test_saved_network_is_the_same():
    network = language.Network.start(["de", "zh-Hant", "x y"])
    again = language.Network.from_bytes(network.to_bytes())
    assert again.names == network.names
    assert all((a == b).all() for a, b in zip(again.weights, network.weights))


def test_held_out_accuracy(spark, sf):
    """On documents that the network never saw, in a table of 200 and in one of 1,000."""
    for path, least in ((sf, 0.9), (sf.replace("0.001", "0.01"), 0.97)):
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
        rows = queries.QUERIES["op13_byte_language"](spark, path).collect()
        assert sorted(r.doc_id for r in rows) == sorted(truth)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out]
        assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= least


def made(spark, n=240):
    rng = random.Random(3)
    kinds = {"up": "abcdefgh", "down": "stuvwxyz"}
    rows = [(i, "".join(rng.choice(kinds[k]) for _ in range(300)), k) for i in range(n) for k in [rng.choice(["up", "down"])]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rows_don_t_teach(spark):
    docs = made(spark)
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(encode(cast(doc_id AS string), 'UTF-8')) % 3 = 1 THEN 'none' ELSE lang END AS lang")
    model = language.train(docs)
    assert model == language.train(turned) == language.train(docs.repartition(7))
    found = language.with_language(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_sample_is_bounded(spark, monkeypatch):
    docs = made(spark)
    whole = language.train(docs)
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 20)
    assert language.train(docs) != whole
    monkeypatch.setattr(language, "LANGUAGES", 1)
    assert len(language.Network.from_bytes(language.train(docs)).names) == 1
    assert len(language.sample_windows(b"x" * 10_000_000)) == language.SAMPLE_WINDOWS


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", odd_docs.key)
    extra = spark.createDataFrame([(50, "1234 !! ²³ 五"), (51, "1234 !! ²³"), (52, "\x00\x00")], "doc_id long, text string")
    model = language.train(docs)
    rows = language.with_language(docs.unionByName(extra, allowMissingColumns=True), model).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        told = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == told and (told or r.score == 0)
    assert {r.lang_pred for r in rows} - {"und"} <= {r.lang for r in rows}
    assert language.train(no_docs.withColumn("lang", no_docs.key)) is None
    assert {r.lang_pred for r in language.with_language(odd_docs, None).collect()} == {"und"}
    assert language.with_language(no_docs, model).collect() == []
