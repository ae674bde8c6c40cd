import random
import zlib

import numpy as np
import pytest

from driftwarden.llm import toxicity


def test_pairs_count_for_more_than_their_words():
    """Either word alone is harmless; only both together are toxic."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randint(0, 30)}" for _ in range(12)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(a and b))
    rows, labels = [toxicity.text_terms(t) for t in texts], np.array(labels)
    model = toxicity.Machine.fit(rows[:1000], labels[:1000])
    found = model.score_terms(rows[1000:]) >= 0.5
    assert (found == (labels[1000:] > 0)).mean() > 0.98
    scorer = toxicity.Scorer(model.to_bytes())
    np.testing.assert_allclose(scorer.score(texts[1000:]), model.score_terms(rows[1000:]))
    scores = scorer.score(["", "insult", "group", "insult group"])
    assert scores[3] > 0.5 > max(scores[:3])


@pytest.mark.parametrize("labels", [[], [1.0], [0.0, 0.0]])
def test_without_two_classes(labels):
    model = toxicity.Machine.fit([toxicity.text_terms("some words")] * len(labels), np.array(labels))
    score = toxicity.Scorer(model.to_bytes()).score(["", "some words", None or ""])
    assert ((score > 0) & (score < 1)).all() and len(set(score)) == 1


def labelled(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join([f"w{rng.randint(0, 200)}" for _ in range(30)] + ["scum"] * bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_rows_don_t_teach(spark):
    docs = labelled(spark)
    turned = docs.selectExpr("doc_id", "CASE WHEN crc32(encode(cast(doc_id AS string), 'UTF-8')) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    text = docs.select("doc_id", "text")
    assert toxicity.train(text, docs.select("doc_id", "toxic")) == toxicity.train(text, turned)
    rows = docs.select("doc_id", toxicity.held_out(docs.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    scored = toxicity.with_scores(docs, toxicity.train(text, docs)).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.5) == bool(r.toxic) for r in held)


def test_sample_is_bounded(spark, monkeypatch):
    docs = labelled(spark)
    whole = toxicity.train(docs.select("doc_id", "text"), docs)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 100)
    assert toxicity.train(docs.select("doc_id", "text"), docs) != whole


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, None), (None, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.with_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert set(rows[0].asDict()) == set(odd_docs.columns)
    assert toxicity.with_scores(no_docs, model).count() == 0
    assert 0 < toxicity.Scorer(toxicity.train(no_docs, labels)).score([""])[0] < 1


def test_pairs_with_balanced_margins():
    """Neither word says anything alone: the label is that exactly one of the two is there."""
    rng = random.Random(5)
    texts, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randint(0, 60)}" for _ in range(12)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(a != b))
    rows, labels = [toxicity.text_terms(t) for t in texts], np.array(labels)
    model = toxicity.Machine.fit(rows[:3000], labels[:3000])
    assert set(toxicity.word_terms(b"insult") + toxicity.word_terms(b"group")) >= set(model.terms.tolist())
    assert ((model.score_terms(rows[3000:]) >= 0.5) == (labels[3000:] > 0)).mean() > 0.95


def test_chance_brings_no_pairs_in():
    rng = random.Random(6)
    rows = [toxicity.text_terms(" ".join(f"w{rng.randint(0, 400)}" for _ in range(60))) for _ in range(2000)]
    labels = np.array([float(rng.random() < 0.1) for _ in rows])
    assert len(toxicity.pair_terms(rows, labels)) <= 2
    assert len(toxicity.pair_terms([toxicity.text_terms("")] * 5, np.array([0, 1, 0, 1, 0.0]))) == 0
