import random

import pytest

from driftwarden.llm import substrings


def brute(rows, window):
    """Kept words per row, straight from the rule."""
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - window + 1):
                w = tuple(ws[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        if i is not None:
            for k in range(len(ws) - window + 1):
                if first[tuple(ws[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def run(docs, window, shortest):
    rows = substrings.remove_repeats(docs, window, shortest).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows], key=repr)


def test_levels():
    assert substrings.level_lengths(50, 20) == [25, 50]
    assert substrings.level_lengths(50, 5) == [7, 13, 25, 50]
    assert substrings.level_lengths(10, 20) == [10]


@pytest.mark.parametrize("window,shortest", [(6, 2), (7, 2), (12, 3), (5, 5)])
def test_against_brute_force(spark, window, shortest):
    rng = random.Random(window)
    passages = [[f"p{rng.randint(0, 5)}" for _ in range(rng.randint(2, 40))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 12))]
        rows.append((rng.randint(0, 60), " ".join(words)))
    rows += rows[:10]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, window, shortest) == brute(rows, window)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, 8, 2) == brute(rows, 8)
    assert run(no_docs, 8, 2) == []
