import math
import random
import re
from collections import Counter, defaultdict

import pytest

from driftwarden.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    """Every document against every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, size, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    wanted = defaultdict(Counter)
    for item, text in set(items):
        wanted[item].update(terms(text))
    out = []
    for item, asked in wanted.items():
        found = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // size
            weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if t in bag}
            score = sum(asked[t] * w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, w in weight.items())
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **kinds):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in lexical.search(a, b, **kinds).collect()), key=repr)


def made(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "ÜBER", "naïve", "a", "ab", "abc", "bc", "x" * 300, "東京"]
    marks = [" ", "  ", "\n", "-", "_", "'", "\x00", "\x7f", "{", " "]
    return ["".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(marks) for _ in range(rng.randint(0, 50))) for _ in range(count)]


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 300])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    """One block of items, or many small ones that a task goes through in turn."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lexical, "CELLS", 40)
    docs = list(enumerate(made(1, 150))) + [(200, None), (201, ""), (None, "w1 w2 über"), (3, "w5 w5 w5"), (3, "w5 w5 w5")]
    items = [(f"i{i}", t) for i, t in enumerate(made(2, 25))]
    items += [("i1", "w1 w2"), ("i1", "w1 w2"), (None, "abc bc"), ("none", None), ("empty", " -- "), ("strange", "neverseen")]
    want = brute(docs, items)
    assert len(want) > 150 and found(spark, docs, items) == want
    assert found(spark, docs, items, top=3) == brute(docs, items, 3)


def test_ties_go_to_the_smallest_key(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(None, "same words here"), (900, "other")]
    rows = found(spark, docs, [("q", "words")])
    assert [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[1])] == [(i, i) for i in range(1, 11)]


def test_very_long_text(spark):
    long = ("w1 w2 " * 400_000) + "w3"
    docs = [(1, long), (2, "w1 w3"), (3, "q" * 3_000_000), (4, "w2")]
    items = [("a", "w1 w3 w3"), ("b", "w2 " + "q" * 3_000_000)]
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(5, "quick fox"), (5, None), (6, "w1 v1 text")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc", "2 AS score", "'x' AS block")
    assert sorted((tuple(r) for r in lexical.search(odd_docs, asked).collect()), key=repr) == brute(rows, items)
    for docs, some in ((no_docs, asked), (odd_docs, asked.limit(0)), (no_docs, asked.limit(0)), (odd_docs.filter("text = ''"), asked)):
        empty = lexical.search(docs, some)
        assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
