import random

import numpy as np
import pytest

from driftwarden.llm import decontaminate
from driftwarden.llm.fm_index import FMIndex, suffix_array


def test_suffixes_and_search():
    rng = random.Random(4)
    for _ in range(150):
        text = np.array([rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(1, 60))])
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = FMIndex(text)
        for length in (1, 2, 3):
            phrases = np.array([[rng.randint(0, 12) for _ in range(length)] for _ in range(20)])
            for phrase, low, high in zip(phrases, *index.search(phrases)):
                want = [i for i in range(len(text) - length + 1) if text[i : i + length].tolist() == phrase.tolist()]
                assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == want


def words(text):
    return decontaminate.fold_words((text or "").encode())


def brute(rows, items, window):
    phrases = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            phrases.setdefault(tuple(ws[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for key, t in rows:
        ws, hit, found = words(t), set(), set()
        for p, names in phrases.items():
            for k in range(len(ws) - len(p) + 1):
                if tuple(ws[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= names
        out.append((key, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(docs, bench, window):
    rows = decontaminate.find_items(docs, bench, window).collect()
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and sum(s.end - s.start for s in r.spans) == r.n_hit
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in rows], key=repr)


@pytest.mark.parametrize("block,shard", [(500_000, 400_000), (30, 100)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rng = random.Random(block)
    some = lambda n: " ".join(rng.choice("a b c D é 9".split()) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, some(rng.randint(0, 9))) for i in range(12)] + [(3, some(6)), (None, some(5)), (20, None), (21, "?!")]
    rows = [(rng.randint(0, 50), some(rng.randint(0, 60))) for _ in range(60)]
    rows += rows[:5] + [(None, items[1][1]), (None, items[1][1]), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run(docs, bench, 5) == brute(rows, items, 5)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "Quick BROWN fox"), (1, "lazy dog")], "item_id long, text string")
    rows, items = [(r.doc_id, r.text) for r in odd_docs.collect()], [(1, "Quick BROWN fox"), (1, "lazy dog")]
    assert run(odd_docs, bench, 13) == brute(rows, items, 13)
    assert run(odd_docs, bench.limit(0), 13) == brute(rows, [], 13)
    assert run(no_docs, bench, 13) == []
