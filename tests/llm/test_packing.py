import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwarden.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_fill_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(0, 25)
        used = packing.fill(counts, capacity)
        assert all(used[n] <= counts[n] for n in used)
        best = max(
            s for picks in itertools.product(*[range(c + 1) for c in counts.values()])
            if (s := sum(n * p for n, p in zip(counts, picks))) <= capacity
        )
        assert sum(n * c for n, c in used.items()) == best


def test_plan_places_every_rest_once():
    rng = random.Random(6)
    counts = dict(Counter(rng.randint(1, 64) for _ in range(2000)))
    steps = packing.plan(counts, 64)
    placed = Counter()
    for used, times in steps:
        assert sum(n * c for n, c in used.items()) <= 64
        placed.update({n: c * times for n, c in used.items()})
    assert placed == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(times for _, times in steps) <= 1.01 * total / 64 + 1


@pytest.mark.parametrize("odd", [False, True])
def test_pieces_are_a_gapless_cover(spark, sf, odd, odd_docs):
    docs = odd_docs if odd else spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, VOCABULARY, end_id=1, window=256).collect()
    plain = Tokenizer.from_file(VOCABULARY)
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    whole = Counter()
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole[(r.doc_id is not None, r.doc_id or 0, r.start, tuple(ids.tolist()), r.doc_tokens)] += 1
    pieces = Counter()
    for known, key, ids in want:
        for at in range(0, len(ids), 256):
            pieces[(known, key, at, ids[at : at + 256], len(ids))] += 1
    assert whole == pieces
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    if not odd:
        used = sum(length for parts in sequences.values() for _, length in parts)
        assert used / (256 * len(sequences)) > 0.99


def test_empty_table(no_docs):
    assert packing.pack(no_docs, VOCABULARY, end_id=1).count() == 0
