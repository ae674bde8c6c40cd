import random
from collections import Counter, defaultdict

import numpy as np

from driftwarden.llm import phrases
from driftwarden.llm.words import cut_slices

SEPARATORS = ".,;:!?\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, threshold=10, longest=3, top=2000, percent=50):
    """Word by word, in plain dictionaries."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        cut = lowered(text or "")
        for s in SEPARATORS:
            cut = cut.replace(s, "\n")
        for piece in cut.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        found = []
        for p, a in known.items():
            longer = [b for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in longer):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(spark, rows, **kinds):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(docs, **kinds).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Der", "die", "über", "ÜBER", "a", "b", "New", "york", "city", " x", "z ", "p\x00q"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(words + ["new york city"] * 3) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "])
        rows.append((rng.choice([None, "und", "de", "en", ""]), text))
    rows += [("en", None), (None, None), ("xx", ""), ("en", "." * 50)]
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, rows, threshold=3, top=5, percent=80) == brute(rows, 3, 3, 5, 80)
    assert found(spark, rows, threshold=4, longest=4) == brute(rows, 4, 4)
    assert found(spark, rows, threshold=4, longest=2) == brute(rows, 4, 2)


def test_small_buffers_and_filters_change_nothing(spark, monkeypatch):
    """Summaries of a few phrases each, saturated filters and many parts give the same result."""
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice("abcdefgh") + rng.choice(["", "", ","]) for _ in range(200))) for _ in range(40)]
    want = brute(rows)
    for name, value in (("HELD", 50), ("HELD_PHRASES", 20), ("FILTER_MOST", 1 << 6), ("PART_BYTES", 512)):
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows) == want


def test_every_frequent_phrase_survives_the_merge():
    """The capacity exceeds mass / threshold, so no order of merging loses a frequent one."""
    rng = np.random.default_rng(5)
    for threshold in (2, 10, 50):
        stream = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat(np.arange(6000, 6040), threshold)]).astype(np.uint64)
        rng.shuffle(stream)
        summary = phrases.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 37):
            hashes, counts = np.unique(part, return_counts=True)
            summary.add(hashes, counts)
            summary.merge()
        truth, counts = np.unique(stream, return_counts=True)
        left = summary.survivors(threshold)
        assert np.isin(truth[counts >= threshold], left).all()
        assert summary.taken < threshold and len(summary.hashes) <= len(stream) // threshold + 1


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_007
    counts = spark.createDataFrame(
        [("en", 1, "a", big + 12), ("en", 1, "b", big + 5), ("en", 2, "a b", big)], "lang string, k int, phrase string, n long"
    )
    row = phrases.scored(counts).first()
    assert row.score == 1_000_000 * big * big // ((big + 12) * (big + 5))


def test_one_piece_without_end(spark):
    rows = [("en", "new york " * 300_000), ("en", "x" * 3_000_000), ("en", "new york")]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", odd_docs.key)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == brute(rows)
    assert phrases.collocations(no_docs.withColumn("lang", no_docs.key)).collect() == []


def test_long_texts_are_cut_where_a_piece_ends():
    texts = [b"", b"aaa. bbb ccc, d", b"x" * 25 + b"." + b"y" * 12, b"\n\n"]
    got = list(cut_slices(texts, 10, phrases.PIECE_BYTES))
    whole = {}
    for some, numbers in got:
        for part, number in zip(some, numbers):
            whole[number] = whole.get(number, b"") + part
    assert [whole[i] for i in range(4)] == texts
    assert {p for some, _ in got for p in some} >= {b"aaa.", b" bbb ccc,", b"x" * 25 + b"."}
