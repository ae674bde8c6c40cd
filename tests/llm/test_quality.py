import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from driftwarden.llm import quality
from driftwarden.llm.common import stored


def base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def grams(text, buckets):
    """Buckets of words and pairs, with the same hash outside of Spark."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % buckets for x in h + pairs]


def scores(rows, trusted, buckets):
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        g = np.bincount(grams(t, buckets), minlength=buckets) if t else 0
        raw += g
        if i in trusted:
            good += g
    prior, share, total = quality.PRIOR * (good > 0).sum(), raw / max(raw.sum(), 1), good.sum()
    if not total:
        return [0.0] * len(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(raw > 0, np.log((good + prior * share) / (total + prior) / share), 0)
        own = np.where(good > 0, good * np.log((good - 1 + prior * share) / (total - 1 + prior) / share), 0)
    level = float(min(own.sum() / total, 0.0)) if total > 1 else 0.0
    return [float(np.mean(np.round(w, 6)[grams(t, buckets)])) - level if t and t.split() else 0.0 for _, t in rows]


def check(spark, docs, rows, trusted, buckets=64):
    ids = spark.createDataFrame([(i,) for i in [*trusted, *trusted, None]], "doc_id long")
    found = quality.judge(docs, ids, buckets=buckets).collect()
    want = [(i, *base(t), round(s, 5)) for (i, t), s in zip(rows, scores(rows, trusted, buckets))]
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 5)) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in found)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"w{rng.randint(0, rng.choice([3, 40]))}" + rng.choice(["", "", "#", "é"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs, rows, [i for i in range(0, 120, 3)])
    check(spark, docs, rows, [])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(spark, odd_docs, rows, [1, 5])
    assert quality.judge(no_docs, odd_docs.select("doc_id")).count() == 0


def test_junk_is_refused_and_prose_kept(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("the of and to in is that it was for".split()) for _ in range(80))
    junk = lambda: " | ".join(f"x{rng.randint(0, 999)}" for _ in range(40))
    rows = [(i, prose() if i % 4 else junk()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 300) if i % 4], "doc_id long")
    found = quality.judge(docs, good, buckets=256).filter("not base_failed").collect()
    assert all(r.kept == bool(r.doc_id % 4) for r in found)


@pytest.mark.xfail(reason="copies of trusted texts hide how fresh text scores: only 51 % of the verdicts agree")
def test_same_verdicts_at_two_sizes(spark, sf):
    """The same mixture, once and four times over, with the query's own buckets: junk goes and prose stays in both."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = []
    for copies in (1, 4):
        times = docs.selectExpr("doc_id", "text", f"explode(sequence(0, {copies - 1})) AS c").selectExpr("doc_id + 100000L * c AS doc_id", "text")
        good = labels.filter("quality = 1").selectExpr("doc_id", f"explode(sequence(0, {copies - 1})) AS c").selectExpr("doc_id + 100000L * c AS doc_id")
        found.append({r.doc_id: r for r in quality.judge(stored(times, "times"), stored(good, "good")).collect() if r.doc_id < 100000})
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rules = [i for i, r in found[0].items() if not r.base_failed]
    for rows in found:
        assert np.mean([rows[i].kept for i in rules if marks.get(i) == 1]) > 0.95
        junk = [i for i in rules if marks.get(i) == 0]
        assert sum(not rows[i].kept for i in junk) >= len(junk) / 2
    assert np.mean([found[0][i].kept == found[1][i].kept for i in rules]) > 0.75


def test_few_trusted_words_can_refuse(spark):
    """A handful of trusted texts is enough for junk to score below the threshold."""
    prose = "the cat sat on the mat and the dog lay by the door of the house in the sun all day"
    junk = "zq xv qq zx vv kq xz jq zv qx kk jx qv zz xq vk jj qz xk vj"
    docs = spark.createDataFrame([(i, prose) for i in range(6)] + [(10, junk), (11, prose)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    rows = {r.doc_id: r for r in quality.judge(docs, good).collect()}
    assert rows[10].score < quality.THRESHOLD and not rows[10].kept
    assert all(rows[i].score >= quality.THRESHOLD for i in (0, 11))


def test_rules_look_at_characters_in_bulk(spark, odd_docs):
    """No character is looked up by itself, and only texts with repeated windows are sorted."""
    counted = quality.with_base_counts(quality.with_words(odd_docs).withColumn("_pairs", quality.pairs()))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "sort_array(_w" not in plan and "array_sort" not in plan


def test_symbols_and_lines_of_odd_texts(spark):
    texts = ["[#] *$%&|<> ^-\\] \U0001f600#\U0001f600", "a b\n \x0b\x0c\na b\n\ta b\n\n a b\na b", "\n\n", "#", "x" * 9 + "\r\n" + "x" * 9 + "\r\n", "\x20\n\x20\n"]
    rows = list(enumerate(texts))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, [0, 1])
