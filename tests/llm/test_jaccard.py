import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftwarden.llm import common, jaccard, links


def brute(rows, shingle, percent):
    sets = []
    for i, t in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        n = len(ws)
        sets.append({tuple(ws[k : k + shingle]) for k in range(n - shingle + 1)} if n >= shingle else {tuple(ws)} if n else set())
    label = {i: i for i, _ in rows if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            inside = len(sets[a] & sets[b])
            if 100 * inside >= percent * (len(sets[a]) + len(sets[b]) - inside):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        out.append((i, len(s), None if i is None else root(i) if s else i))
    return sorted(out, key=repr)


def run(docs, shingle=3, percent=90):
    return sorted([tuple(r) for r in jaccard.link_documents(docs, shingle, percent).collect()], key=repr)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    found = {r.node: r.label for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: l for n, l in label.items() if any(n in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    for _ in range(400):
        size = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = a[rng.random(len(a)) < rng.choice([0.6, 0.9, 0.97])]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)]))
        inside = len(np.intersect1d(a, b))
        if inside and len(a) + len(b) > 2 * inside and 100 * inside >= percent * (len(a) + len(b) - inside):
            assert np.intersect1d(jaccard.part_tokens(a, bands), jaccard.part_tokens(b, bands)).size


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("group", [256, 7])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP_DOCS", group)
    rng = random.Random(group)
    texts = [t for n, w, e in [(60, 150, 8), (25, 40, 2), (20, 12, 1), (10, 600, 25), (15, 4, 1)] for t in near_copies(rng, n, w, e)]
    texts += ["A b C", "a B c", "x", "X", "x y", "", " ", None] + texts[:9]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows, 3, 90)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == brute(rows, 3, 90)
    assert run(no_docs) == []


def test_five_words_four_fifths(spark):
    rng = random.Random(3)
    rows = list(enumerate(near_copies(rng, 40, 80, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, 5, 80) == brute(rows, 5, 80)


def test_tokens_need_common_content():
    """Unlike sets of similar size share no token, though many have empty parts in common."""
    rng, bands = np.random.default_rng(4), jaccard.Bands(80)
    seen = set()
    for size in rng.integers(150, 1200, 300):
        tokens = set(jaccard.part_tokens(np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * 2), bands).tolist())
        assert not seen & tokens
        seen |= tokens


def test_linked_sets_with_empty_parts_share_a_token():
    """Sets whose equal parts are all empty: every part with content differs."""
    bands = jaccard.Bands(80)
    parts = bands.of(20)[-1][1]
    width = (1 << 64) // parts
    a = np.array(sorted(1000 + i for i in range(18)) + [width * 2 + 5], np.uint64)
    b = np.array(sorted(1000 + i for i in range(17)) + [width * 2 + 6], np.uint64)
    inside = len(np.intersect1d(a, b))
    assert 100 * inside >= 80 * (len(a) + len(b) - inside)
    assert np.intersect1d(jaccard.part_tokens(a, bands), jaccard.part_tokens(b, bands)).size


def test_a_repeated_id_links_all_its_texts(spark):
    x, y, z = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(5, x), (9, x), (9, y), (20, y), (20, z), (30, z), (40, "alone with its words"), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = run(docs)
    assert {i: label for i, n, label in found if n} == {5: 5, 9: 5, 20: 5, 30: 5, 40: 40}
    assert [r for r in found if r[1]] == [r for r in brute(rows, 3, 90) if r[1]]


def test_pairs_of_groups_are_read_one_at_a_time_and_memory_goes_back(spark, monkeypatch):
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 40, 41)]
    rows = [{"family": 1, "gid": g, **jaccard.Group.build([g], [s]).write()} for g, s in enumerate(sets)]
    batch = pa.RecordBatch.from_pylist(rows)
    assert list(jaccard.rows_of(batch)) == rows
    handed, whole = [], jaccard.map_batches
    monkeypatch.setattr(jaccard, "map_batches", lambda df, run, schema: handed.append(schema) or whole(df, run, schema))
    groups = spark.createDataFrame([tuple(r.values()) for r in rows], jaccard.GROUP_COLUMNS)
    assert jaccard.compare_inside(groups, 80).count() == 0
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in jaccard.compare_pairs(groups, groups, 80).collect()}
    assert found == {(0, 1), (2, 3)}
    # The shared way to run batches, which hands freed memory back when a task ends.
    assert handed == ["a long, b long"] * 2


def test_groups_are_stored_in_small_row_groups(spark, monkeypatch):
    """Groups take megabytes each; a task that reads or writes them must not hold a hundred at once."""
    found, seen = jaccard.stored, []

    def watched(df, name, **options):
        out = found(df, name, **options)
        if name in ("groups", "rest"):
            seen.append((name, out))
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    monkeypatch.setattr(common, "WIDE_ROWS", {**common.WIDE_ROWS, "parquet.block.size": 1 << 20})
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        text = " ".join(f"{w:x}" for w in rng.integers(0, 1 << 62, 60_000))
        rows += [(3 * i + k, text + f" end{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(docs).collect()}
    assert got == {i: i // 3 * 3 for i in range(36)}
    (groups,) = [df for name, df in seen if name == "groups"]
    about = [pq.ParquetFile(path.removeprefix("file:")).metadata for path in groups.inputFiles()]
    # A group of 1.2 MB fills a row group by itself here.
    assert max(m.num_rows for m in about) > 1
    assert all(m.num_row_groups == m.num_rows for m in about)
