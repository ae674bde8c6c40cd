import random

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwarden.llm import counting
from driftwarden.llm.encode import encoder
from driftwarden.llm.queries import document_edits

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["the", "a", " ", "\n", ".", "x  y", "é", "123", "foo,bar", "  ", "longerword" * 3]


def plain(text):
    return len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)


def test_edits_in_a_row():
    encode, rng = encoder(VOCABULARY), random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 300)))
        pieces = counting.segments(text, 20)
        assert "".join(pieces) == text
        tree = counting.Tree.build([len(s) for s in pieces], counting.counts(encode, pieces))
        doc = counting.Edited(text, tree.chars.tobytes(), tree.tokens.tobytes())
        for _ in range(6):
            start = rng.randint(0, len(doc.text) + 2)
            end, put = start + rng.randint(0, 60), rng.choice(["", " ", "zz", "a b c", "\n", "  ", "w " * 40])
            want = doc.text[:start] + put + doc.text[end:]
            first, last, region = doc.edit(start, end, put)
            new = counting.fitted(region, last - first + 1)
            doc.recount(first, last, new, counting.counts(encode, new))
            assert doc.text == want and doc.tree.chars[1] == len(want)
            assert doc.tree.tokens[1] == len(encode.encode(pa.array([want]))[0])


def test_query_edits_against_full_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    trees = counting.build_trees(docs, VOCABULARY)
    done = counting.apply_edits(trees.withColumn("edits", document_edits()).withColumn("old", F.col("text")), VOCABULARY)
    edits = {r.doc_id: r.edits for r in docs.withColumn("edits", document_edits()).collect()}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for r in done.collect():
        text = r.old
        for e in edits[r.doc_id]:
            text = text[: e.start] + e.put + text[e.end :]
        assert r.text == text and r.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert r.n_encoded < 2500 or r.n_encoded <= len(text)


def test_odd_rows(spark, odd_docs, no_docs):
    trees = counting.build_trees(odd_docs, VOCABULARY)
    assert sorted(r.n_tokens for r in trees.collect()) == sorted(plain(r.text or "") for r in odd_docs.collect())
    kind = "array<struct<start:int,end:int,put:string>>"
    for edits, apply in (
        ("cast(null AS %s)" % kind, lambda t: t),
        ("cast(array() AS %s)" % kind, lambda t: t),
        ("array(named_struct('start', 2, 'end', cast(null AS int), 'put', 'new '), null, named_struct('start', 100000000, 'end', 5, 'put', ' end'))",
         lambda t: (t or "")[:2] + "new " + (t or "")[2:] + " end"),
        ("array(named_struct('start', -5, 'end', 3, 'put', cast(null AS string)))", lambda t: (t or "")[3:]),
    ):
        rows = counting.apply_edits(trees.selectExpr("*", f"{edits} AS edits"), VOCABULARY).collect()
        got = sorted(((r.doc_id, r.text, r.n_tokens) for r in rows), key=repr)
        want = [(r.doc_id, apply(r.text)) for r in odd_docs.collect()]
        assert got == sorted(((i, t, plain(t or "")) for i, t in want), key=repr)
    assert counting.build_trees(no_docs, VOCABULARY).count() == 0


def test_grown_segments_are_split():
    """After a long insertion an edit costs its surroundings again, not the whole insertion."""
    encode, rng = encoder(VOCABULARY), random.Random(5)
    text = " ".join(rng.choice(WORDS) for _ in range(500))
    pieces = counting.segments(text)
    tree = counting.Tree.build([len(s) for s in pieces], counting.counts(encode, pieces))
    doc = counting.Edited(text, tree.chars.tobytes(), tree.tokens.tobytes())

    def edit(start, end, put):
        before = doc.encoded
        first, last, region = doc.edit(start, end, put)
        new = counting.fitted(region, last - first + 1)
        doc.recount(first, last, new, counting.counts(encode, new))
        assert doc.tree.chars[1] == len(doc.text)
        return doc.encoded - before

    edit(700, 710, "some words, " + "word " * 10_000 + " ".join(rng.choice("abcdefg") * 5 for _ in range(30_000)))
    assert max(edit(at, at + 1, "q") for at in [rng.randrange(len(doc.text)) for _ in range(200)]) <= 2000
    for _ in range(3000):  # typing at one place
        edit(5000, 5000, "ab ")
    assert edit(5000, 5001, "c") <= 2000
    edit(100, 150_000, "")
    assert edit(90, 120, " ") <= 2000
    assert doc.tree.tokens[1] == plain(doc.text)
