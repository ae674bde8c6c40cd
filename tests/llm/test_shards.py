import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwarden.llm import shards
from driftwarden.llm.mph import Bucket, PerfectHash, index_bytes, ENTRY
from driftwarden.plans.scale import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def test_strangers_are_refused_by_fingerprint():
    keys = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(7919)
    entries = np.zeros(len(keys), ENTRY)
    entries["ordinal"] = np.arange(len(keys))
    bucket = Bucket(index_bytes(keys, entries))
    known, found = bucket.find(keys)
    assert known.all() and found["ordinal"].tolist() == list(range(len(keys)))
    known, _ = bucket.find(keys + np.uint64(1))
    assert known.sum() == 0


def stored_rows(spark, docs, path):
    shards.write_store(docs, path, VOCABULARY, end_id=2)
    return shards.read_store(spark, path, docs).withColumn("crc", F.crc32("ids")).collect()


def test_store_against_plain_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in stored_rows(spark, docs, scratch_path(spark, "store"))}
    plain, start = Tokenizer.from_file(VOCABULARY), 0
    for row in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(row.text or "", add_special_tokens=False).ids, 2]
        got = found.pop(row.doc_id)
        assert (got.start, len(got.ids) // 4, got.crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found


def test_odd_rows(spark, odd_docs):
    rows = stored_rows(spark, odd_docs, scratch_path(spark, "store"))
    assert len(rows) == odd_docs.count()
    plain = Tokenizer.from_file(VOCABULARY)
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd_docs.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert got == want
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [len(r.ids) // 4 for r in by_start])[:-1].tolist()
    keys = [r.doc_id for r in by_start]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_unknown_keys_and_empty_store(spark, odd_docs, no_docs):
    path = scratch_path(spark, "store")
    shards.write_store(odd_docs, path, VOCABULARY, end_id=2)
    asked = spark.createDataFrame([(1,), (1,), (4242,), (9,)], "doc_id long")
    assert sorted(r.doc_id for r in shards.read_store(spark, path, asked).collect()) == [1, 9]
    path = scratch_path(spark, "store")
    shards.write_store(no_docs, path, VOCABULARY, end_id=2)
    assert shards.read_store(spark, path, asked).count() == 0


def test_a_key_over_several_shards(spark):
    rows = [(4, f"text {i}") for i in range(300)] + [(i, "other") for i in range(300) if i != 4]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = stored_rows(spark, docs, scratch_path(spark, "store"))
    assert sum(r.doc_id == 4 for r in found) == 300 and len({(r.doc_id, r.start) for r in found}) == 599
