from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from lodeloom.llm import sharding as m
from lodeloom.llm.sharding import assign_shards, jump_hash


def jump_one(key: int, n: int) -> int:
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_one_key_at_a_time():
    keys = np.array([0, 1, -1, 2**62, *np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)])
    for n in (1, 2, 24, 1000):
        assert jump_hash(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_only_the_new_shard_gains():
    keys = np.arange(20_000)
    old, new = jump_hash(keys, 24), jump_hash(keys, 25)
    assert set(new[old != new]) == {24} and abs((old != new).mean() - 1 / 25) < 0.01


def test_rows_slots_and_odd_rows(odd_docs, no_docs):
    rows, source = assign_shards(odd_docs, 5).collect(), odd_docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), jump_one(r.doc_id or 0, 5), jump_one(r.doc_id or 0, 6)) for r in source)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.law for r in rows} == {"key"}
    assert assign_shards(no_docs).count() == 0


def test_matches_sql(spark, sf, duck):
    from lodeloom.llm import queries

    got = queries.op1_sharding(spark, sf).collect()
    want = duck.execute(queries.oracle_sql()["op1_sharding"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_many_copies_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(m, "RUN", 7)
    docs = spark.createDataFrame([(1, "same")] * 50 + [(2, "other")] * 7 + [(None, None)] * 8, "doc_id long, text string")
    rows = assign_shards(docs).collect()
    assert len(rows) == 65
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
