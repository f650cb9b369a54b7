from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeloom.llm import mixing
from lodeloom.llm import token_store as m
from lodeloom.llm.common import holding

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, tokenizer) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) of rows that are in order already."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [1, 7, 256, 2048])
def test_blocks_round_trip(block):
    rng = np.random.default_rng(3)
    cases = [np.zeros(0, int), np.zeros(700, int), np.full(300, 65535), rng.integers(0, 65536, 900), rng.geometric(0.01, 3000) % 65536, np.tile(rng.integers(0, 50000, 37), 60)]
    for ids in cases:
        coded = mixing.encode_blocks(ids, block)
        sizes = [min(block, len(ids) - i) for i in range(0, len(ids), block)]
        assert len(coded) == len(sizes)
        assert np.array_equal(np.concatenate([np.zeros(0, int), *mixing.decode_blocks(coded, np.array(sizes, int))]), ids)


def test_blocks_are_independent_and_learn():
    ids = np.tile(np.arange(50) * 997 % 50_000, 200)
    coded = mixing.encode_blocks(ids, 2000)
    assert np.array_equal(mixing.decode_blocks([coded[3]], np.array([2000]))[0], ids[6000:8000])
    assert sum(map(len, coded)) < len(ids) * 2 / 8  # a passage that repeats costs little
    assert coded[0] == coded[1]  # each begins anew, and 2000 is a whole number of passages


def test_order_1_is_right_when_it_is_least_likely():
    """Ids chosen against the model: neither named id is right, then order 2 always is, so that order 1, always wrong, is least likely when it comes true."""
    rng, lanes, least = np.random.default_rng(0), 8, 1 << 16
    model, ids = mixing.Model(lanes), np.zeros((mixing.BLOCK, lanes), np.int64)
    for n, step in enumerate(ids):
        _, f1 = model.predict()
        if n < 1200:
            step[:] = rng.integers(0, 8, lanes)
            while (named := (step == model.named).any(0)).any():
                step[named] = rng.integers(0, 8, int(named.sum()))
        else:
            step[:] = 5 if n % 2 else 1000 + n // 2 % 20
            odd = model.asks[1] & (f1 <= 16) & (n > 1900)
            step[odd] = model.named[1][odd]
            least = min(least, int(f1[model.asks[1]].min(initial=least)))
        right = (model.named == step) & model.asks
        which = np.where(right[0], 0, np.where(right[1], 1, 2))
        model.learn(step.copy(), which)
        rest = np.flatnonzero(which == 2)
        for table, byte in ((rest * model.tables, step[rest] >> 8), (model.low_table(rest, step[rest] >> 8), step[rest] & 255)):
            model.span(table, byte)
    assert least <= 16
    coded = mixing.encode_blocks(ids.T.reshape(-1))
    assert np.array_equal(np.stack(mixing.decode_blocks(coded, np.full(lanes, mixing.BLOCK))), ids.T)


def test_carries_and_refusals(monkeypatch):
    monkeypatch.setattr(mixing, "LANES", 3)
    ids = np.random.default_rng(0).integers(0, 300, 5000)
    coded = mixing.encode_blocks(ids, 100)
    assert np.array_equal(np.concatenate(mixing.decode_blocks(coded, np.full(50, 100))), ids)
    with pytest.raises(ValueError):
        mixing.encode_blocks(np.array([65536]))
    with pytest.raises(ValueError):
        mixing.encode_blocks(ids, 5000)


def test_ids_are_the_librarys(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " ", "a  b\n\n c", "don't we'll I'M 12³ x²½", "<|endoftext|> <| in text", "日本語 😀", "a\x1cb\x85c\xa0d e", "ſŉǅ ªº ʼn·", "tab\t\t x\r\n", "‘q’ “q” – — … ‧"]
    tokenizer = Tokenizer.from_file(PATH)
    got = m.ByteLevel(PATH).encode(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_table(spark, sf):
    from lodeloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs), key=lambda r: r[0])
    got = queries.op11_token_store(spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, Tokenizer.from_file(PATH))


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, m.store_and_read_tokens(odd_docs, PATH).collect()), key=lambda r: r[1])
    hashes = odd_docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashes, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    assert got == brute(rows, Tokenizer.from_file(PATH))
    assert m.store_and_read_tokens(no_docs, PATH).count() == 0


def test_files_segments_ranges_and_damage(spark, monkeypatch):
    texts = [f"document {i} says {'again and ' * (i % 40)}{i * i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(PATH)
    want = [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    segment, part = m.Segment(), b""
    encoder = m.ByteLevel(PATH)
    with holding() as own:
        folder = m.shared_folder(spark, "test")
        out = m.PartFile(folder)
        for i, ids in enumerate(encoder.encode(texts)):
            segment.add(i, ids + b"\0\0")
            if i % 90 == 89:
                out.write(segment)
                segment = m.Segment()
        out.first = (0, 0, 0)
        out.write(segment)
        out.close()
        for first, count in ((0, 1), (5, 1000), (len(want) - 3, 10), (250, 3000), (0, len(want))):
            assert m.read_range(out.uri, first, count).tolist() == want[first : first + count]
        path = out.uri.removeprefix("file:")
        part = bytearray(open(path, "rb").read())
        part[-5] ^= 1
        open(path, "wb").write(part)
        with pytest.raises(ValueError, match="checksum"):
            m.read_range(out.uri, len(want) - 2, 1)
        assert m.read_range(out.uri, 0, 5).tolist() == want[:5]  # other blocks are still readable
        manifest = m.held(m.write_tokens(docs, PATH, folder), "test-manifest")
        assert sum(r.n_ids for r in manifest.collect()) == len(want)
        own.drop(spark)
    import os

    assert not os.path.exists(path)


def test_one_id_on_many_rows(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(500)] + [(1, "first"), (9, "last")], "doc_id long, text string").repartition(8)
    got = sorted(map(tuple, m.store_and_read_tokens(docs, PATH).collect()), key=lambda r: r[1])
    assert len(got) == 502 and got[0][0] == 1 and got[-1][0] == 9
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
