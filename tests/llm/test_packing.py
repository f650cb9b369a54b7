from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodeloom.llm import packing as m

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_fit_against_a_list_of_windows():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(0, 200))
        bins, offsets = m.best_fit_decreasing(lengths, 100)
        rooms: list[int] = []
        want = Counter()
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if not fit:
                rooms.append(100)
                fit = [len(rooms) - 1]
            best = min(fit, key=lambda i: rooms[i])
            rooms[best] -= n
        want = Counter(rooms)
        used = np.bincount(bins, lengths, len(rooms)).astype(int) if len(lengths) else np.array([], int)
        assert Counter((100 - used).tolist()) == want
        for b in set(bins.tolist()):
            own = sorted((int(offsets[i]), int(lengths[i])) for i in np.flatnonzero(bins == b))
            assert all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0


def test_ids_are_the_tokenizers():
    tokenizer, own = Tokenizer.from_file(PATH), m.Encoder(PATH)
    odd = ["", "  a  b\n\n c d é İ Σας x\ty 1234 don't <|endoftext|>hi a_b__c ½²ª º µ\xad¶  x ŉſK ÀÉ́ WE'LL's\x1cx\x85y \x00", "日本語 ﬁ", "é ß ẞ ǅ"]
    odd += [chr(c) for c in range(0x250)] + [f"a{chr(c)}b" for c in range(0x250)]
    ids, borders = own.encode(pa.array([*odd, None]))
    for i, text in enumerate([*odd, ""]):
        assert ids[borders[i] : borders[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


def check(rows, source, most_padding=None) -> None:
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in source:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((doc_id, at, len(c := ids[at : at + m.WINDOW]), zlib.crc32(c.tobytes()), len(ids)) for at in range(0, len(ids), m.WINDOW))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= m.WINDOW
    if most_padding is not None:
        assert 1 - sum(r.length for r in rows) / (len(windows) * m.WINDOW) < most_padding


def test_pieces_and_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(m.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 0.02)


def test_odd_rows(odd_docs, no_docs):
    check(m.pack(odd_docs, PATH, group_docs=4).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert m.pack(no_docs, PATH).count() == 0
