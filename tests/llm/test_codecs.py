"""FLAC and the SentencePiece transducer: round trips, hand-made streams, damage, and the library's own ids."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodeloom.llm import flac, wfst

TEXTS = ["", None, "a" * 5000, "x\xff€" * 999, "".join(map(chr, np.random.default_rng(1).integers(0, 128, 3000)))]


class Writer:
    """Bits of a hand-made frame."""

    def __init__(self):
        self.bits = ""

    def put(self, n: int, width: int) -> Writer:
        self.bits += format(n & (1 << width) - 1, f"0{width}b") if width else ""
        return self

    def rice(self, residual: int, k: int) -> Writer:
        folded = 2 * residual if residual >= 0 else -2 * residual - 1
        self.bits += "0" * (folded >> k) + "1"
        return self.put(folded, k)

    def bytes(self) -> bytes:
        b = self.bits + "0" * (-len(self.bits) % 8)
        return int(b, 2).to_bytes(len(b) // 8, "big")


def crc(data: bytes, bits: int) -> int:
    a = np.frombuffer(data, np.uint8)
    return int(flac.crc_of_ranges(a, np.array([0]), np.array([len(a)]), bits)[0])


def frame(subframes: Writer, block: int, assignment: int, size_code: int) -> bytes:
    head = Writer().put(0xFFF8, 16).put(7, 4).put(0, 4).put(assignment, 4).put(size_code, 3).put(0, 1).put(0, 8).put(block - 1, 16).bytes()
    head += bytes([crc(head, 8)])
    whole = head + subframes.bytes()
    return whole + crc(whole, 16).to_bytes(2, "big")


def stream(frames: bytes, samples: np.ndarray, bits: int) -> bytes:
    packed = 8000 << 44 | (len(samples) - 1) << 41 | (bits - 1) << 36 | samples.shape[1]
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(flac.pcm_bytes(samples, bits)).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frames


def test_payloads_come_back():
    payloads = [flac.payload_of(t) for t in TEXTS]
    streams = flac.encode(payloads)
    assert flac.decode_many(streams) == payloads
    for p, s in zip(payloads, streams, strict=True):
        samples, head = flac.decode(s)
        assert ((samples[0] + 128).astype(np.uint8).tobytes()) == p
        without_seek = b"fLaC\x80" + s[5:42] + s[head.first :]
        assert (flac.decode(without_seek)[0] == samples).all()
    assert (flac.read_at(streams[2], 1000, 600)[0] + 128 == ord("a")).all()


def test_linear_predictor_wasted_bits_escape_and_stereo():
    """Left by a two-tap predictor over two partitions, one escaped; the side channel by a fixed predictor with one wasted bit."""
    rng = np.random.default_rng(4)
    left, diff = np.cumsum(rng.integers(-9, 9, 16)), 2 * np.cumsum(rng.integers(-3, 3, 16))
    right = left - diff
    w = Writer().put(0b01000010, 8)  # linear, order 2 -> kind 33
    w.bits = ""
    w.put((32 + 1) << 1, 8)
    for x in left[:2]:
        w.put(int(x), 16)
    w.put(6 - 1, 4).put(1, 5).put(3, 6).put(-1, 6)
    guess = [(3 * int(left[i - 1]) - int(left[i - 2])) >> 1 for i in range(2, 16)]
    residual = [int(left[i]) - guess[i - 2] for i in range(2, 16)]
    w.put(0, 2).put(1, 4).put(3, 4)
    for r in residual[:6]:
        w.rice(r, 3)
    w.put(15, 4).put(9, 5)
    for r in residual[6:]:
        w.put(r, 9)
    half = diff >> 1
    w.put((8 + 1) << 1 | 1, 8).put(1, 1).put(int(half[0]), 16)  # fixed order 1, one wasted bit, a side channel has 17 bits
    w.put(1, 2).put(0, 4).put(2, 5)
    for r in np.diff(half):
        w.rice(int(r), 2)
    samples = np.stack([left, right])
    got, head = flac.decode(stream(frame(w, 16, 8, 4), samples, 16))
    assert (got == samples).all() and head.channels == 2


@pytest.mark.parametrize("at", [-1, -200, -5000])
def test_damage_is_found(at):
    s = bytearray(flac.encode([flac.payload_of("some text to store " * 500)])[0])
    s[at] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode(bytes(s))


def test_flac_rows(odd_docs, no_docs):
    rows, texts = flac.store_and_read(odd_docs).collect(), [r.text for r in odd_docs.collect()]
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted((len((t or "").encode()), hashlib.sha256(p := flac.payload_of(t)).hexdigest(), zlib.crc32(p[-32:])) for t in texts)
    blocks = flac.pcm_blocks(flac.encode_texts(odd_docs), frames=2).where("doc_id = 5").orderBy("first_sample").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).translate(flac.FLIP) == flac.payload_of(texts[7])
    assert [b.first_sample for b in blocks] == list(range(0, len(blocks) * 2 * flac.BLOCK, 2 * flac.BLOCK))
    assert flac.store_and_read(no_docs).count() == 0


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_texts_are_the_librarys(spark, sf):
    own, library, rng = wfst.Transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(0)
    odd = ["", " ", "  ", "Hello  wörld \n x😀 ", "ﬁ Å ①\t\ttabs\r\n\x0b\x00z", "    def f(x):\n        return x  # …", "<s> </s> <unk> <0x0A>", "日本語のテキスト 한국어 العربية", "x" * 50, "aaaaaaa 1234567890", "▁▁ a▁b", "​z﻿"]
    odd += ["".join(rng.choice("abcdethion sr,.ñé1 \n") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    odd += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for text in odd:
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, int)) == library.decode(ids)


def message(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message; sizes below 2^28."""

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model made by hand, with byte fallback and the character map of a public normaliser rule."""
    rng = random.Random(1)
    pieces = [("<unk>", 0.0, wfst.UNKNOWN), ("<s>", 0.0, wfst.CONTROL), *((f"<0x{b:02X}>", 0.0, wfst.BYTE) for b in range(256))]
    words = {"▁", *"abcdeé1カ", *("".join(rng.choice("▁abcde1é") for _ in range(rng.randint(2, 5))) for _ in range(150))}
    pieces += [(w, -rng.random() * 9 - 1, wfst.NORMAL) for w in sorted(words)]
    raw = b"".join(message(1, message(1, t.encode()) + message(2, w) + message(3, k)) for t, w, k in pieces)
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    rule = next(v for n, v in wfst.fields(rule) if n == 3)
    raw += message(2, message(3, wfst.UNIGRAM) + message(35, 1)) + message(3, bytes(rule))
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(raw)
    return str(path)


def test_unigram_models_take_the_lightest_path_after_their_character_map(unigram):
    own, library, rng = wfst.Transducer(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram), random.Random(2)
    odd = ["", "  ", "Ａｂ①  ﬁx ｱﾞ é", "e\u0301a \u00a0b", "カ\u3099\tab\n\x00 c", "😀 a\u200bb", "a" * 40]
    odd += ["".join(rng.choice("abcde1é ") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    for text in odd:
        got, ids = own.encode(text).tolist(), library.encode(text)
        assert own.normalise(text) == library.normalize(text)
        weight = lambda x: sum(own.score[i] for i in x)
        assert got == ids or abs(weight(got) - weight(ids)) < 1e-4  # paths of equal weight


def test_lightest_paths_against_all_segmentations(unigram):
    own, rng = wfst.Transducer(unigram), random.Random(3)

    def every(text):
        if not text:
            yield 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in own.rank:
                yield from (w - own.rank[text[:n]] for w in every(text[n:]))

    for _ in range(200):
        text = "".join(rng.choice("▁abcde1é") for _ in range(rng.randint(1, 9)))
        assert abs(sum(-own.rank[p] for p in own.shortest_path(text)) - min(every(text))) < 1e-9


def test_piece_rows(odd_docs, no_docs):
    rows = wfst.encode_and_decode(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows if r.doc_id != 8)
    both = wfst.decode_ids(wfst.encode_texts(odd_docs, PATH), PATH).collect()
    assert all(r.decoded == r.text for r in both if r.doc_id != 8) and wfst.encode_and_decode(no_docs, PATH).count() == 0
