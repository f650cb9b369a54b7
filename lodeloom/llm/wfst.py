"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

Machines are compiled from a model file: the normaliser (the model's character map, dummy prefix, escaped spaces), the lexicon (an
automaton of pieces whose arcs weigh minus the piece's score), and byte fallback for characters that no piece spells. They
are composed with an input lazily: the normaliser rewrites it, the lexicon's arcs over the rewritten text make a lattice, and
the path of least weight through it in the tropical semiring (weights along a path add up, of paths the least counts) is the encoding.

A unigram model's encoding is that path as it is. A byte-pair model merges in order of rank instead, and a sequence of pieces is
its result just if every piece is what merging makes of its letters and no two neighbours would merge otherwise when together.
For these models an acceptor of such neighbours is composed with the lattice. What merging makes of each beginning of a text is
unique, so the composed machine has one live state at each position, as that of a unigram model has, which needs no memory of the last piece.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import batch_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Weight of an unknown character over the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Chunks whose pieces a task remembers; the fits of pairs of pieces are forgotten with them.
MEMO = 400_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, raw[at : at + size]
        at += size


class CharacterMap:
    """A model's precompiled character map: the longest key that stands at a position gives way to its value.

    Keys are in a double array of bytes: a unit has a label, an offset to its children, and a mark that a value follows.
    """

    def __init__(self, raw: bytes):
        size = struct.unpack("<I", raw[:4])[0]
        self.units, self.values = np.frombuffer(raw[4 : 4 + size], "<u4").tolist(), raw[4 + size :]
        self.begins: dict[str, bool] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Where the longest key that begins at a byte ends, and its value."""
        units, found, node = self.units, None, 0
        offset = lambda unit: unit >> 10 << ((unit & 1 << 9) >> 6)
        node ^= offset(units[0])
        for end in range(at, len(raw)):
            node ^= raw[end]
            if node >= len(units) or units[node] & 0x800000FF != raw[end]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = end + 1, self.values[value : self.values.index(b"\0", value)].decode()
        return found

    def begins_key(self, c: str) -> bool:
        """Whether the character's first bytes lead anywhere, so that a key may begin with it."""
        known = self.begins.get(c)
        if known is None:
            known = self.begins[c] = self.leads(c.encode())
        return known

    def leads(self, raw: bytes) -> bool:
        units, node = self.units, 0
        unit = units[0]
        for b in raw:
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6) ^ b
            if node >= len(units) or units[node] & 0x800000FF != b:
                return False
            unit = units[node]
        return True

    def rewrite(self, text: str) -> str:
        if not any(map(self.begins_key, set(text))):
            return text
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            found = self.longest(raw, at)
            end, new = found or (at + size, raw[at : at + size].decode())
            out.append(new)
            at = end
        return "".join(out)


class Transducer:
    """Normaliser, lexicon and byte fallback of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        pieces = [dict(fields(v)) for n, v in model if n == 1]
        trainer = dict(fields(next((v for n, v in model if n == 2), b"")))
        rules = dict(fields(next((v for n, v in model if n == 3), b"")))
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.kind, self.prefix, self.squeeze, self.escape = trainer.get(3, UNIGRAM), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a byte-pair model")
        self.text = [p.get(1, b"").decode() for p in pieces]
        self.score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.type = [p.get(3, NORMAL) for p in pieces]
        self.id_of = {t: i for i, (t, k) in enumerate(zip(self.text, self.type, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.type, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, k in enumerate(self.type) if k == UNKNOWN), 0)
        self.worst = min((self.score[i] for i in self.id_of.values()), default=0.0)
        self.rank = {t: self.score[i] for t, i in self.id_of.items()}
        self.fits: dict[str, dict[str, bool]] = {}
        self.memo: dict[str, bytes] = {}
        self.lexicon = self.compiled({t: -w for t, w in self.rank.items() if self.kind != BPE or self.merged(t) == [t]})
        # an input can be cut between two characters that no piece has side by side; the cuts hold for every path
        inside = {t[i : i + 2] for t in self.id_of for i in range(len(t) - 1)}
        self.inside = frozenset(inside)
        words_only = all(SPACE not in t.lstrip(SPACE) for t in self.id_of)
        alone = "" if any("\n" in t and len(t) > 1 for t in self.id_of) else "\n"
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else "")) if words_only else None
        shown = [t.replace(SPACE, " ").encode() for t in self.text]
        self.shown = [bytes([self.byte_of[i]]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else shown[i] for i, k in enumerate(self.type)]

    def compiled(self, weights: dict[str, float]) -> ahocorasick.Automaton:
        """The lexicon: an automaton that follows all pieces in a text at once; each arc has its piece, length and weight."""
        self.singles = frozenset(t for t in weights if len(t) == 1)
        lexicon = ahocorasick.Automaton()
        for t, w in weights.items():
            lexicon.add_word(t, (t, len(t), w))
        lexicon.make_automaton()
        return lexicon

    def normalise(self, text: str) -> str:
        if self.map:
            text = self.map.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, letters: str) -> list[str]:
        """What merging makes of a short string: always the neighbours whose union has the best score, leftmost first."""
        parts, rank = list(letters), self.rank
        while len(parts) > 1:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are next to each other."""
        union = a + b
        return not a or union[len(a) - 1 : len(a) + 1] not in self.inside or (union not in self.id_of and self.merged(union) == [a, b])

    def arcs(self, text: str) -> Iterable[tuple[int, tuple[str, int, float]]]:
        """Arcs of the lattice over a text as (last position, (piece, length, weight)), in order of position; those of
        characters that no piece spells lead to the byte fallback."""
        found = self.lexicon.iter(text)
        if self.singles.issuperset(text):
            return found
        alone = UNKNOWN_PENALTY - self.worst
        return heapq.merge(found, [(i, (c, 1, alone)) for i, c in enumerate(text) if c not in self.singles], key=lambda arc: arc[0])

    def shortest_path(self, text: str) -> list[str]:
        """Pieces along the lightest path from the start of a normalised text to its end, by the tropical semiring.

        A state is a position, with the piece that led there if the model merges, as the acceptor then asks for it. Arcs come
        in order of their ends, so that a state's weight is final before an arc leaves it.
        """
        size, far = len(text), float("inf")
        weight, piece_to = [0.0, *[far] * size], ["", *[""] * size]
        if self.kind == BPE:
            fits, fit = self.fits, self.fit
            after = [fits.setdefault("", {}), *[fits] * size]  # what the acceptor knows of each state's piece
            for last, (piece, length, w) in self.arcs(text):
                at = last + 1 - length
                through = weight[at] + w
                if through < weight[last + 1]:
                    known = after[at]
                    fitting = known.get(piece)
                    if fitting is None:
                        fitting = known[piece] = fit(piece_to[at], piece)
                    if fitting:
                        weight[last + 1], piece_to[last + 1] = through, piece
                        after[last + 1] = fits.get(piece) or fits.setdefault(piece, {})
        else:
            for last, (piece, length, w) in self.arcs(text):
                through = weight[last + 1 - length] + w
                if through < weight[last + 1]:
                    weight[last + 1], piece_to[last + 1] = through, piece
        out, at = [], size
        while at:
            out.append(piece_to[at])
            at -= len(piece_to[at])
        return out[::-1]

    def ids_of_piece(self, piece: str) -> list[int]:
        known = self.id_of.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def chunk_ids(self, chunk: str) -> bytes:
        out, start, memo = [], 0, self.memo
        for end in [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.inside] + [len(chunk)]:
            part, start = chunk[start:end], end
            known = memo.get(part)
            if known is None:
                known = memo[part] = array("I", [i for p in self.shortest_path(part) for i in self.ids_of_piece(p)]).tobytes()
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        text = self.normalise(text)
        if self.chunk is None:
            return np.frombuffer(self.chunk_ids(text), np.uint32)
        memo, chunks = self.memo, self.chunk.findall(text)
        if len(memo) > MEMO:
            memo.clear()
            self.fits.clear()
        for c in set(chunks).difference(memo):
            memo[c] = self.chunk_ids(c)
        return np.frombuffer(b"".join([memo[c] for c in chunks]), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell: pieces joined, byte pieces as UTF-8 (what is none becomes U+FFFD), control pieces left out."""
        shown = self.shown
        text = b"".join([shown[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.cache
def transducer(path: str) -> Transducer:
    """One a Python worker."""
    return Transducer(path)


ENCODED = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column ids (array of int), null where the text is null; all columns stay."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = transducer(path)
        return texts.map(lambda t: own.encode(t).astype(np.int32), na_action="ignore")

    return docs.withColumn("ids", ids(F.col("text").cast("string")))


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """rows with a column decoded, from their column ids; null where ids are null; all columns stay."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        own = transducer(path)
        return ids.map(lambda i: own.decode(np.asarray(i)), na_action="ignore")

    return rows.withColumn("decoded", texts(F.col("ids")))


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to: counts, CRC-32 of the little-endian 32-bit ids and of the UTF-8
    of the decoded text, and whether that is the text again (it is not where the text has U+2581 itself).

    A null text counts as empty; doc_id is carried as it is; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        first_byte, last_byte = (min(own.byte_of), max(own.byte_of)) if own.byte_of else (0, -1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids, text = own.encode(text or ""), text or ""
                back = own.decode(ids)
                rows.append((doc_id, len(ids), int(((ids >= first_byte) & (ids <= last_byte)).sum()), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text))
            yield batch_of(rows, ENCODED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)
