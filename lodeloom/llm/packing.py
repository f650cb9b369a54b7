"""Packing token pieces into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows. What remains of each document goes, longest first,
into the open window with the least room that still takes it; a segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
#: Documents that are packed together. A group is one task's work; groups are packed independently.
GROUP_DOCS = 8192
#: Runs of letters or signs whose ids a task remembers.
MEMO = 300_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Segment tree over capacities 0..window: how many open windows have each, and the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least need, or None."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; every length is 1 to window. Ties go by position, so results are stable."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(window), 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, which = found
        bins[i], offsets[i] = which, window - room
        if room > n:
            tree.add(room - n, which)
    return bins, offsets


class Encoder:
    """Token ids of whole texts by a public tokenizer file of the lower-case, white-space-dropping kind.

    No token of it spans white space or the border of a run of letters, so a text's ids are those of its chunks, joined.
    A batch's distinct chunks are found by Arrow; those of common Latin letters are split into runs here, and the ids
    of runs are remembered, up to MEMO of them. All other chunks go through the tokenizer's own normaliser.
    """

    #: Runs as the tokenizer's own pattern cuts them, for characters up to U+017F but U+0130.
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+|\n")
    PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*")

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.as_printed = {b: chr(moved.get(b, b)) for b in range(256)}
        self.memo: dict[str, bytes] = {}

    def run_ids(self, run: str) -> bytes:
        printed = run if run.isascii() else run.encode().decode("latin-1").translate(self.as_printed)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(printed)]).tobytes()

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has. No chunk is empty or holds white space of ASCII."""
        plain = [bool(self.PLAIN.fullmatch(c)) and "<|" not in c for c in chunks]
        known, memo = [c if p else "" for c, p in zip(chunks, plain, strict=True)], self.memo
        runs = self.RUNS.findall("\n".join(known).lower())
        if len(memo) > MEMO:
            memo.clear()
        memo["\n"] = b""
        for run in set(runs).difference(memo):
            memo[run] = self.run_ids(run)
        per_run = [memo[r] for r in runs]
        so_far = np.cumsum([0, *map(len, per_run)]) // 4
        breaks = np.fromiter((i for i, r in enumerate(runs) if r == "\n"), np.int64)
        borders = np.concatenate([[0], so_far[breaks], so_far[-1:]])[: len(chunks) + 1]
        flat, sizes = np.frombuffer(b"".join(per_run), np.uint32), np.diff(borders)
        if not all(plain):
            odd = [i for i, p in enumerate(plain) if not p]
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([chunks[i] for i in odd], add_special_tokens=False)]
            flat = np.insert(flat, np.repeat(borders[odd], [len(g) for g in got]), np.concatenate(got))
            sizes[odd] = [len(g) for g in got]
        return flat, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by the end id; and where each text's begin (and the last end). A null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        flat, sizes = self.chunk_ids(chunks) if chunks else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # the end id counts as one more chunk, which stands after each text's own
        flat, sizes = np.append(flat, np.uint32(self.end)), np.append(sizes, 1)
        after = split.offsets.to_numpy() - split.offsets[0].as_py()
        which = np.insert(coded.indices.to_numpy(), after[1:], len(chunks))
        starts, lengths = np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        kind = np.int32 if max(ends[-1], len(flat)) < 2**31 else np.int64
        at = np.repeat((starts[which] - ends[:-1]).astype(kind), lengths)
        at += np.arange(len(at), dtype=kind)
        return flat[at], ends[after + np.arange(len(after))]


@functools.cache
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def cut_into_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each document: full windows from its start, then the rest.

    salt tells apart rows that repeat a doc_id within a task, so that they spread over groups.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int | None, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                ids, borders = encoder(tokenizer).encode(part["text"])
                ids, out = ids.astype("<u4"), []
                for doc_id, start, end in zip(part["doc_id"].to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    salt = seen[doc_id] = seen.get(doc_id, -1) + 1
                    for at in range(start, end, window):
                        cut = ids[at : min(at + window, end)]
                        out.append((doc_id, at - start, len(cut), zlib.crc32(cut), end - start, salt))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])
        encoder(tokenizer).memo.clear()  # the worker lives on and has other tasks

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack all documents into sequences of at most window tokens.

    Documents are dealt by a hash of id, repetition and length into groups of about group_docs, and each group is packed by
    best-fit decreasing; a sequence lies within one group. Only piece descriptions are shuffled, no ids or texts.
    A null or empty text is its end id alone; a null doc_id stays null; equal rows are packed each; other columns
    are ignored. An empty table gives none.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        pdf["sequence_id"] = bins + (int(key[0]) << 40)
        pdf["offset"] = offsets
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    cut = cut_into_pieces(docs, tokenizer, window)
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "salt", "doc_tokens", F.floor(F.col("start") / F.lit(window * 64))), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(fill, PACKED)
