"""Token ids in files: a folder of part files whose ids are coded by the mixing range coder, and their readers.

A part file is the magic, then segments. All numbers are little-endian. A segment is a head (HEAD: mark, documents, ids, ids
of a block, blocks, CRC-32 of the index), an index (the documents' ids, whether they are null, how many token ids each has;
and for each block its bytes, the CRC-32 of these and the CRC-32 of its token ids as 32-bit integers), and the blocks. A block
is decoded without any other, so a reader takes only those that hold the ids it wants.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.llm.common import held, shared_folder
from lodeloom.llm.mixing import BLOCK, decode_blocks, encode_blocks
from lodeloom.llm.packing import slices

MAGIC, HEAD = b"LOOMIDS2", struct.Struct("<4sIQIII")
MARK = b"SEGM"
END_ID = 0
#: Ids of a segment, after which the next begins at a document's border; bytes of a file, after which the next begins.
SEGMENT_IDS, FILE_BYTES = 4_000_000, 256_000_000
#: Pieces of text whose ids a worker remembers, from task to task.
MEMO = 400_000

MANIFEST = "file string, first_id long, first_hash long, first_row long, n_docs long, n_ids long"
STORED = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ByteLevel:
    """Token ids of texts by a public tokenizer file of the byte-level kind, which drops nothing and adds nothing.

    Such a tokenizer cuts a text by one pattern and no token spans a cut, so the ids of pieces can be remembered. Texts of
    characters that the pattern's classes have long agreed on are cut here; all others go through the library whole.
    """

    # Letters and numbers up to U+024F, as Unicode has them; the pattern is the tokenizer's own.
    LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
    SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        printed = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                found = array("H", [t.id for t in tokenizer.model.tokenize("".join(map(printed.__getitem__, piece.encode())))]).tobytes()
                self[piece] = found
                return found

        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the coder takes ids below 65536")
        self.memo = Memo()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 16-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        get, cut, out = self.memo.__getitem__, self.PIECES.findall, []
        odd = []
        for i, text in enumerate(texts):
            if "<|" in text or not self.SETTLED.fullmatch(text):
                odd.append(i)
                out.append(b"")
            else:
                out.append(b"".join(map(get, cut(text))))
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = array("H", e.ids).tobytes()
        return out


@functools.cache
def byte_level(path: str) -> ByteLevel:
    """One a Python worker."""
    return ByteLevel(path)


@dataclass
class Segment:
    """Documents with their ids, as they stand in a file."""

    doc_ids: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    n_ids: int = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 2)
        self.parts.append(ids)
        self.n_ids += len(ids) // 2

    def to_bytes(self) -> Iterator[bytes]:
        ids = np.frombuffer(b"".join(self.parts), np.uint16).astype("<u4")
        # a small segment has smaller blocks, as blocks are coded side by side
        block = max(256, min(BLOCK, -(-len(ids) // 256)))
        coded = encode_blocks(ids, block)
        index = b"".join((
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is None for d in self.doc_ids], np.uint8).tobytes(),
            np.array(self.lengths, "<u8").tobytes(),
            np.array([(len(c), zlib.crc32(c), zlib.crc32(ids[i * block : (i + 1) * block])) for i, c in enumerate(coded)], "<u4").tobytes(),
        ))
        yield HEAD.pack(MARK, len(self.lengths), len(ids), block, len(coded), zlib.crc32(index))
        yield index
        yield from coded


@dataclass
class Index:
    """What a segment's head and index say; the blocks begin at `at` in the file."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    block: int
    blocks: np.ndarray
    at: int

    @property
    def n_ids(self) -> int:
        return int(self.lengths.sum())

    @property
    def end(self) -> int:
        return self.at + int(self.blocks[:, 0].sum())

    def ids(self, source: BinaryIO, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last (exclusive), read and verified."""
        some = self.blocks[first:last].astype(np.int64)
        source.seek(self.at + int(self.blocks[:first, 0].sum()))
        data, ends = source.read(int(some[:, 0].sum())), np.cumsum(some[:, 0])
        coded = [data[e - n : e] for e, n in zip(ends.tolist(), some[:, 0].tolist(), strict=True)]
        if [zlib.crc32(c) for c in coded] != some[:, 1].tolist():
            raise ValueError("a block's bytes don't match their checksum")
        sizes = np.minimum(self.block, self.n_ids - self.block * np.arange(first, first + len(some)))
        got = [g.astype("<u4") for g in decode_blocks(coded, sizes)]
        if [zlib.crc32(g) for g in got] != some[:, 2].tolist():
            raise ValueError("a block's ids don't match their checksum")
        return np.concatenate(got) if got else np.zeros(0, "<u4")


def read_indexes(source: BinaryIO, size: int) -> Iterator[Index]:
    """The segments of a part file in order; the blocks are skipped."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    while at < size:
        source.seek(at)
        mark, docs, n_ids, block, blocks, crc = HEAD.unpack(source.read(HEAD.size))
        index = source.read(docs * 17 + blocks * 12)
        if mark != MARK or zlib.crc32(index) != crc:
            raise ValueError("a segment's index doesn't match its checksum")
        nulls = np.frombuffer(index, np.uint8, docs, docs * 8)
        found = Index(
            [None if null else d for d, null in zip(np.frombuffer(index, "<i8", docs).tolist(), nulls.tolist(), strict=True)],
            np.frombuffer(index, "<u8", docs, docs * 9).astype(np.int64), block,
            np.frombuffer(index, "<u4", blocks * 3, docs * 17).reshape(-1, 3), at + HEAD.size + len(index),
        )
        if found.n_ids != n_ids:
            raise ValueError("a segment's index doesn't match its head")
        at = found.end
        yield found


def open_file(uri: str) -> tuple[BinaryIO, int]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path), fs.get_file_info(path).size


def read_range(uri: str, first: int, count: int) -> np.ndarray:
    """Ids first to first + count of a part file; only the blocks that hold them are read."""
    source, size = open_file(uri)
    out, before = [], 0
    with source:
        for index in read_indexes(source, size):
            low, high = max(0, first - before), min(index.n_ids, first + count - before)
            if low < high:
                begin = low // index.block
                got = index.ids(source, begin, -(-high // index.block))
                out.append(got[low - begin * index.block : high - begin * index.block])
            before += index.n_ids
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class PartFile:
    """A file that one attempt of a task writes. Its name is the attempt's own, so that a repeated task harms nothing."""

    def __init__(self, folder: str):
        self.uri, self.first, self.n_docs, self.n_ids, self.n_bytes = f"{folder}/part-{uuid.uuid4().hex}.ids", None, 0, 0, 0
        fs, path = pafs.FileSystem.from_uri(self.uri)
        self.out = fs.open_output_stream(path)
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def write(self, segment: Segment) -> None:
        for data in segment.to_bytes():
            self.put(data)
        self.n_docs += len(segment.lengths)
        self.n_ids += segment.n_ids

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = (self.uri, *self.first, self.n_docs, self.n_ids)
        kinds = [pa.string()] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents, each followed by end_id, to part files in a folder; one row for each file.

    Documents stand in ascending order of doc_id (nulls first, then by a hash of the text), within a file and from file to
    file in the order of (first_id, first_hash, first_row). Rows that share an id spread over tasks: the rank of a row in its
    input partition ends the key. The rows returned name only files of attempts that succeeded; write them down once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, segment, part, end = byte_level(tokenizer), Segment(), None, struct.pack("=H", end_id)
        for batch in batches:
            for some in slices(batch, "text"):
                coded = encoder.encode(pc.fill_null(some["text"], "").to_pylist())
                keys = zip(some["doc_id"].to_pylist(), some["hash"].to_pylist(), some["row"].to_pylist(), strict=True)
                for key, ids in zip(keys, coded, strict=True):
                    if part is None:
                        part = PartFile(folder)
                    part.first = part.first or key
                    segment.add(key[0], ids + end)
                    if segment.n_ids >= SEGMENT_IDS:
                        part.write(segment)
                        segment = Segment()
                        if part.n_bytes >= FILE_BYTES:
                            yield part.close()
                            part = None
        if part:
            if segment.n_ids:
                part.write(segment)
            yield part.close()

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = keyed.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text", "hash", "row").mapInArrow(run, MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the manifest, one row for each file, is ordered in one task; files are dealt to tasks and read segment by segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                source, size = open_file(uri)
                with source:
                    for index in read_indexes(source, size):
                        ids, ends = memoryview(index.ids(source)).cast("B"), np.cumsum(index.lengths)
                        begins = ends - index.lengths
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)]
                        columns = [index.doc_ids, begins + start, index.lengths, crcs]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in STORED.split(", ")])
                        start += index.n_ids

    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    files = max(1, manifest.count())
    return placed.repartition(files).mapInArrow(run, STORED)


def store_and_read_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents to files in the shared folder, and return what their readers find.

    A null text counts as empty and has its end id alone; a null doc_id stays null and comes first; rows that share a doc_id
    are documents each, ordered by a hash of their text; wholly equal rows stand next to each other. Other columns are
    ignored; an empty table makes no file and no row. The files stay until drop_held.
    """
    folder = shared_folder(docs.sparkSession, "token-ids")
    return read_tokens(held(write_tokens(docs, tokenizer, folder, end_id), "token-files"))
