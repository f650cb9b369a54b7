"""Divergence of sources: how the terms of each source differ from those of its language and of its other sources.

Terms are runs of ASCII letters and of characters beyond ASCII, so their borders show in the bytes of UTF-8. A task looks the
bytes of many texts up in one table, groups the slices between borders by a hash, and verifies each group byte by byte.
Counts are then joined and summed by Spark. For pairs of sources, the shares of a block of terms stand in sparse rows, one
for each source of a block of sources, and each row is met with all others at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.llm.common import held
from lodeloom.llm.packing import slices

#: Documents of a language that a kept term stands in at least; ranks of terms that are returned.
LEAST_DOCS, TERM_RANKS = 10, 10
#: Scale of shares.
SCALE = 1_000_000_000
#: Bytes of text that are cut together, and counts that a task gathers before it gives them out.
TOGETHER, GATHERED = 4_000_000, 1_000_000
#: Terms of a block and sources of a block, about.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 128

COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, a string, b string, value long, base long"

#: What each byte becomes: 0 outside terms; small letters for capitals; itself otherwise.
LOOKUP = np.arange(256, dtype=np.uint8)
LOOKUP[:0x80] = 0
LOOKUP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LOOKUP[ord("A") : ord("Z") + 1] = LOOKUP[ord("a") : ord("z") + 1]


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as terms have them, and where each term begins and ends."""
    looked = LOOKUP[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = looked != 0
    steps = np.diff(inside)
    return looked, np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def grouped(looked: np.ndarray, begins: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its group, and for each group one of its slices. Slices of a group have the same bytes.

    Slices are grouped by hash; then every slice is compared with its group's first, byte by byte, all at once. Those that
    differ, as two terms may have one hash, are grouped again by what they are.
    """
    view = memoryview(np.ascontiguousarray(looked))
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, len(begins))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - begins
    other = first[group]
    same = lengths[other] == lengths
    # positions of all bytes of all slices of the right length, and those of the bytes to be met
    some = np.flatnonzero(same & (other != np.arange(len(other))))
    if len(some):
        n = lengths[some]
        starts = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(starts, n)
        equal = looked[np.repeat(begins[some], n) + step] == looked[np.repeat(begins[other[some]], n) + step]
        same[some] = np.logical_and.reduceat(equal, starts)
    odd = np.flatnonzero(~same)
    if len(odd):
        own: dict[tuple[int, bytes], int] = {}
        firsts = first.tolist()
        for i in odd.tolist():
            key = (int(group[i]), bytes(view[begins[i] : ends[i]]))
            if key not in own:
                own[key] = len(firsts)
                firsts.append(i)
            group[i] = own[key]
        first = np.array(firsts)
    return group, first


class Gathered:
    """Counts of a task: for (group of documents, term) the occurrences and the documents."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def number(self, table: dict, key: object) -> int:
        return table.setdefault(key, len(table))

    def add(self, batch: pa.RecordBatch) -> None:
        """Count the terms of a batch of lang, source, text; no term spans two texts."""
        texts = pc.fill_null(batch["text"], "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        # a byte of no term stands between texts
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer() if len(texts) else b""
        looked, begins, ends = cut(np.frombuffer(joined, np.uint8))
        docs = np.searchsorted(np.cumsum(sizes + 1), begins, "right")
        langs = zip(pc.fill_null(batch["lang"], "").to_pylist(), pc.fill_null(batch["source"], "").to_pylist(), strict=True)
        of_doc = np.array([self.number(self.groups, pair) for pair in langs], np.int64)
        if not len(begins):
            return
        group, first = grouped(looked, begins, ends)
        view = looked.tobytes()
        number = np.array([self.number(self.terms, view[a:b]) for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
        # one entry for each term of each document, then for each term of each group
        entry, n = np.unique((docs << 32) | number[group], return_counts=True)
        self.gather((of_doc[entry >> 32] << 32) | (entry & 0xFFFFFFFF), n, np.ones(len(entry), np.int64))

    def gather(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.parts.append((keys[starts], np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)))
        self.size += len(starts)

    def compact(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self.gather(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def give(self) -> Iterator[pa.RecordBatch]:
        """All counts as rows, and a row without a term for every group, so that one without terms is known too."""
        self.compact()
        names = list(self.groups)
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        terms = pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string())
        schema = [f.split()[0] for f in COUNTS.split(", ")]
        zeros = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.string()), zeros, zeros], names=schema)
        for keys, n, docs in self.parts:
            for at in range(0, len(keys), 100_000):
                some = slice(at, at + 100_000)
                group, term = pa.array(keys[some] >> 32), pa.array(keys[some] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(n[some]), pa.array(docs[some])], names=schema)
        self.__init__()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents it stands in); term is null once for every group. Held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for batch in batches:
            for some in slices(batch, "text", TOGETHER):
                gathered.add(some)
                if gathered.size > GATHERED:
                    gathered.compact()
                    # much that doesn't shrink any more goes to the shuffle
                    if gathered.size > GATHERED // 2:
                        yield from gathered.give()
        yield from gathered.give()

    counted = docs.select(*(F.col(c).cast("string") for c in ("lang", "source", "text"))).mapInArrow(run, COUNTS)
    return held(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) as a long, by decimals, as the product may not fit a long."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return 1 + F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)")).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def sums_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(some: np.ndarray, own: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For some sources (by number) the sums over this block's terms with every source.

    own, term and p are the entries: a source's number, a term's number and the share, in order of source. Where a source
    has no entry its share is its base. What is summed is the value less that of the bases, so terms that neither has add
    nothing; V times the value of the bases is added in the end.
    """
    counts = np.bincount(own, minlength=len(base))
    pointers = np.concatenate([[0], np.cumsum(counts)])
    filled = np.flatnonzero(counts)

    def by_source(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(base), np.int64)
        if len(filled):
            out[filled] = np.add.reduceat(values, pointers[filled])
        return out

    of_entry = base[own]
    for s in some.tolist():
        mine = slice(pointers[s], pointers[s + 1])
        row, here = np.full(width, base[s], np.int64), np.zeros(width, bool)
        row[term[mine]], here[term[mine]] = p[mine], True
        met, none = row[term], sums_apart(base, base[s])
        # terms of the other source, whether this one has them or not; then those of this one that the other lacks
        total = by_source(sums_apart(p, met) - none[own])
        both = here[term]
        if len(p[mine]):
            alone = np.array([int(sums_apart(p[mine], b).sum()) for b in base]) - none * len(p[mine])
            total += alone - by_source((sums_apart(met, of_entry) - none[own]) * both)
        yield s, total


def in_block(table: pa.Table) -> pa.Table:
    """Sums of all pairs of a source of the first side with one of the second, over one block of terms.

    Rows are entries (source, term, p) and, with a null term, each source's base; side is 0 for the first block of sources,
    1 for the second, 2 where both are the same block.
    """
    rows = table.to_pandas()
    bases = rows[rows["term"].isna()].drop_duplicates(["source", "side"])
    sources, sides = bases["source"].tolist(), bases["side"].to_numpy()
    number = {s: i for i, s in enumerate(sources)}
    base = bases["p"].fillna(0).to_numpy(np.int64)
    entries = rows[rows["term"].notna()]
    codes, names = entries["term"].factorize()
    own = entries["source"].map(number).to_numpy(np.int64)
    order = np.argsort(own, kind="stable")
    lang = table["lang"][0].as_py()
    out: list[tuple] = []
    known, some = bool(len(base)) and bool((base > 0).all()), np.flatnonzero(sides != 1)
    if known:
        sums = pair_sums(some, own[order], np.asarray(codes)[order], entries["p"].to_numpy(np.int64)[order], base, max(1, len(names)))
    else:  # a language without kept terms
        sums = ((s, np.zeros(len(sources), np.int64)) for s in some.tolist())
    for s, total in sums:
        others = np.flatnonzero(sides == 1) if sides[s] == 0 else np.arange(s + 1, len(sources))
        nothing = sums_apart(base, base[s]) if known else total
        out += [(lang, sources[s], sources[o], int(total[o]), int(nothing[o])) for o in others.tolist()]
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PARTIAL.split(", ")])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from every other, and the terms that mark it.

    A null text, lang or source counts as ''. Every (lang, source) that occurs is a group, also one without terms or kept
    terms; where a language keeps no term its pairs have value 0. Repeated rows are documents each. Values are exact. Ties go
    by item in order of its bytes. Other columns are ignored; an empty table gives none.

    Counts are gathered in tasks before they are shuffled. Pairs of sources are made in blocks of sources and terms, and only
    sums leave a block; there are as many pairs as the result has rows.
    """
    counts = term_counts(docs)
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = held(kept.select("lang", "term", "n_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total"))
    used = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    zero = F.lit(0).cast("long")
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("own_total", "terms", "total")))
    base = F.when(F.col("terms") > 0, share(zero, F.col("own_total"), F.greatest("terms", F.lit(1))))
    by_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = held(groups.withColumn("base", base).join(by_lang, "lang"), "term-groups")

    shares = used.where(F.col("n") > 0).join(groups, ["lang", "source"])
    shares = held(shares.select("lang", "source", "term", "terms", "sources", share(F.col("n"), F.col("own_total"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("total"), F.col("terms")).alias("q")), "term-shares")

    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    marks = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)

    # each source goes to every pair of blocks of sources that its own is in, and to every block of terms
    n_sources = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int")
    n_terms = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int")
    own_block, term_block = F.pmod(F.xxhash64("source"), n_sources).cast("int"), F.pmod(F.xxhash64("term"), n_terms).cast("int")
    every = shares.select("lang", "source", "term", "p", own_block.alias("own"), n_sources.alias("n"), term_block.alias("term_block"))
    bases = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), own_block.alias("own"), n_sources.alias("n"), F.explode(F.sequence(F.lit(0), n_terms - 1)).alias("term_block"))
    placed = every.unionByName(bases).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    placed = placed.select("lang", "source", "term", "p", "term_block", low.alias("low"), high.alias("high"), side.alias("side"))
    partial = placed.groupBy("lang", "term_block", "low", "high").applyInArrow(in_block, PARTIAL)

    summed = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("base").alias("base")).join(langs.select("lang", "terms"), "lang", "left")
    value = F.col("value") + F.coalesce("terms", zero) * F.col("base")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.select("lang", ways.alias("way"), value.cast("long").alias("value"))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(first))
    return marks.unionByName(pairs).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
