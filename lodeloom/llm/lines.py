"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

A line is split into threshold + 1 segments. Two lines within threshold edits share one segment, at places that differ by
little; so each line is indexed under its segments and probes, for each length it may match, the substrings that can stand
against them. Lines that meet under a key are verified by a banded bit-parallel edit distance.

A key that many lines share would make all pairs of them. With a threshold of one, such lines are dealt again by what
they are without one of eight regions of the half they don't share, and then without one character; lines that are equal but
for one character are all within one edit, so that they need no pairs. Both steps are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeloom.llm.common import held
from lodeloom.llm.components import components
from lodeloom.llm.packing import slices

THRESHOLD = 1
#: Shorter lines have no near matches, only copies: a few edits make one of them another.
LEAST_CHARS = 24
#: Lines under a key of which all pairs are made at most.
SMALL = 16
REGIONS = 8
#: Bytes of crowded lines hashed side by side, one line at least.
HASHED = 250_000


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most so many insertions, deletions and substitutions.

    Common ends are cut off; then the columns of the distance matrix are bit vectors over the 2 * most + 1 rows around the
    diagonal, and the distance is followed along the diagonal that ends in the last cell.
    """
    if abs(len(a) - len(b)) > most:
        return False
    i, shorter = 0, min(len(a), len(b))
    while i < shorter and a[i] == b[i]:
        i += 1
    a, b, shorter, j = a[i:], b[i:], shorter - i, 0
    while j < shorter and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    band, offset = (1 << 2 * most + 1) - 1, len(a) - len(b)
    up, down, distance, place = band & ~((1 << most) - 1), 0, abs(offset), most + offset
    for j, c in enumerate(b, 1):
        at = j - most - 1
        same = (where.get(c, 0) >> at if at >= 0 else where.get(c, 0) << -at) & band
        level = (((same & up) + up) ^ up | same | down) & band
        right, left = (down | ~(level | up)) & band, level & up
        if j + offset >= 1:
            distance += not level >> place & 1
        right = (right << 1 | 1) & band
        up, down = (left << 1 | ~(level | right)) & band, right & level
        up, down = up >> 1 | 1 << 2 * most, down >> 1
    return distance <= most


def segment(length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line of that length; the last ones take what is over."""
    parts = threshold + 1
    size, over = F.floor(length / parts), length % parts
    late = F.greatest(F.lit(0), F.lit(i) - (parts - over))
    return (size * i + late).cast("int"), (size + (F.lit(i) >= parts - over).cast("int")).cast("int")


def join_keys(line: Column, threshold: int) -> Column:
    """Array of (key, home): where a line is indexed, and where it probes for lines as long or up to threshold shorter."""
    length, keys = F.char_length(line), []
    for shorter in range(threshold + 1):
        target = length - shorter
        for i in range(threshold + 1):
            start, size = segment(target, i, threshold)
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            for shift in range(low, high + 1):
                piece = F.substring(line, start + shift + 1, size)
                keys.append(F.struct(F.xxhash64(target, F.lit(i), piece).alias("key"), F.lit(not shorter and not shift).alias("home")))
    return F.array(*keys)


#: What tells a line from all others, but for lines of rows that repeat both id and text.
PLACE = ("node", "version", "line_no")


def row_keys() -> list[Column]:
    """node: the row's id, or a hash of its text where that is null; version: a hash of its text, as rows may share an id."""
    version = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), version).alias("node"), version.alias("version")]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, node, version, line_no (from 0), line: every \\n-parted line that has a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


#: Primes under 2**31, so that products fit 64 bits, and a base for each.
PRIMES, BASES = (2147483647, 2147483629, 2147483587), (1000003, 998244353, 777767777)


@functools.lru_cache(maxsize=8)
def powers(base: int, prime: int, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of base modulo prime."""
    out = np.ones(1, np.uint64)
    for done in range(bits):
        out = np.concatenate([out, out * np.uint64(pow(base, 1 << done, prime)) % np.uint64(prime)])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Rolling:
    """Polynomial hashes of lines without one part of them, each in constant time after one pass over the characters."""

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.sizes) - self.sizes
        own = np.arange(len(codes)) - np.repeat(self.starts, self.sizes)
        self.bits = int(max(self.sizes, default=0)).bit_length()
        self.sums = [np.concatenate([[0], np.cumsum(codes * powers(base, prime, self.bits)[own] % np.uint64(prime))]).astype(np.uint64) for base, prime in zip(BASES, PRIMES, strict=True)]

    def without(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """A 64-bit key of each line row without its characters start to end; keys of one salt are equal where what is left is."""
        at, key = self.starts[row], mixed(salt.astype(np.uint64))
        for sums, base, prime in zip(self.sums, BASES, PRIMES, strict=True):
            p, first = np.uint64(prime), sums[at]
            before, after = (sums[at + start] - first) % p, (sums[at + self.sizes[row]] - sums[at + end]) % p
            key = mixed(key ^ (before + after * powers(pow(base, -1, prime), prime, self.bits)[end - start] % p) % p)
        return key.view(np.int64)


def bounds(half: np.ndarray, target: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a region begins and ends in a line of length target, in the half that the lines of a key need not share."""
    low, high = np.where(half == 0, target // 2, 0), np.where(half == 0, target, target // 2)
    return low + (high - low) * region // REGIONS, low + (high - low) * (region + 1) // REGIONS


def region_keys(lines: Rolling, row: np.ndarray, half: np.ndarray, target: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Keys of lines that stand for length target (their own or one less), without one region."""
    a, b = bounds(half, target, region)
    return lines.without(row, a, b + lines.sizes[row] - target, 4 * ((2 * target + half) * REGIONS + region))


def character_keys(lines: Rolling, row: np.ndarray, home: np.ndarray, half: np.ndarray, target: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, swap): home lines without each character of the region (swap), and whole; longer ones without each character there."""
    a, b = bounds(half, target, region)
    many = b + lines.sizes[row] - target - a
    entry = np.repeat(np.arange(len(row)), many)
    p = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + a[entry]
    swap, whole = home[entry], np.flatnonzero(home)
    cut = lines.without(row[entry], p, p + 1, np.where(swap, 4 * p + 2, 1))
    nothing = np.zeros(len(whole), np.int64)
    full = lines.without(row[whole], nothing, nothing, nothing + 1)
    return np.concatenate([entry, whole]), np.concatenate([cut, full]), np.concatenate([swap, np.zeros(len(whole), bool)])


def small_pairs(rows: DataFrame, by: str = "key") -> DataFrame:
    """Pairs of lines that share a key, one of them at home there; rows(by, lid, home) has keys of SMALL lines at most."""
    a, b = rows.where("home").select(by, F.col("lid").alias("x")), rows.select(by, F.col("lid").alias("y"), F.col("home").alias("both"))
    met = a.join(b, by).where("x <> y and (not both or x < y)")
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def counted(rows: DataFrame, by: str = "key") -> DataFrame:
    """Keys under which at least two lines meet, one at home; with how many."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
    return n.where("n > 1 and any_home").select(by, "n")


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs(a, b) whose lines are within threshold edits."""

    @F.pandas_udf(T.BooleanType())
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edits_within(p, q, threshold) for p, q in zip(x, y, strict=True)], dtype=bool)

    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("line_b")), "b")
    return both.where(near("line_a", "line_b")).select("a", "b")


def listed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of arrays of structs, flat: the row of each element, and its fields."""
    lists = batch[column]
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return rows, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False).astype(bool if pa.types.is_boolean(f.type) else np.int64) for f in flat.type}


def hot_links(hot: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Links among lines of crowded keys, threshold one. hot(lid, home, half, target), texts(lid, line).

    Returns tables of pairs(a, b) to verify, tables of pairs that are sure, and cliques(key, lid): all lines of such a key are linked.
    A line's text is read once for each step, whatever the keys and regions that crowd it, and hashed in linear time.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line", HASHED):
                row, has = listed(part, "places")
                row, region = np.repeat(row, REGIONS), np.tile(np.arange(REGIONS), len(row))
                home, half, target = (np.repeat(has[c], REGIONS) for c in ("home", "half", "target"))
                key = region_keys(Rolling(part["line"].to_pylist()), row, half, target, region)
                yield pa.RecordBatch.from_arrays([pa.array(key), part["lid"].take(pa.array(row)), *map(pa.array, (home, half.astype(np.int32), target.astype(np.int32), region.astype(np.int32)))], names=["key", "lid", "home", "half", "target", "region"])

    places = hot.groupBy("lid").agg(F.collect_set(F.struct("home", "half", "target")).alias("places"))  # four at most
    dealt = held(texts.join(places, "lid").mapInArrow(deal, "key long, lid long, home boolean, half int, target int, region int"), "line-regions")
    groups = held(counted(dealt), "line-region-groups")
    met = dealt.join(groups, "key")
    few = held(small_pairs(met.where(F.col("n") <= SMALL).select("key", "lid", "home")), "line-region-pairs")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line", HASHED):
                row, has = listed(part, "places")
                entry, key, swap = character_keys(Rolling(part["line"].to_pylist()), row, **has)
                yield pa.RecordBatch.from_arrays([pa.array(key), part["lid"].take(pa.array(row[entry])), pa.array(has["home"][entry]), pa.array(swap)], names=["key", "lid", "home", "swap"])

    regions = met.where(F.col("n") > SMALL).groupBy("lid").agg(F.collect_set(F.struct("home", "half", "target", "region")).alias("places"))  # 32 at most
    crowded = texts.join(regions, "lid")
    ones = held(crowded.mapInArrow(single, "key long, lid long, home boolean, swap boolean").distinct(), "line-characters")
    whole = ones.where("not swap")
    grown = whole.where("home").select("key", F.col("lid").alias("x")).join(whole.where("not home").select("key", F.col("lid").alias("y")), "key")
    sure = held(grown.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "line-grown")
    swaps = ones.where("swap").select("key", "lid")
    cliques = held(swaps.join(held(swaps.groupBy("key").agg(F.count("*").alias("n"), F.min("lid").alias("pivot")).where("n > 1"), "line-cliques"), "key"), "line-clique-members")
    return [few], [sure], cliques


def placed_lines(docs: DataFrame, threshold: int, least_chars: int) -> DataFrame:
    """doc_id, PLACE, n_chars, copies, n_links, first (PLACE of the class's first line) and kept of every line with a word of docs."""
    lines = occurrences(docs).select("doc_id", *PLACE, F.char_length("line").alias("n_chars"), "line")
    marked = lines.withColumn("digest", F.unhex(F.md5(F.col("line").cast("binary"))))
    long = F.col("n_chars") >= max(least_chars, 2 * threshold + 2)
    keyed = marked.select("digest", *PLACE, "n_chars", F.when(long, join_keys(F.col("line"), threshold)).alias("keys"))
    width = (threshold + 1) * (threshold + 1) if threshold == 1 else None
    flat = [F.col("keys")[i]["key"].alias(f"k{i}") for i in range(width)] if width else []
    if flat:
        keyed = keyed.select("digest", *PLACE, "n_chars", *flat)
        kept_keys = [F.first(f"k{i}").alias(f"k{i}") for i in range(width)]
    else:
        kept_keys = [F.first("keys").alias("keys")]
    by_digest = keyed.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("rep"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"), *kept_keys)
    distinct = held(by_digest.withColumn("lid", F.monotonically_increasing_id()), "lines")

    if flat:  # index 0, 1: home keys by half; 2, 3: those of a line one shorter
        keys = F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i < 2).alias("home"), F.lit(i % 2).alias("half"), (F.col("n_chars") - int(i >= 2)).alias("target")) for i in range(width)))
    else:
        keys = F.transform("keys", lambda k: F.struct(k["key"].alias("key"), k["home"].alias("home"), F.lit(0).alias("half"), F.lit(0).alias("target")))
    dealt = distinct.where(long).select("lid", F.explode(keys).alias("k")).select("lid", "k.*")
    met = held(dealt.join(held(counted(dealt), "line-groups"), "key"), "line-candidates")
    hot = met.where((F.col("n") > SMALL) & F.lit(threshold == 1))
    pairs = held(small_pairs(met.where((F.col("n") <= SMALL) | F.lit(threshold != 1)).select("key", "lid", "home")), "line-pairs")

    wanted = held(pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).union(hot.select("lid")).distinct(), "line-wanted")
    places = distinct.join(wanted, "lid").select("lid", "rep.*")
    texts = held(lines.select(*PLACE, "line").join(places, list(PLACE)).select("lid", "line").dropDuplicates(["lid"]), "line-texts")
    unsure, sure, cliques = [pairs], [], None
    if threshold == 1:
        more, sure, cliques = hot_links(hot.select("lid", "home", "half", "target"), texts)
        unsure += more
    links = [verified(p, texts, threshold) for p in unsure] + sure
    found = links[0]
    for x in links[1:]:
        found = found.union(x)
    found = held(found.distinct(), "line-links")
    degree, joined = found.select(F.col("a").alias("lid")).union(found.select("b")).groupBy("lid").agg(F.count("*").alias("n_links")), found
    if cliques is not None:
        joined = joined.union(cliques.where("lid <> pivot").select("lid", "pivot"))
        degree = degree.union(cliques.groupBy("lid").agg(F.sum(F.col("n") - 1))).groupBy("lid").agg(F.sum("n_links").alias("n_links"))
    classes = components(joined, "line").withColumnRenamed("node", "lid")
    members = held(classes.join(distinct.select("lid", "rep"), "lid"), "line-members")
    first = held(members.groupBy("class_id").agg(F.min("rep").alias("first")), "line-first")
    linked = members.join(first, "class_id").select("lid", "first").join(degree, "lid")
    verdicts = distinct.join(linked, "lid", "left").select("digest", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", "rep").alias("first"))
    verdicts = held(verdicts.where("copies > 1 or n_links > 0"), "line-classes")

    placed = marked.select("doc_id", *PLACE, "n_chars", "digest").join(verdicts, "digest", "left")
    own = F.struct(*PLACE)
    counts = [F.coalesce(c, F.lit(least)).alias(c) for c, least in (("copies", 1), ("n_links", 0))]
    return placed.select("doc_id", *PLACE, "n_chars", *counts, F.coalesce("first", own).alias("first")).withColumn("kept", F.col("first") == own)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every line with a word of docs: doc_id, version, line_no, n_chars, copies, n_links, class_doc_id, class_version, class_line, kept.

    Equal lines are copies, whatever their length. Distinct lines of at least least_chars code points are linked when within
    threshold edits; n_links is how many distinct lines a line is linked to. A class is a component of links; the class columns
    tell its first occurrence by (doc_id, version, line_no), the only one that is kept. version is a hash of the row's text: rows that
    share an id with another text are told apart by it, and rows that repeat both are one document and have the same verdicts.
    Shorter lines are in a class with their copies only. class_doc_id is a hash of the text where the id is null; a null text
    has no lines; other columns are ignored; an empty table gives no rows.

    Keys of more than SMALL lines are dealt again without making pairs if threshold is 1; for larger thresholds all their pairs are made.
    """
    first = [F.col("first.node").alias("class_doc_id"), F.col("first.version").alias("class_version"), F.col("first.line_no").alias("class_line")]
    return placed_lines(docs, threshold, least_chars).select("doc_id", "version", "line_no", "n_chars", "copies", "n_links", *first, "kept")


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with only the first occurrence of each class of lines. A document that had words and has none left goes; n_chars follows the text.

    Of rows that repeat both id and text one stays. Rows that share an id with other texts lose their own repeated lines only.
    """
    gone = placed_lines(docs, threshold, least_chars).where("not kept").select(F.col("node").alias("_node"), F.col("version").alias("_version"), "line_no")
    drop = held(gone.groupBy("_node", "_version").agg(F.collect_set("line_no").alias("_drop")), "line-drops")

    @F.pandas_udf("string")
    def prune(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for text, d in zip(texts, drops, strict=True):
            gone = set(d) if d is not None else ()
            out.append(text if text is None or not len(gone) else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
        return pd.Series(out, dtype=object)

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    node, version = row_keys()
    rows = docs.select(whole, F.col("text").cast("string").alias("_text"), node.alias("_node"), version.alias("_version"))
    rows = rows.join(drop, ["_node", "_version"], "left").dropDuplicates(["_node", "_version"])
    done = rows.withColumn("_text", prune("_text", "_drop")).where(F.col("_drop").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_drop").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text")).cast("long") if "n_chars" in docs.columns else None}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns))
