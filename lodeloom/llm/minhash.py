"""Near-duplicate documents by DartMinHash over weighted word shingles.

Each element of a weighted set is a strip as wide as its weight, on which hashed darts lie at ranks: a Poisson process cut
into unit cells, each drawn from a hash of element and cell. Every dart has a coordinate; the earliest dart of each coordinate
is the signature, and two signatures agree at a coordinate with the probability of the weighted Jaccard similarity. Throwing
costs one cell for each unit of weight or, for small sets, about k ln k in all, not k for each element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import held
from lodeloom.llm.components import components
from lodeloom.llm.packing import slices

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates a band. Of pairs at similarity 0.8, (1 - 0.8^ROWS)^BANDS = 1 in 70,000 share no band.
BANDS, ROWS = 28, 5
#: Texts in a bucket of which all pairs are made at most.
SMALL = 32
#: Shingles and texts of a block of crowded texts, about, and columns of a product of blocks.
BLOCK, BLOCK_TEXTS, COLUMNS = 1 << 18, 1 << 11, 1 << 13
#: Texts that a centre is taken from, about, and steps of distance from it.
CENTRE_TEXTS, BINS = 64, 20
#: Bits that tell rows whose text is wanted from most others.
MARKS = 1 << 23
#: Times that the way from a bucket to the one it belongs to is doubled.
JUMPS = 3
#: Rounding that a bound on counts may be off by.
SLACK = 1e-6
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: P(Poisson(1) <= n) as 64-bit thresholds.
_POISSON = np.minimum(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 14)])), 1 - 1e-16)
THRESHOLDS = (_POISSON * 2.0**64).astype(U)
STEP = U(0x9E3779B97F4A7C15)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """Signatures, (owners, k), of weighted sets given as (element hash, weight > 0, owner) with no element twice in a set.

    A signature value is the rank and an id of its dart. Sets without elements get all ones.
    """
    none = ~U(0)
    out = np.full(owners * k, none, U)
    total = np.bincount(owner, weights, owners)
    reach = np.ceil(k * (np.log(k) + 2.5) / np.maximum(total, 1e-9)).astype(np.int64)
    low, live = np.zeros(owners, np.int64), total > 0
    strips = np.ceil(weights).astype(np.int64)
    while live.any():
        pick = np.flatnonzero(live[owner])
        own = owner[pick]
        rows = (reach - low)[own]
        cells = strips[pick] * rows
        cell_of = np.repeat(np.arange(len(pick)), cells)
        number = np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)
        strip, rank = number // rows[cell_of], low[own][cell_of] + number % rows[cell_of]
        seed = mix(elements[pick][cell_of] + strip.astype(U) * STEP + rank.astype(U) * U(0xD1B54A32D192ED03))
        count = np.searchsorted(THRESHOLDS, mix(seed ^ U(0xA5A5A5A5)), "right")
        dart_of = np.repeat(np.arange(len(seed)), count)
        nth = np.arange(len(dart_of)) - np.repeat(np.cumsum(count) - count, count)
        h = mix(seed[dart_of] + (nth + 1).astype(U) * STEP)
        whose = cell_of[dart_of]
        again = mix(h)
        across = strip[dart_of] + (again >> U(40)).astype(np.float64) / 2.0**24
        hit = across < weights[pick][whose]
        value = (rank[dart_of].astype(U) << U(44) | (h >> U(32)) << U(12) | again & U(0xFFF))[hit]
        place = own[whose][hit] * k + ((h & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)[hit]
        np.minimum.at(out, place, value)
        live &= (out.reshape(owners, k) == none).any(1)
        low, reach = reach, np.where(live, 2 * reach, reach)
    return out.reshape(owners, k)


def shingles_of(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of occurrences and text of each distinct shingle of each text, ordered by text. A text of fewer words is one shingle, one
    without words has none; words are parted by ASCII white space."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
    which = np.repeat(np.arange(len(texts)), sizes)
    real = pc.not_equal(words, "")
    which, coded = which[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
    word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    h = word_hash[coded.indices.to_numpy()]
    counts = np.bincount(which, minlength=len(texts))
    first = np.cumsum(counts) - counts
    left = counts[which] - (np.arange(len(h)) - first[which])  # words from here to the text's end
    padded = np.concatenate([h, np.zeros(width, U)])
    value = np.zeros(len(h), U)
    for i in range(width):
        value = value * U(0x2545F4914F6CDD1D) + np.where(left > i, padded[i : i + len(h)], U(0))
    begins = (left >= width) | ((np.arange(len(h)) == first[which]) & (counts[which] < width))
    value, which = mix(value[begins]), which[begins]
    order = np.lexsort((value, which))
    value, which = value[order], which[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (which[1:] != which[:-1])
    starts = np.flatnonzero(fresh)
    return value[starts], np.diff(np.append(starts, len(value))), which[starts]


def text_keys(docs: DataFrame) -> list[Column]:
    """digest and home of a row: the MD5 of its text, null being empty, and its id, or a hash of the digest where that is null.

    A text is known by its digest, so that rows may share an id; digest and home tell rows apart but for whole repeats.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return [digest.alias("digest"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(digest)).alias("home")]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles (with repeats), bands: one row for each row of docs. A text without words has no bands."""
    schema = "doc_id long, digest string, n_shingles long, bands array<long>"
    salt = mix(np.arange(1, BANDS + 1).astype(U) * STEP)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                n = part.num_rows
                value, times, which = shingles_of(part["text"])
                signature = dart_signatures(value, times.astype(np.float64), which, n, BANDS * ROWS)
                key = np.broadcast_to(salt, (n, BANDS))
                for row in range(ROWS):
                    key = mix(key ^ signature[:, row * BANDS : (row + 1) * BANDS]) * STEP
                total = np.bincount(which, times, n).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(key[total > 0]).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(total), bands], names=["doc_id", "digest", "n_shingles", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text_keys(docs)[0], text.alias("text")).mapInArrow(sketch, schema)


def distinct_texts(drawn: DataFrame) -> DataFrame:
    """digest, doc_id (the least with that text), home, n_copies, n_shingles, bands, node, own for each text of sketches.

    node is a number of this run. own is the text's id in results: its doc_id, or a negative hash of the digest where that
    id is null or stands for another text, which is the one with the lesser digest. held, as node must not be drawn twice.
    """
    by_text = drawn.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    texts = held(by_text.withColumn("node", F.monotonically_increasing_id()), "texts")
    shared = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1").select("doc_id", "first")
    of_text = -F.xxhash64("digest").bitwiseAND(F.lit(2**63 - 1)) - 1
    mine = F.coalesce(F.col("first") == F.col("digest"), F.col("doc_id").isNotNull())
    named = texts.join(shared, "doc_id", "left")
    return named.withColumn("own", F.when(mine, F.col("doc_id")).otherwise(of_text)).withColumn("home", F.coalesce("doc_id", F.xxhash64("digest"))).drop("first")


def unit_sets(texts: DataFrame) -> DataFrame:
    """node, units for each row of texts(node, text): a hash for each shingle and each of its occurrences, so that the plain Jaccard
    similarity of units is the weighted one of shingles."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                value, times, which = shingles_of(part["text"])
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                unit = mix(np.repeat(value, times) + nth.astype(U) * STEP).view(np.int64)
                sizes = np.bincount(which, times, part.num_rows).astype(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["node"], pa.ListArray.from_arrays(offsets, pa.array(unit))], names=["node", "units"])

    return texts.select("node", "text").mapInArrow(units, "node long, units array<long>")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose digest has a mark that a digest of wanted has too: all rows with such a digest, and few others.

    Marks are the bits of MARKS // 64 words at most, whatever the size of wanted, so that they can go to every task; rows are told
    apart before they are dealt out.
    """
    mark = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6).alias("_word"), mark.bitwiseAND(F.lit(63)).cast("int")
    words = wanted.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    met = rows.select("*", word, bit.alias("_bit")).join(F.broadcast(words), "_word")
    return met.where(F.call_function("getbit", "_bits", "_bit") == 1).drop("_word", "_bits", "_bit")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text for each of wanted(node, digest, home): one row of docs with that text and id. Other texts are not shuffled."""
    rows = docs.select(*text_keys(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return marked(rows, wanted).join(wanted, ["digest", "home"]).dropDuplicates(["digest", "home"]).select("node", "text")


def in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many units each set of a shares with each of b, by products of matrices over the units that stand on both sides."""
    flat, owner = ([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)], [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)])
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    sides = []
    for f, o in zip(flat, owner, strict=True):
        at = np.searchsorted(both, f).clip(max=len(both) - 1)
        hit = np.flatnonzero(both[at] == f)
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[order], o[order]))
    for low in range(0, len(both), COLUMNS):
        has = []
        for (at, o), n in zip(sides, out.shape, strict=True):
            here = slice(*np.searchsorted(at, [low, low + COLUMNS]))
            has.append(np.zeros((n, min(COLUMNS, len(both) - low)), np.float32))
            has[-1][o[here], at[here] - low] = 1
        out += has[0] @ has[1].T
    return out


def crossed(left: list[np.ndarray], right: list[np.ndarray], ids: np.ndarray, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text, those of left first, and a node that it hangs together with; left and right hold sets of units,
    ids their nodes. same: right is left again, and each of its pairs counts once."""
    n, sizes = len(left), np.array([len(x) for x in [*left, *right]])
    common = in_common(left, right)
    linked = common >= similarity * (sizes[:n, None] + sizes[None, n:] - common.astype(np.float64))
    if same:
        linked &= ids[:n, None] > ids[None, n:]
    x, y = np.nonzero(linked)
    y += n
    known, place = np.unique(ids, return_inverse=True)  # a node may stand on both sides
    head, before = np.arange(len(known)), None
    while before is None or (head != before).any():
        before, least = head.copy(), np.minimum(head[place[x]], head[place[y]])
        np.minimum.at(head, place[x], least)
        np.minimum.at(head, place[y], least)
    return np.bincount(x, minlength=len(sizes)) + np.bincount(y, minlength=len(sizes)), known[head[place]]


def lists_of(array: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(pc.list_value_length(array).to_numpy(zero_copy_only=False))
    return np.split(pc.list_flatten(array).to_numpy(zero_copy_only=False), ends[:-1]) if len(array) else []


def that_may_link(left: list[np.ndarray], right: list[np.ndarray], same: bool, similarity: float) -> tuple[list[int], list[int]]:
    """Which sets of left and of right share a unit of their prefixes with one of the other side; same: right is left again.

    With the units of both sides in one order, rare ones first, two sets of n units or more that are linked have a unit in common
    within the first n - similarity * n + 1 of each, so that no link is lost.
    """
    sets = left if same else [*left, *right]
    sizes = np.array([len(u) for u in sets])
    known, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(known))
    owner, rank = np.repeat(np.arange(len(sets)), sizes), rank[place]
    order = np.lexsort((rank, owner))
    nth = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ahead = order[nth < np.repeat(sizes + 1 - np.ceil(sizes * similarity - SLACK), sizes)]
    if same:
        shared = np.bincount(rank[ahead], minlength=len(known)) > 1
        some = np.unique(owner[ahead][shared[rank[ahead]]]).tolist()
        return some, some
    first = owner[ahead] < len(left)
    shared = np.zeros((2, len(known)), bool)
    shared[0, rank[ahead][first]] = shared[1, rank[ahead][~first]] = True
    some = np.unique(owner[ahead][shared.all(0)[rank[ahead]]])
    return some[some < len(left)].tolist(), (some[some >= len(left)] - len(left)).tolist()


def linked_between(left: pa.StructArray, right: pa.StructArray, same: bool, similarity: float) -> pa.RecordBatch:
    """node, other, n_links: what crossed finds for two blocks of (node, units), or for one block with itself."""
    nodes, sets = [b.field("node").to_numpy() for b in (left, right)], [lists_of(b.field("units")) for b in (left, right)]
    x, y = that_may_link(*sets, same, similarity)
    ids = np.concatenate([nodes[0][x], nodes[1][y]])
    links, other = crossed([sets[0][i] for i in x], [sets[1][i] for i in y], ids, same, similarity)
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(other[some]), pa.array(links[some].astype(np.int64))], names=["node", "other", "n_links"])


def families(crowded: DataFrame) -> DataFrame:
    """node, n_shingles, buckets, home of crowded(node, n_shingles, buckets): home is a hash of a large bucket that stands for a family. Held.

    A text is at home in its largest bucket. That bucket's home is in turn the largest one that a text of it is at home in, and so on,
    so that a family which a few large buckets hold in part becomes one. Whose home is whose only decides what is compared where.
    """
    large = F.array_sort(F.transform(F.filter("buckets", lambda b: b["n"] > SMALL), lambda b: F.struct(b["n"].alias("n"), F.xxhash64(b["band"], b["key"]).alias("id"))))
    own = held(crowded.select("node", "n_shingles", "buckets", large.alias("large"), F.array_max(large).alias("own")), "crowd-own")
    parts = own.groupBy("own").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("parts"))
    some = own.join(parts, "own").groupBy("own", F.pmod(F.xxhash64("node"), "parts")).agg(F.array_distinct(F.flatten(F.collect_list("large"))).alias("large"))
    seen = some.select("own", F.explode("large").alias("bucket")).distinct().join(parts.select(F.col("own").alias("bucket")), "bucket", "left_semi")
    up = held(seen.groupBy("bucket").agg(F.max("own").alias("up")), "crowd-homes")
    for _ in range(JUMPS):
        up = held(up.join(up.select(F.col("bucket").alias("up"), F.col("up").alias("top")), "up", "left").select("bucket", F.coalesce("top", "up").alias("up")), "crowd-homes")
    homes = up.select(F.col("bucket").alias("own"), F.col("up.id").alias("home"))
    return held(own.join(homes, "own").select("node", "n_shingles", "buckets", "home"), "crowd-families")


def centres_of(known: DataFrame, homes: DataFrame) -> DataFrame:
    """home, centre for homes(home, node): the units that more than half of about CENTRE_TEXTS of the home's texts have. Held.

    Any set would do to bound distances by; one in the middle of a family bounds them best. So a sample, drawn by a hash, decides
    how much is left to compare, and never what is linked. A home of which nothing was drawn has no centre.
    """
    sized = homes.groupBy("home").agg(F.ceil(F.count("*") / CENTRE_TEXTS).alias("parts"))
    drawn = homes.join(sized, "home").where(F.pmod(F.xxhash64("node"), "parts") == 0).select("home", "node")
    sizes = drawn.groupBy("home").agg(F.count("*").alias("drawn"))
    units = known.join(drawn, "node").select("home", F.explode("units").alias("unit")).groupBy("home", "unit").agg(F.count("*").alias("n"))
    common = units.join(sizes, "home").where(2 * F.col("n") > F.col("drawn"))
    return held(common.groupBy("home").agg(F.collect_list("unit").alias("centre")), "crowd-centres")


def distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two arrays of different units, a metric; 1 where one is missing."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(1 - common / (F.size(a) + F.size(b) - common), F.lit(1.0))


def cell_verdicts(cells: DataFrame, by_bucket: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """x, y (x <= y), sure for pairs of cells that share a bucket and may hold a link. Held.

    cells has cell (home, bin), and lo and hi, between which its texts are from the home's centre; by_bucket has the cells of each
    bucket. Texts a and b are apart by hi(a) + between(centres) + hi(b) at most, so that all pairs of two cells may be links for
    sure; and by between - hi(a) - hi(b), or by how their distances from one centre differ, at least, so that none may be.
    """
    most, slack = 1 - similarity, 1e-9
    who = by_bucket.select(F.array_sort("cells").alias("who")).distinct()
    pairs = who.select("who", F.explode("who").alias("x")).select("x", F.explode("who").alias("y")).where("x <= y").distinct()
    pairs = held(pairs, "crowd-cell-pairs")
    homes = pairs.where("x.home < y.home").select(F.col("x.home").alias("p"), F.col("y.home").alias("q")).distinct()
    centre = lambda name: centres.select(F.col("home").alias(name), F.col("centre").alias(f"centre_{name}"))
    apart = homes.join(centre("p"), "p", "left").join(centre("q"), "q", "left").select("p", "q", distance(F.col("centre_p"), F.col("centre_q")).alias("between"), (F.col("centre_p").isNotNull() & F.col("centre_q").isNotNull()).alias("known"))
    side = lambda name: cells.select(F.col("cell").alias(name), F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"), F.col("centred").alias(f"centred_{name}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumns({"p": F.least("x.home", "y.home"), "q": F.greatest("x.home", "y.home")}).join(apart, ["p", "q"], "left")
    one = F.col("x.home") == F.col("y.home")
    bounded = F.col("centred_x") & F.col("centred_y") & (one | F.coalesce("known", F.lit(False)))
    between = F.when(one, 0.0).otherwise(F.col("between"))
    sure = bounded & (F.col("hi_x") + between + F.col("hi_y") <= most - slack)
    gap = F.greatest(F.col("lo_x") - F.col("hi_y"), F.col("lo_y") - F.col("hi_x"))
    out = bounded & F.when(one, gap > most + slack).otherwise(between - F.col("hi_x") - F.col("hi_y") > most + slack)
    return held(both.select("x", "y", F.coalesce(sure, F.lit(False)).alias("sure"), F.coalesce(out, F.lit(False)).alias("out")).where(~F.col("out")).drop("out"), "crowd-cell-verdicts")


def sure_links(dealt: DataFrame, cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """node, other, n_links of the pairs of cells whose texts are all linked: counted by the cells' sizes, with no pair made."""
    sure = verdicts.where("sure").select("x", "y")
    either = sure.union(sure.where("x <> y").select("y", "x"))
    other = cells.select(F.col("cell").alias("y"), F.col("n").alias("n_y"), F.col("least").alias("least_y"))
    by_cell = either.join(other, "y").groupBy("x").agg(F.sum(F.col("n_y") - (F.col("x") == F.col("y")).cast("int")).alias("n_links"), F.min("least_y").alias("other"))
    nodes = dealt.select("node", F.struct("home", "bin").alias("x")).join(by_cell, "x").select("node", "other", "n_links")
    mine = cells.select(F.col("cell").alias("x"), F.col("least").alias("least_x"))
    across = sure.join(other, "y").join(mine, "x").select(F.col("least_x").alias("node"), F.col("least_y").alias("other"), F.lit(0).cast("long").alias("n_links"))
    return nodes.union(across)


def blocks_to_compare(by_bucket: DataFrame, verdicts: DataFrame) -> DataFrame:
    """x, y (x <= y) for blocks that share a bucket and whose cells may hold a link that isn't sure."""
    unsure = verdicts.where("not sure").select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"))
    some = unsure.select(F.col("cell_x").alias("cell")).union(unsure.select("cell_y")).distinct()
    left = by_bucket.select("bucket", F.explode("blocks").alias("b")).select("bucket", F.struct("b.home", "b.bin").alias("cell"), "b").join(some, "cell")
    # Buckets in which the same blocks stand say the same about them.
    who = held(left.groupBy("bucket").agg(F.array_sort(F.collect_list("b")).alias("who")).select("who").distinct(), "crowd-together")
    met = who.select("who", F.explode("who").alias("x")).select("x", F.explode("who").alias("y")).where("x <= y").distinct()
    cell = lambda name: F.struct(f"{name}.home", f"{name}.bin").alias(f"cell_{name}")
    # blocks are ordered by cell first, so that x <= y goes for cells too
    return met.select("x", "y", cell("x"), cell("y")).join(unsure, ["cell_x", "cell_y"]).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))


def crowd_links(known: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """node, other, n_links for the texts of crowded(node, n_shingles, buckets), each with its buckets(n, band, key); known(node, units) has
    their units.

    The sum of n_links over a node's rows is the number of all such texts it is linked to; other hangs together with node by links.

    A text's home is the largest bucket of its family. Its distance from the home's centre puts it into a cell, and by the triangle inequality
    most pairs of cells that share a bucket are links for sure, or none; these are counted by cell. What is left is dealt to
    blocks, and all texts of two blocks that share a bucket are compared in one task, by their prefixes and then by a product of
    matrices. So every link between texts that share a bucket is found, and a family of which most are within half the distance
    of its centre costs as much as it has texts. Only numbers of links and a link to hang by leave the task.
    """
    home = families(crowded)
    centres = centres_of(known, home.select("home", "node"))
    spread = home.join(known, "node").join(centres, "home", "left").select("node", "n_shingles", "buckets", "home", distance(F.col("units"), F.col("centre")).alias("d"), F.col("centre").isNotNull().alias("centred"))
    spread = held(spread.withColumn("bin", F.floor(F.col("d") * BINS).cast("int")), "crowd-spread")
    cell = F.struct("home", "bin").alias("cell")
    cells = spread.groupBy("home", "bin").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("node").alias("least"), F.min("centred").alias("centred"), F.sum("n_shingles").alias("shingles"))
    cells = held(cells.select(cell, "*", F.greatest(F.ceil(F.col("shingles") / BLOCK), F.ceil(F.col("n") / BLOCK_TEXTS)).alias("parts")), "crowd-cells")
    block = F.xxhash64("home", "bin", F.pmod(F.xxhash64("node"), "parts")).alias("block")
    dealt = held(spread.join(cells.select("home", "bin", "parts"), ["home", "bin"]).select("node", "home", "bin", "buckets", block), "crowd-dealt")
    of_block = dealt.groupBy("home", "bin", "block").agg(F.array_distinct(F.flatten(F.collect_list("buckets"))).alias("buckets"))
    at = of_block.select(F.struct("home", "bin", "block").alias("b"), F.explode("buckets").alias("bucket"))
    by_bucket = held(at.groupBy("bucket").agg(F.collect_list("b").alias("blocks"), F.collect_set(F.struct("b.home", "b.bin")).alias("cells")), "crowd-buckets")

    verdicts = cell_verdicts(cells, by_bucket, centres, similarity)
    met = held(blocks_to_compare(by_bucket, verdicts), "crowd-met")
    wanted = met.select(F.col("x").alias("block")).union(met.select("y")).distinct()
    members = known.join(dealt.select("node", "block").join(wanted, "block"), "node").groupBy("block").agg(F.collect_list(F.struct("node", "units")).alias("members"))
    whole = held(members, "crowd-members")  # of bounded size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield linked_between(batch["left"][i].values, batch["right"][i].values, batch["same"][i].as_py(), similarity)

    both = met.join(whole.select(F.col("block").alias("x"), F.col("members").alias("left")), "x").join(whole.select(F.col("block").alias("y"), F.col("members").alias("right")), "y")
    found = both.select("left", "right", (F.col("x") == F.col("y")).alias("same")).mapInArrow(compare, "node long, other long, n_links long")
    return found.union(sure_links(dealt, cells, verdicts))


def classified(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and digest, home, own, n_copies, n_links, class_id of each text."""
    drawn = held(sketches(docs), "sketches")
    texts = held(distinct_texts(drawn), "named-texts")

    placed = texts.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = held(placed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = held(placed.join(buckets, ["band", "key"]), "bucket-members")
    by_node = met.groupBy("node", "n_shingles").agg(F.collect_list(F.struct("n", "band", "key")).alias("buckets"))  # BANDS at most
    crowded = held(by_node.where(F.array_max("buckets")["n"] > SMALL), "crowded")
    in_crowd = crowded.select("node", F.lit(True).alias("in_crowd"))
    few = met.where(F.col("n") <= SMALL).join(in_crowd, "node", "left")
    member = F.struct("node", "n_shingles", F.coalesce("in_crowd", F.lit(False)).alias("in_crowd"))
    groups = few.groupBy("band", "key").agg(F.collect_list(member).alias("all"))  # SMALL texts each at most
    each = groups.select("all", F.explode("all").alias("x")).select("x.*", F.explode("all").alias("p"))
    each = each.where("node > p.node and not (in_crowd and p.in_crowd)").select("node", "n_shingles", F.col("p.node").alias("other"), F.col("p.n_shingles").alias("n_other"))
    alike = F.least("n_shingles", "n_other") >= similarity * F.greatest("n_shingles", "n_other")
    pairs = held(each.where(alike).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(in_crowd.select("node")).distinct()
    wanted = held(wanted.join(texts.select("node", "digest", "home"), "node"), "wanted")
    sets = held(unit_sets(texts_of(docs, wanted)), "unit-sets")
    crowds = held(crowd_links(sets, crowded, similarity), "crowd-links")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("units").alias("units_a")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("units").alias("units_b")), "b")
    common = F.size(F.array_intersect("units_a", "units_b"))
    links = held(with_both.where(common >= similarity * (F.size("units_a") + F.size("units_b") - common)).select("a", "b"), "near-links")

    found = components(links.union(crowds.select("node", "other"))).withColumnRenamed("class_id", "label")
    named = held(found.join(texts.select("node", "own"), "node"), "near-classes")
    first = named.groupBy("label").agg(F.min(F.struct((F.col("own") < 0).alias("late"), "own"))["own"].alias("class_id"))
    ends = links.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("n_links")).union(links.select("b", F.lit(1).cast("long")))
    degree = ends.union(crowds.select("node", "n_links")).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = texts.join(named.join(first, "label").select("node", "class_id"), "node", "left").join(degree, "node", "left")
    by_text = classes.select("digest", "home", "own", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "own").alias("class_id"))
    return drawn, held(by_text, "text-classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of every row of docs: doc_id, class_id, n_copies (rows with its text), n_links (verified links of its text).

    Equal texts are one; texts whose weighted five-word shingles have a Jaccard similarity of at least similarity are linked; a class
    is a component of these. class_id is the least doc_id in it that isn't null; where several texts share an id, it stands
    for the one of least digest, and the others count as without id. A class without any id has a negative hash as
    class_id, so that no two classes share one. Null texts count as empty, and all empty texts are copies of one another;
    other columns are ignored; an empty table gives no rows.

    In buckets of SMALL texts at most all pairs are made and verified on whole shingle sets. Texts that stand in a larger bucket are joined among
    themselves by crowd_links, which finds all links between those that share a bucket of any size.
    """
    drawn, by_text = classified(docs, similarity)
    return drawn.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near-duplicates: that of its class_id, with all its columns.

    Where rows repeat both id and text, one of them stays. Rows that share an id but are not alike all stay.
    """
    _, by_text = classified(docs, similarity)
    stay = held(by_text.where("own = class_id").select("digest", "home"), "stay")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *text_keys(docs))
    return rows.join(stay, ["digest", "home"]).dropDuplicates(["digest", "home"]).select("_row.*")
