from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeloom.llm import minhash as m
from lodeloom.llm.components import components


@pytest.mark.parametrize("whole", [True, False])
def test_signatures_agree_as_often_as_the_weighted_similarity(whole):
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (rng.integers(0, 4, (2, 300)).astype(float)) if whole else rng.random((2, 300)) * 3
    in_a, in_b = a > 0, b > 0
    s = m.dart_signatures(np.r_[e[in_a], e[in_b]], np.r_[a[in_a], b[in_b]], np.r_[np.zeros(in_a.sum(), int), np.ones(in_b.sum(), int)], 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(200, 260)]
    cycle = [(i, 300 + (i - 299) % 7) for i in range(300, 307)]
    rows = components(spark.createDataFrame([*path, *star, *cycle, (5, 5)], "a long, b long")).collect()
    assert {r.node: r.class_id for r in rows} == {i: 100 for i in range(100, 161)} | {1: 1} | {i: 1 for i in range(200, 260)} | {i: 300 for i in range(300, 307)}


def brute_classes(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[doc_id] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    having = defaultdict(list)
    for i, c in sets.items():
        for g in c:
            having[g].append(i)
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in {(a, b) for own in having.values() for a in own for b in own if a < b}:
        if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
            x, y = root(a), root(b)
            head[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_classes_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = docs.orderBy("doc_id").limit(1).first().text.split(" ")
    rng = np.random.default_rng(2)
    copies = []
    for i in range(40):
        words = list(base)
        words[rng.integers(len(words))] = f"swap{i}"
        copies.append((100_000 + i, " ".join(words)))
    docs = docs.union(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in m.near_duplicates(docs).collect()}
    want = brute_classes([tuple(r) for r in docs.collect()])
    assert got == want and len(set(want.values())) < len(want) - 35


@pytest.mark.parametrize("tail", [35, 12])
def test_links_in_crowded_buckets_against_all_pairs(spark, tail):
    """A family on one template, below the threshold (tail 35, but for twins above it) or above it (tail 12)."""
    base = [f"t{i}" for i in range(300 - tail)]
    texts = {i: " ".join([*base, *(f"twin{i // 2}x{j}" for j in range(6)), *(f"own{i}x{j}" for j in range(tail - 6 - i % 3))]) for i in range(160)}
    got = m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    links = {i: sum(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in sets if k != i) for i in sets}
    assert {r.doc_id: r.n_links for r in got} == links and max(links.values()) == (1 if tail == 35 else 159)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(list(texts.items()))


@pytest.mark.parametrize("n", [40, 7])
def test_prefixes_part_no_linked_sets(n):
    """Sets at and about the threshold, whose prefixes are taken in one block or between two."""
    rng = np.random.default_rng(n)
    base = np.arange(n)
    sets = [np.r_[base[rng.random(n) > rng.random() / 4], 1000 * i + np.arange(rng.integers(0, n // 3 + 1))] for i in range(1, 60)]
    for left, right, same in ((sets, sets, True), (sets[:30], sets[30:], False)):
        x, y = m.that_may_link(left, right, same, 0.8)
        linked = [(i, k) for i, a in enumerate(left) for k, b in enumerate(right) if (i != k or not same) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))]
        assert linked and {i for i, _ in linked} <= set(x) and {k for _, k in linked} <= set(y)


@pytest.mark.parametrize("sizes", [(70, 50, 40)])
def test_every_family_of_a_crowd_is_found(spark, sizes, monkeypatch):
    """Families on one template meet in crowded buckets; each is a class, whichever block its members lie in."""
    monkeypatch.setattr(m, "BLOCK_TEXTS", 16)
    base, texts = [f"t{i}" for i in range(260)], {}
    for family, n in enumerate(sizes):
        for i in range(n):
            texts[1000 * family + i] = " ".join([*base, *(f"f{family}x{j}" for j in range(45)), *(f"own{family}x{i}x{j}" for j in range(1 + i % 4))])
    got = m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(list(texts.items())) and len({r.class_id for r in got}) == len(sizes)
    assert all(r.n_links >= 0.9 * (sizes[r.doc_id // 1000] - 1) for r in got)


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, c), (5, c), (None, c + " tail"), (None, "alone here with some words"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(docs).collect()
    assert len(got) == len(rows) and [r.n_copies for r in got if r.doc_id == 3] == [2]
    first, second = sorted((b, c), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    classes = {r.class_id for r in got}
    assert {3, 5, 7} <= classes and len(classes) == 5 and sum(x < 0 for x in classes) == 2
    assert sum(r.class_id == 3 for r in got) == 2 and sum(r.class_id == 7 for r in got) == 2
    assert sum(r.class_id == 5 for r in got) == (3 if first == c else 1)
    kept = sorted(map(tuple, m.keep_one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(3, a), (5, b), (5, c), (None, "alone here with some words"), (7, None)], key=repr) or (first == b and len(kept) == 5 and {t for _, t in kept} >= {a, b})


def test_odd_rows(odd_docs, no_docs):
    rows = m.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len({r.class_id for r in rows if r.doc_id in (2, 3)}) == 1
    kept = m.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 2, 4, None, 5, 6, 7, 8]))
    assert m.near_duplicates(no_docs).count() == 0 and m.keep_one_of_each(no_docs).count() == 0


def held_rows(monkeypatch) -> dict[str, list[int]]:
    """Rows of each table that is held from now on, by its name."""
    rows, held = {}, m.held

    def counting(df, what):
        out = held(df, what)
        rows.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(m, "held", counting)
    return rows


def test_pairs_of_blocks_grow_with_the_family(spark, monkeypatch):
    """A family near its template: its links are counted by distance from the centre, and hardly any blocks are compared."""
    monkeypatch.setattr(m, "BLOCK_TEXTS", 16)
    base, blocks = [f"t{i}" for i in range(200)], []
    for n in (200, 800):
        rows = held_rows(monkeypatch)
        texts = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(1 + i % 5))])) for i in range(n)]
        got = m.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r.n_links for r in got} == {n - 1} and {r.class_id for r in got} == {0}
        blocks.append(rows["crowd-met"][0] + rows["crowd-cell-verdicts"][0])
        monkeypatch.undo()
        monkeypatch.setattr(m, "BLOCK_TEXTS", 16)
    assert blocks[1] <= 4 * blocks[0]  # all pairs of blocks would be 16 times as many


@pytest.mark.parametrize("seed", [1, 2])
def test_sure_unsure_and_no_links_together(spark, monkeypatch, seed):
    """Families that are tight, loose and on the threshold, near and far from each other; every number of links is exact."""
    monkeypatch.setattr(m, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(m, "CENTRE_TEXTS", 8)
    rng, texts = np.random.default_rng(seed), {}
    for family, (shared, most) in enumerate(((220, 4), (200, 22), (170, 45), (215, 8))):
        base = [f"t{i}" for i in range(160)] + [f"f{family // 2}x{i}" for i in range(shared - 160)]
        for i in range(60):
            texts[1000 * family + i] = " ".join([*base, *(f"own{family}x{i}x{j}" for j in range(int(rng.integers(0, most + 1))))])
    rows = held_rows(monkeypatch)
    got = m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, i)
    ones = set(by_text.values())
    links = {i: sum(len(sets[by_text[texts[i]]] & sets[k]) >= 0.8 * len(sets[by_text[texts[i]]] | sets[k]) for k in ones if k != by_text[texts[i]]) for i in texts}
    assert {r.doc_id: r.class_id for r in got} == brute_classes(list(texts.items()))
    assert {r.doc_id: r.n_links for r in got} == links
    assert rows["crowd-met"][0] > 0 and rows["crowd-cell-verdicts"][0] > 0


def test_only_wanted_texts_are_dealt_out(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    wanted = docs.where("doc_id % 50 = 0").select(m.F.col("doc_id").alias("node"), *m.text_keys(docs))
    rows = docs.select(*m.text_keys(docs), "text")
    through = {r.home for r in m.marked(rows, wanted).collect()}
    assert set(range(0, 3000, 50)) <= through and len(through) < 90
    assert sorted(map(tuple, m.texts_of(docs, wanted).collect())) == [(i, f"text {i}") for i in range(0, 3000, 50)]
    monkeypatch.setattr(m, "MARKS", 64)  # every mark is set, all rows come through, and the join decides
    assert m.marked(rows, wanted).count() > 1500
    assert sorted(map(tuple, m.texts_of(docs, wanted).collect())) == [(i, f"text {i}") for i in range(0, 3000, 50)]
