from __future__ import annotations

import random

import numpy as np
import pytest

from lodeloom.llm import lines as m


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s: str, times: int, letters: str) -> str:
    for _ in range(times):
        i, c, how = rng.randint(0, len(s)), rng.choice(letters), rng.random()
        s = s[:i] + c + s[i:] if how < 0.3 else s[:i] + s[i + 1 :] if how < 0.6 else s[:i] + c + s[i + 1 :]
    return s


def test_banded_distance_against_the_full_matrix():
    rng = random.Random(3)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 5), "abc")
        d = distance(a, b)
        for most in range(5):
            assert m.edits_within(a, b, most) == (d <= most), (a, b, most)


@pytest.mark.parametrize("threshold", [1, 2])
def test_classes_and_links_against_all_pairs(spark, threshold):
    """Crowded keys included: most lines stem from two, so that hundreds share a segment."""
    rng, base, made = random.Random(5), ["the quick brown fox jumps over the lazy dog again", "lorem ipsum dolor sit amet consectetur elit"], set()
    while len(made) < 160:
        made.add(edited(rng, rng.choice(base), rng.choice([0, 1, 1, 1, 2, 2]), "abz "))
    lines = [*sorted(made), "short one", "short onf"]
    docs = spark.createDataFrame([(i // 3, "\n".join(lines[i : i + 3]), "x") for i in range(0, len(lines), 3)] + [(9999, f"{lines[0]}\n\n{lines[5]}", "y"), (10000, None, None)], "doc_id long, text string, extra string")
    place = {(d.doc_id, n): s for d in docs.collect() for n, s in enumerate((d.text or "").split("\n")) if s.strip()}
    first: dict = {}
    for k, s in sorted(place.items()):
        first.setdefault(s, k)
    long = [s for s in first if len(s) >= m.LEAST_CHARS]
    near = {s: {t for t in long if t != s and abs(len(s) - len(t)) <= threshold and distance(s, t) <= threshold} for s in long}
    head = {s: first[s] for s in first}
    for _ in long:  # labels settle
        new = {s: min([head[s], *(head[t] for t in near.get(s, ()))]) for s in head}
        if new == head:
            break
        head = new
    rows = m.line_classes(docs, threshold).collect()
    assert {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line), r.n_links, r.kept) for r in rows} == {k: (head[s], len(near.get(s, ())), head[s] == k) for k, s in place.items()}


def test_stage_keeps_first_lines_and_columns(odd_docs, no_docs):
    out = m.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert m.without_repeated_lines(no_docs).count() == 0 and m.line_classes(no_docs).count() == 0


def test_copies_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "Read more\nx\nRead mora"), (2, "Read more\ny"), (3, "z\nRead more"), (4, "Read more")], "doc_id long, text string")
    rows = {(r.doc_id, r.line_no): (r.copies, r.n_links, r.class_doc_id, r.class_line, r.kept) for r in m.line_classes(docs).collect()}
    alone = {k: (1, 0, *k, True) for k in ((1, 1), (1, 2), (2, 1), (3, 0))}
    assert rows == alone | {k: (4, 0, 1, 0, k == (1, 0)) for k in ((1, 0), (2, 0), (3, 1), (4, 0))}
    assert {r.doc_id: r.text for r in m.without_repeated_lines(docs).collect()} == {1: "Read more\nx\nRead mora", 2: "y", 3: "z"}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    again = "this line stands in many documents"
    rows = [(3, again), (5, again), (5, "only this one has this line"), (5, "only this one has this line"), (None, f"{again}\nand its tail"), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.line_classes(docs).collect()
    assert len(got) == 6 and {r.copies for r in got if r.n_chars == len(again)} == {3}
    assert len({(r.class_doc_id, r.class_version, r.class_line) for r in got}) == 3
    kept = sorted(map(tuple, m.without_repeated_lines(docs).collect()), key=repr)
    want = {(3, again), (5, "only this one has this line"), (6, ""), (7, None)}
    assert {k for k in kept if k[0] is not None} in (want, want - {(3, again)}) and len(kept) in (4, 5)


def test_rolling_keys_are_equal_where_what_is_left_is():
    rng, key_of = random.Random(2), {}
    lines = ["".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9))) for _ in range(100)] + [""]
    cuts = [(i, a, e) for i, x in enumerate(lines) for a in range(len(x) + 1) for e in range(a, len(x) + 1)]
    row, start, end = (np.array(c) for c in zip(*cuts, strict=True))
    for (i, a, e), key in zip(cuts, m.Rolling(lines).without(row, start, end, 0 * row).tolist(), strict=True):
        assert key_of.setdefault(lines[i][:a] + lines[i][e:], key) == key
    assert len(set(key_of.values())) == len(key_of)


def test_very_long_lines_of_a_crowded_key(spark):
    """Twenty lines of 600,000 characters, each but the last with one character of its own in one region; one by an insertion at its border."""
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefgh ", k=600_000))
    border = 300_000 + 300_000 // m.REGIONS
    made = [f"{base[:p]}#{base[p + 1 :]}" for p in rng.sample(range(300_000, border), 18)] + [f"{base[:border]}#{base[border:]}", base]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: (r.n_links, r.class_doc_id) for r in m.line_classes(docs).collect()}
    assert rows == {i: (1, 0) for i in range(19)} | {19: (19, 0)}
