from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeloom.llm import divergence as m

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, ranks=10) -> list[tuple]:
    """Rows of (lang, source, text), with plain integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = [t.translate(SMALL) for t in TERM.findall(text or "")]
        counts[key].update(terms)
        docs[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted(g[1] for g in groups if g[0] == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in own), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in own}, share(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_matches_brute_force_and_sql(spark, sf, duck):
    from lodeloom.llm import queries

    got = sorted(map(tuple, queries.op13_source_divergence(spark, sf).collect()))
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute(docs) and len(got) > 500
    assert got == sorted(duck.execute(queries.oracle_sql()["op13_source_divergence"]).fetchall())


@pytest.mark.parametrize("terms,sources,gathered", [(4096, 128, 10**6), (5, 2, 10)])
def test_blocks(spark, monkeypatch, terms, sources, gathered):
    for name, value in (("BLOCK_TERMS", terms), ("BLOCK_SOURCES", sources), ("GATHERED", gathered), ("TOGETHER", gathered * 10)):
        monkeypatch.setattr(m, name, value)
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "日本", "Zz"]
    docs = [(f"l{i % 2}", f"s{i % 7 if i % 3 else 0}", " ".join(words[int(w)] for w in rng.geometric(0.08, 12) % len(words))) for i in range(150)]
    docs += [("l0", "silent", "123 !"), ("l0", "rare", "onlyhere"), ("l9", "a", "few words"), ("l9", "b", ""), ("l9", None, None)]
    got = sorted(map(tuple, m.source_divergence(spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)).collect()))
    assert got == brute(docs)
    assert {r[4] for r in got if r[0] == "l9"} == {0}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, m.source_divergence(odd_docs, least_docs=1).collect())) == brute(rows, 1)
    assert sorted(map(tuple, m.source_divergence(odd_docs).collect())) == brute(rows)
    assert m.source_divergence(no_docs).count() == 0


def test_ties_go_by_bytes(spark):
    docs = [("en", s, t) for s, t in (("a", "é z ab aa 😀 ﬀ"), ("b", "b c d e f g h"))] * 12
    got = sorted(map(tuple, m.source_divergence(spark.createDataFrame(docs, "lang string, source string, text string")).collect()))
    assert got == brute(docs)
    assert [r[3] for r in sorted((r for r in got if r[1] == "a" and r[2] == "term"), key=lambda r: r[5])] == ["aa", "ab", "z", "é", "ﬀ", "😀"]


def test_slices_of_one_hash_are_told_apart():
    text = "aa bb aa cc bbb bb aa ÀÀ cc À".encode()
    looked, begins, ends = m.cut(np.frombuffer(text, np.uint8))
    for digest in (lambda b: 7, lambda b: len(b), lambda b: bytes(b)[0]):
        group, first = m.grouped(looked, begins, ends, digest)
        want = [bytes(looked[a:b]) for a, b in zip(begins, ends, strict=True)]
        assert [want[first[g]] for g in group] == want
        assert len(set(group.tolist())) == len(set(want))


def test_large_counts(spark):
    from pyspark.sql import functions as F

    n = 9 * 10**17
    row = spark.createDataFrame([(n, 2 * n, 10, 10**9 + 1, 1)], "n long, total long, terms long, p long, q long")
    got = row.select(m.share(F.col("n"), F.col("total"), F.col("terms")).alias("s"), m.apart(F.col("p"), F.col("q")).alias("a")).first()
    assert got.s == 1 + 10**9 * (n + 2) // (2 * n + 20) and got.a == 10**18 // (10**9 + 2)
