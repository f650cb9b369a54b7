from __future__ import annotations

import random
import re

import numpy as np

from lodeloom.llm import quality as m


def brute(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in m.SYMBOLS for c in t), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice(["a ", "b ", "a ", "\n", "é", "\x1c", "\x0b", " ", "|"]) for _ in range(rng.randint(0, 80)))
        assert m.counts_of(t)[:5] == brute(t)


def test_long_texts_take_the_other_way_to_the_same_count():
    rng = random.Random(3)
    words = [b"%d" % rng.randint(0, 60) for _ in range(60_000)]
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for own in seen.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    assert m.repeated_words(words) == len(covered)


def distances(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    off = x - centre
    return np.einsum("ij,jk,ik->i", off, np.linalg.inv(spread), off)


def fit_by_numpy(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same estimate with exact quantiles over one stratum's rows, before it is drawn to that of all."""
    floor = np.diag(np.square(m.FLOORS))
    q1, middle, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.sqrt(((q3 - q1) / 1.349) ** 2 + np.diag(floor))
    z, best = (x - middle) / scale, None
    for w in (None, z / np.sqrt((z**2).sum(1) + 1e-9)[:, None], np.tanh(z)):
        c = np.eye(len(scale))
        if w is not None:
            sums = w.T @ w
            c = 0.95 * sums / np.sqrt(np.outer(np.diag(sums), np.diag(sums)).clip(1e-24)) + 0.05 * c
        centre, spread = middle, c * np.outer(scale, scale)
        for _ in range(m.STEPS):
            d = distances(x, centre, spread)
            near = x[d <= np.quantile(d, m.KEPT_SHARE)]
            centre, spread = near.mean(0), m.CONSISTENCY * np.cov(near.T, bias=True).reshape(floor.shape) + floor
        if best is None or np.linalg.slogdet(spread)[1] < best[0]:
            best = np.linalg.slogdet(spread)[1], centre, spread
    near = x[distances(x, *best[1:]) <= m.REWEIGHT]
    return near.mean(0), m.INNER_CONSISTENCY * np.cov(near.T, bias=True).reshape(floor.shape) + floor


def test_estimates_and_verdicts_against_numpy(spark):
    """Languages as strata, and one stratum of a few rows, which is judged as all rows are."""
    source = "case when doc_id % 97 = 0 then 'few' else 'one' end as source"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", source)
    rows = m.text_statistics(docs).toPandas()
    kept = {r.doc_id: r.kept for r in m.judge(docs).collect()}
    middle, wide = fit_by_numpy(rows[list(m.FEATURES)].to_numpy())
    agree = 0
    for _, own in rows.groupby(["lang", "source"]):
        x = own[list(m.FEATURES)].to_numpy()
        centre, spread = fit_by_numpy(x)
        share, off = len(x) / (len(x) + m.PRIOR), centre - middle
        d = distances(x, middle + share * off, share * spread + (1 - share) * (wide + share * np.outer(off, off))) * own.n_words / (own.n_words + m.SHORT)
        agree += sum(kept[i] == w for i, w in zip(own.doc_id, ~own.base_failed.to_numpy() & (d <= m.CUTOFF).to_numpy(), strict=True))
    assert agree >= 0.995 * len(rows)


def test_a_stratum_of_one_row_is_judged(spark):
    plain = [(i, "Plain words stand here, one after the other, and the next sentence ends as this one does.", "en", "a") for i in range(80)]
    odd = (1000, "!!! ### $$$ AAA BBB CCC !!! ### $$$ DDD EEE *** %%% FFF GGG !!! ||| <<< >>> HHH III JJJ KKK LLL " * 3 + " ".join(f"W{i}!!" for i in range(200)), "xx", "b")
    kept = {r.doc_id: r.kept for r in m.judge(spark.createDataFrame([*plain, odd, (1001, plain[0][1], "xx", "c")], "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[1000] and kept[1001] and kept[0]


def test_labelled_documents(spark):
    path = "/root/testdata/sf0.01"
    judged = m.judge(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.2


def test_odd_rows_and_stage(odd_docs, no_docs):
    rows = m.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.kept for r in rows if r.doc_id in (1, 7))
    assert not any(r.kept for r in rows if r.doc_id in (2, 3, 4, 6))
    good = m.keep_good(odd_docs)
    fine = [t.text for t in odd_docs.collect() if (c := m.counts_of(t.text or ""))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert good.columns == odd_docs.columns and sorted(r.text for r in good.collect()) == sorted(fine)
    assert m.keep_good(no_docs).count() == 0 and m.judge(no_docs).count() == 0
