from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from lodeloom.llm import classifier as m


@pytest.mark.parametrize("sizes", [[5], [2, 3], [1, 0, 4]])
def test_marginals_against_all_labellings(sizes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(sum(sizes), 3 * m.WIDTH))
    model = m.Model(rng.normal(size=3 * m.WIDTH) * 0.3, rng.normal(size=(2, 2)), 0.0, 1.0)
    odds, at, want = x @ model.weights, 0, []
    for n in sizes:
        total, bad = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(odds[at + i] for i in range(n) if y[i]) + sum(model.stay[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, bad = total + w, bad + w * np.array(y)
        want += (bad / total).tolist()
        at += n
    assert np.allclose(model.bad_lines(x, np.array(sizes)), want)


def test_neighbours_stop_at_documents():
    x = np.arange(4, dtype=np.float32)[:, None] + 1
    assert m.with_neighbours(x, np.array([2, 0, 2])).tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 0]]


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = m.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.itertuples())
    test = rows[rows.held_out]
    good, bad = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (test.predicted == test.quality).mean() > 0.93
    odd = m.score_quality(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(r.n_lines == 0 and r.bad_share == 1 for r in odd if r.doc_id in (2, 3, 4))
    assert m.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in m.score_quality(odd_docs, labels.where("doc_id < 0")).collect()} == {0.5}


def test_distinct_words_of_a_whole_line():
    fresh = " ".join(f"w{i}" for i in range(400))
    plain, tail, half = (m.line_statistics(t)[0][0, 7] for t in (f"{fresh} {fresh}", fresh + " buy it now" * 5000, fresh + " same" * 200))
    assert plain == 1 and tail < 0.05 and abs(half - 401 / 600) < 1e-6


def test_an_id_with_many_texts_counts_once(spark):
    """The text of least MD5 is fitted on, and a document of too many lines is not."""
    docs = [(i, f"Plain words stand here and say {i} things.") for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = [(i, i % 2) for i, _ in docs]
    more = [(docs[0][0], f"another text {k}") for k in range(200)]
    least = min([docs[0][1], *(t for _, t in more)], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    label = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = m.train(frame(docs + more), label), m.train(frame([(docs[0][0], least), *docs[1:]]), label)
    assert np.array_equal(a.weights, b.weights) and (a.base, a.slope) == (b.base, b.slope)
    c, d = m.train(frame([*docs[1:], (docs[0][0], "x\n" * 50)]), label, sample_lines=20), m.train(frame(docs[1:]), label)
    assert np.array_equal(c.weights, d.weights)


def test_scores_word_by_word(spark):
    """Scores of a fitted model against a plain forward-backward over each document's lines."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = m.train(docs, labels)
    got = {r.doc_id: r.score for r in m.score_quality(docs, labels).collect()}
    for r in docs.collect():
        own, lengths = m.line_statistics(r.text)
        n, bad = len(own), 1.0
        if n:
            pad = np.zeros((1, m.WIDTH), np.float32)
            x = np.concatenate([own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad])], 1).astype(float)
            odds, e = x @ model.weights, np.exp(model.stay)
            f, b = np.ones((n, 2)), np.ones((n, 2))
            node = np.stack([np.ones(n), np.exp(odds)], 1)
            for i in range(n):
                f[i] = node[i] * (f[i - 1] @ e if i else 1)
                f[i] /= f[i].sum()
            for i in range(n - 2, -1, -1):
                b[i] = e @ (node[i + 1] * b[i + 1])
                b[i] /= b[i].sum()
            both = f * b
            bad = float((both[:, 1] / both.sum(1) * lengths).sum() / lengths.sum())
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.base - model.slope * bad)))) < 1e-6
