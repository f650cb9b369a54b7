from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from lodeloom.llm import lm as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text) -> list:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [None]


def held_out(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(rows, source) -> None:
    counts = Counter(t for i, text in source if not held_out(i) for t in tokens(text))
    total, words = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out(i), len(t := tokens(text)), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (words + 1))) for w in t), 5)) for i, text in source)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want


def test_base_against_brute_force_and_model_beats_it(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = m.score_texts(docs, head=3000).persist()
    check(scored.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    p = m.perplexities(scored).set_index("held_out")
    assert p.loc[True, "model"] < 0.9 * p.loc[True, "base"]


def test_score_token_by_token(spark, sf, monkeypatch):
    """Every token's probability by a plain softmax over all units, and a class's words by counts made here; the trained model is the only input."""
    models, train = [], m.train
    monkeypatch.setattr(m, "train", lambda *given: models.append(train(*given)) or models[0])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source = [(r.doc_id, r.text) for r in docs.collect()] + [(10**9, None), (10**9 + 1, "Unseen wörd"), (10**9 + 2, "")]
    rows = m.score_texts(spark.createDataFrame(source, "doc_id long, text string"), head=700).collect()
    counts = Counter(t for i, text in source if not held_out(i) for t in tokens(text))
    units = {None: 0} | {w: i for i, w in enumerate([w for _, w in sorted((-n, w) for w, n in counts.items() if w)][: m.OWN_UNITS - 1], 1)}
    unit = lambda w: units[w] if w in units else m.OWN_UNITS + m.class_of(w.encode())
    mass, words = Counter(), Counter()
    for w, n in counts.items():
        mass[unit(w)] += n
        words[unit(w)] += 1
    (model,) = models
    known: dict = {}
    want = {}
    for i, text in source:
        one, two, total = 0, 0, 0.0
        for w in tokens(text):
            u = unit(w)
            if (one, two) not in known:
                x = (model.context[0][one] + model.context[1][two]).astype(float) @ model.target.T.astype(float) + model.bias
                known[one, two] = x - np.log(np.exp(x).sum())
            total += known[one, two][u] / math.log(10)
            if u >= m.OWN_UNITS:
                total += math.log10((counts[w] + 0.5) / (mass[u] + 0.5 * (words[u] + 1)))
            one, two = u, one
        want[i] = (total, len(tokens(text)))
    assert len(rows) == len(source) and all(abs(r.score - want[r.doc_id][0]) < 1e-5 * want[r.doc_id][1] + 1e-4 for r in rows)


def test_odd_rows(odd_docs, no_docs):
    check(m.score_texts(odd_docs, head=10).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert m.score_texts(no_docs).count() == 0


def test_unit_probabilities_sum_to_one():
    model = m.LogBilinear.start(np.ones(m.UNITS))
    context = np.array([[3, 0], [5, 0]])
    scores = model.vectors(context) @ model.target.T + model.bias
    assert np.allclose(np.exp(scores - model.log_norms(context)[:, None]).sum(1), 1, atol=1e-4)


def test_contexts_restart_with_each_text():
    target, context, text = m.sequences(np.array([7, 8, 9]), np.array([0, 0, 2]), 3)
    assert target.tolist() == [7, 8, 0, 0, 9, 0] and text.tolist() == [0, 0, 0, 1, 2, 2]
    assert context.tolist() == [[0, 7, 8, 0, 0, 9], [0, 0, 7, 0, 0, 0]]
