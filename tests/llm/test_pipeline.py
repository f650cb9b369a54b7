"""The pipeline against its stages' rules, each on its own input, and run() against the stages in a row."""

from __future__ import annotations

from lodeloom.llm import lines, pii, quality
from tests.llm.test_minhash import brute_classes
from tests.llm.test_packing import check

import corpus_pipeline as p


def test_stages_and_run(spark, sf, tmp_path):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(p.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((before, docs))
        if i < 4:
            assert docs.columns == before.columns
    texts = [{r.doc_id: r.text for r in b.collect()} for b, _ in seen]
    kept = {r.doc_id for r in quality.judge(seen[0][0]).where("kept").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in kept}
    drop = {(r.doc_id, r.line_no) for r in lines.line_classes(seen[1][0]).where("not kept").collect()}
    pruned = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in drop) for i, t in texts[1].items()}
    assert drop and texts[2] == {i: t for i, t in pruned.items() if t.split() or not texts[1][i].split()}
    classes = brute_classes(list(texts[2].items()))
    assert texts[3] == {i: t for i, t in texts[2].items() if classes[i] == i}
    assert texts[4] == {i: pii.redact(t) for i, t in texts[3].items()} and texts[4] != texts[3]
    rows = docs.collect()
    check(rows, list(texts[4].items()))
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, p.run(spark, sf).collect())) == sorted(map(key, rows))
