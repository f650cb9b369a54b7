"""Runs own what they hold, and the pipeline takes odd rows and empty tables."""

from __future__ import annotations

import threading

import pytest

from lodeloom.llm.common import drop_held, held, holding


def test_two_runs_at_once(spark):
    """One run ends, and drops its tables, while another still reads its own."""
    made, dropped, seen = threading.Event(), threading.Event(), []

    def other():
        with holding() as own:
            table = held(spark.range(7).toDF("x"), "other")
            made.set()
            dropped.wait(60)
            seen.append(table.count())
            own.drop(spark)
        seen.append(table)

    thread = threading.Thread(target=other)
    with holding() as own:
        mine = held(spark.range(3).toDF("x"), "mine")
        thread.start()
        assert made.wait(60) and mine.count() == 3
        own.drop(spark)
        dropped.set()
    thread.join(60)
    assert seen[0] == 7
    for gone in (mine, seen[1]):
        with pytest.raises(Exception, match="(?i)not.exist"):
            gone.collect()


def test_nested_runs(spark):
    with holding() as outer:
        a = held(spark.range(2).toDF("x"), "a")
        with holding():
            held(spark.range(4).toDF("x"), "b")
            drop_held(spark)  # the inner run's
        assert a.count() == 2 and len(outer.paths) == 1
        drop_held(spark)
        assert not outer.paths


def test_pipeline_on_odd_rows_and_an_empty_table(spark, odd_docs, no_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd_docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    no_docs.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert pieces and all(r.length <= 4096 for r in pieces) and {r.doc_id for r in pieces} <= {1, 2, 3, 4, None, 5, 6, 7, 8}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
