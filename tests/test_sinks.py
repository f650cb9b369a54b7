"""Failed writes leave the old table, repeats change nothing, of two claimants one wins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeloom.sinks import writes as w
from lodeloom.sinks.versions import ConflictError, Table


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/table")


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def ids(table, version=None):
    return sorted(r.id for r in table.read(version).collect())


def broken(df):
    return df.withColumn("v", F.when(F.col("id") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))


def folders(tmp_path):
    return sorted(p.name for p in (tmp_path / "table" / "data").iterdir())


def test_a_failed_write_leaves_the_old_version(spark, table, tmp_path):
    assert table.version() == 0 and table.commit(rows(spark, 1, 2)) == 1
    before = folders(tmp_path)
    for append in (False, True):
        with pytest.raises(Exception, match="lost"):
            table.commit(broken(rows(spark, 3)), append=append)
    assert table.version() == 1 and ids(table) == [1, 2] and folders(tmp_path) == before
    assert table.commit(rows(spark, 3), append=True) == 2 and ids(table) == [1, 2, 3] and ids(table, 1) == [1, 2]


def test_of_two_writers_one_gets_a_conflict(spark, table, tmp_path):
    table.commit(rows(spark, 1))
    table.commit(rows(spark, 2), since=1)
    with pytest.raises(ConflictError):
        table.commit(rows(spark, 3), since=1)
    assert ids(table) == [2] and len(folders(tmp_path)) == 2
    # an update that was overtaken starts from the version that won
    seen = []

    def change(old):
        if not seen:
            seen.append(1)
            table.commit(rows(spark, 9), append=True)
        return old.union(rows(spark, 5))

    assert table.update(change) == 4 and ids(table) == [2, 5, 9]


def test_a_repeated_batch_changes_nothing(spark, table):
    table.commit(rows(spark, 1), batch=("s", 0))
    assert table.commit(rows(spark, 2), append=True, batch=("s", 1)) == 2
    assert table.commit(rows(spark, 2), append=True, batch=("s", 1)) == 2 and table.commit(rows(spark, 7), append=True, batch=("s", 0)) == 2
    assert table.commit(rows(spark, 3), append=True, batch=("other", 0)) == 3 and ids(table) == [1, 2, 3]
    assert table.update(lambda old: old, batch=("s", 1)) == 3


def test_old_versions_are_forgotten(spark, table, tmp_path):
    for i in range(4):
        table.commit(rows(spark, i))
    table.forget(2)
    assert ids(table) == [3] and ids(table, 3) == [2] and len(folders(tmp_path)) == 2
    table.drop()
    assert table.version() == 0 and not (tmp_path / "table").exists()


def test_area_is_replaced_in_one_step(spark, table):
    table.commit(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, area string"))
    with pytest.raises(Exception, match="lost"):
        w.replace_area(table, "a", spark.range(5, 6).withColumn("id", F.when(F.col("id") > 0, F.raise_error(F.lit("lost"))).cast("long")))
    assert ids(table) == [1, 2, 3]
    w.replace_area(table, "a", spark.range(5, 7))
    assert sorted((r.id, r.area or "") for r in table.read().collect()) == [(2, "b"), (3, ""), (5, "a"), (6, "a")]
    w.replace_area(table, "b", spark.range(0))
    assert ids(table) == [3, 5, 6]


def test_merge(spark, table):
    schema = "uid long, a string, b string"
    table.commit(spark.createDataFrame([(1, "x", "y"), (2, "x", None)], schema))
    w.merge(table, spark.createDataFrame([(1, None, "new"), (3, "z", None), (None, "q", "q"), (3, "a", "b")], schema), "uid")
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", "new"), (2, "x", None), (3, "z", None)]


def test_claims(spark, table):
    now, day = 1000 * 86400, 86400
    users = [(1, None, 0, None), (2, "two", 0, now - 40 * day), (3, "three", 0, now - 10 * day), (4, "four", now - 3600, now - 1800), (5, None, 0, None), (6, None, 0, None)]
    table.commit(spark.createDataFrame(users, "uid long, username string, created_s long, renamed_s long"))
    claims = [(1, "Ann", 20), (5, "ann", 10), (6, "ANN", 10), (2, "three", 1), (3, "late", 1), (4, "quick", 1), (1, "a b", 1), (2, "xy", 1), (2, "second", 9), (2, "first", 8), (6, "six", 30), (9, "ghost", 1), (1, None, 1)]
    frame = spark.createDataFrame(claims, "uid long, wanted string, at_s long")
    w.claim_names(table, frame, now)
    names = {r.uid: r.username for r in table.read().collect()}
    assert names == {1: None, 2: "first", 3: "three", 4: "quick", 5: "ann", 6: "six"}
    # the same claims again: those who just got a name wait, and no name is given twice
    w.claim_names(table, frame, now + day)
    after = {r.uid: r.username for r in table.read().collect()}
    assert after == names and len({n for n in after.values() if n}) == 5


def test_stream_delivers_each_event_once(spark, sf, tmp_path, table):
    from lodeloom.binding import Domain

    inbox = Domain(spark, sf).inbox.where("id < 300")
    for n in range(3):
        inbox.where((F.col("id") % 3 == n) | (F.col("id") % 5 == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(r.key for r in w.notices(inbox).collect())

    def go(checkpoint):
        source = spark.readStream.schema(inbox.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = w.deliver_stream(table, source).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.key for r in table.read().collect())

    assert go("cp") == want
    version = table.version()
    assert go("cp") == want and table.version() == version
    assert go("lost-checkpoint") == want and table.version() == version  # every batch comes again, by its number
