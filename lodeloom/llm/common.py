"""What the corpus operators share: reading tables and holding intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of whole texts.
TEXT_BATCH = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the session runs on one machine, as in tests, is a local folder made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lodeloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def in_text_batches(df: DataFrame, rows: int = TEXT_BATCH) -> DataFrame:
    """df, with the session's Arrow batches at most so many rows, so that a task's batch of whole texts takes little memory.

    Batches are bounded by bytes as well, by spark.sql.execution.arrow.maxBytesPerBatch (64 MB where it isn't set), so that long texts
    don't make them large. The setting stays for the session, as it is read when the result is computed.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


class Held:
    """Tables and folders that one run holds in the shared folder. Another run's are not touched by dropping these."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        """Delete them. Only when all results that read them have been written: a result is computed when it is written."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_RUN: ContextVar[Held] = ContextVar("run", default=Held())  # noqa: B039  what is held outside any run


@contextmanager
def holding() -> Iterator[Held]:
    """What is held inside belongs to the run that this gives. Threads and nested runs have their own."""
    own = Held()
    token = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(token)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder, with its scheme; the run holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodeloom-{what}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    _RUN.get().paths.append(path.toString())
    return path.toString()


def held(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of files and no recomputation. The table stays until its run is dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeloom-{what}-{uuid.uuid4().hex}"
    _RUN.get().paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_held(spark: SparkSession) -> None:
    """Delete what is held by the current run, or outside any run."""
    _RUN.get().drop(spark)


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of a null text, that of no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_crc32(doc_id: Column) -> Column:
    """CRC-32 of an id's decimal digits, which folds are cut by; a null id counts as empty text."""
    return utf8_crc32(doc_id.cast("string"))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """An Arrow batch of rows under a schema of plain columns, "name type, name type"."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
