"""Tables of Parquet folders whose versions are switched by one atomic step.

A write is staged in a folder of its own, by Spark's own writer. Only when that has succeeded is a small manifest, which names
the folders of the new version, renamed into place; a rename onto an existing name fails. So a failed write leaves the old
version as it was, of two writers at once one gets a conflict and changes nothing, and a reader sees one whole version.
The manifest also remembers the last batch of each stream, so that a repeated batch is left out in the same step.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ConflictError(Exception):
    """Another writer made the next version first."""


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name under spark.checkpoint.dir; only where that is unset and the session is local, in a folder made for it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lodeloom-")
        spark.sparkContext.setCheckpointDir(known)
    return f"{known}/lodeloom-{what}-{uuid.uuid4().hex}"


class Table:
    """A table in a folder. Its versions count from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The last version's number, 0 where there is none."""
        folder = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"data": [], "schema": None, "batches": {}}
        stream = self._fs.open(self._path("versions", f"{version:010}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["data"]:
            raise ValueError("the table has no version yet")
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*(f"{self.path}/{d}" for d in m["data"]))

    def _switch(self, version: int, manifest: dict) -> None:
        staged, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{version:010}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, final, options)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise ConflictError(f"version {version} was made by another writer") from e
            raise

    def commit(self, rows: DataFrame, append: bool = False, since: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Make rows the next version, or add them to the last one; returns its number.

        since is the version that rows were computed from (the last one, where it isn't given): if there is a later one by the
        time of the switch, there is a conflict. batch is a stream's name and a batch's number; one that the table has taken, or a
        number below, changes nothing.
        """
        since = self.version() if since is None else since
        old = self.manifest(since)
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return since
        folder = f"data/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{folder}")
            batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
            data = [*old["data"], folder] if append else [folder]
            self._switch(since + 1, {"data": data, "schema": json.loads(rows.schema.json()), "batches": batches})
        except Exception:
            self._fs.delete(self._path(folder), True)
            raise
        return since + 1

    def update(self, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, tries: int = 3) -> int:
        """Make what change returns of the last version the next one; after a conflict, again from the version that won."""
        for left in reversed(range(tries)):
            since = self.version()
            if batch and self.manifest(since)["batches"].get(batch[0], -1) >= batch[1]:
                return since
            try:
                return self.commit(change(self.read(since)), since=since, batch=batch)
            except ConflictError:
                if not left:
                    raise
        raise AssertionError

    def forget(self, keep: int = 1) -> None:
        """Delete all but the last versions, and the folders that only these named. Not while others read or write them."""
        last = self.version()
        kept = {d for v in range(max(1, last - keep + 1), last + 1) for d in self.manifest(v)["data"]}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path("versions", f"{v:010}.json"), False)
        for status in self._fs.listStatus(self._path("data")):
            if f"data/{status.getPath().getName()}" not in kept:
                self._fs.delete(status.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(), True)
