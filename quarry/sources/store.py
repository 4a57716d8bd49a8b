"""A versioned table store: every commit writes whole new table versions and then moves one pointer.

A reader sees the version that was current when it opened the store; a writer that dies leaves the pointer where it was.
There is one writer at a time."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schema


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/quarry/{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _pointer(self) -> dict:
        p = self._path(f"{self.root}/CURRENT")
        if not self.fs.exists(p):
            return {"version": 0, "schema": schema.SCHEMA_VERSION, "tables": {}}
        stream = self.fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def table(self, name: str) -> DataFrame:
        """The current version of a table; columns newer than its files are filled."""
        path = self._pointer()["tables"].get(name)
        if path is None:
            return schema.empty(self.spark, name)
        return schema.conform(self.spark.read.parquet(f"{self.root}/{path}"), name)

    def commit(self, **tables: DataFrame) -> int:
        """Write new contents of the named tables as one version."""
        now = self._pointer()
        version = now["version"] + 1
        for name, df in tables.items():
            path = f"{name}/v{version}"
            schema.conform(df, name).write.mode("overwrite").parquet(f"{self.root}/{path}")
            now["tables"][name] = path
        now |= {"version": version, "schema": schema.SCHEMA_VERSION}
        temp, final = self._path(f"{self.root}/.CURRENT.{version}"), self._path(f"{self.root}/CURRENT")
        out = self.fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        # a rename that replaces: readers see the old pointer or the new one
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(temp, final, options)
        return version
