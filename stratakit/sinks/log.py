"""The log of a store: one small file a state, numbered without gaps; creating the next one is the compare-and-swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

STATES = "generation bigint, operation string, snapshot_id string, operation_id string, name string"


class Moved(ValueError):
    """Another writer was faster."""


class Log:
    """States of a store below ``directory``/log, on any file system that Spark can write.

    A state is created under the number after the head's and never overwritten, so of two writers that saw one head
    only one gets it. On HDFS and alike creation is atomic; on a store without that, writers must take turns.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, f"{directory.rstrip('/')}/log"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def head(self) -> int:
        """The number of the newest state; -1 in an empty log."""
        if not self._fs.exists(self._path(self.directory)):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.directory))]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=-1)

    def states(self) -> DataFrame:
        """(generation, operation, snapshot_id, operation_id, name), read by the executors."""
        if self.head() < 0:
            return self.spark.createDataFrame([], STATES)
        return self.spark.read.schema(STATES).json(f"{self.directory}/*.json")

    def append(self, operation: str, snapshot_id: str | None, expected: int | None = None, operation_id: str | None = None, name: str | None = None) -> int:
        """One more state behind ``expected`` (the head, if None) -> its number.

        An operation id that the log holds already changes nothing, so an attempt may be repeated; a head that moved
        is an error.
        """
        if operation_id is not None:
            done = self.states().where("operation_id = '%s'" % operation_id.replace("'", "")).agg({"generation": "max"}).first()[0]
            if done is not None:
                return done
        head = self.head()
        if expected is not None and head != expected:
            raise Moved("the head moved")
        row = {"generation": head + 1, "operation": operation, "snapshot_id": snapshot_id, "operation_id": operation_id or uuid.uuid4().hex, "name": name}
        try:
            out = self._fs.create(self._path(f"{self.directory}/{head + 1:012d}.json"), False)
        except Exception as e:  # py4j wraps the file system's own error
            if "already exists" in str(e).lower() or "AlreadyExists" in str(e):
                raise Moved("the head moved") from e
            raise
        out.write((json.dumps(row) + "\n").encode())
        out.close()
        return head + 1
