"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder serves a session of one machine (tests);
    on a cluster it would split the tables, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends."""
    held = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, held)


class Scratch:
    """Tables of one operator call, written once to the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks that read
    it, not the stages that made it. The shuffle files behind it go at once.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def within(self, name: str) -> Scratch:
        """A folder of its own, for steps whose tables have fixed names."""
        inner = Scratch.__new__(Scratch)
        inner.spark, inner.path = self.spark, self.at(name)
        return inner

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_freed(self.spark):
            df.write.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
