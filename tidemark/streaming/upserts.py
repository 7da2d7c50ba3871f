"""Late and republished rows: a file stream whose batches are upserted.

The last write of a key wins, however late. Each batch is folded to one row for a
key, merged with the stored table, and written beside it; a marker file then
names the new version, so a batch that is run again after a failure replaces its
own half-written version and readers never see one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.warehouse import last_wins, upsert


class Versioned:
    """A table of versions ``v=N`` under a folder; the newest marked one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder = self.hadoop(f"{self.path}/_versions")
        if not self.fs.exists(folder):
            return -1
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(folder)), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self.fs.mkdirs(self.hadoop(f"{self.path}/_versions"))
        self.fs.create(self.hadoop(f"{self.path}/_versions/{version}"), True).close()


def run(spark: SparkSession, source: str, table: Versioned, keys: list[str], updatable: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts all files of ``source`` that haven't been seen, then stops."""
    stream = spark.readStream.schema(table.schema).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if table.version() < batch_id:  # else this batch is in already
            table.write(upsert(table.read(), last_wins(batch, keys, order), keys, updatable), batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, late rows within the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
