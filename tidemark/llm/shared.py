"""Helpers shared by the training-data operators: scratch tables in the shared
folder, a distributed total order, and word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.store import Scratch, shared_root, shuffles_freed

__all__ = ["Scratch", "before", "in_total_order", "only", "parts", "remembered", "shared_root", "shuffles_freed", "table", "with_index"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id: after all others.
_LAST = (1 << 63) - 1
_REMEMBERED: dict[str, Any] = {}


def in_total_order(df: DataFrame, keys: list[Column], scratch: Scratch, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``_pid`` and ``_row``: rows sorted by ``keys`` over range partitions,
    with each row's place in its partition. Written once, so the numbers hold
    whatever is recomputed later. No task sees more than its range. ``ranges``:
    their number, where it must not follow the size of ``df``.
    """
    placed = (df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    placed = scratch.cut(placed.withColumn("_m", F.monotonically_increasing_id()), name)
    return placed.withColumns({"_pid": F.shiftright("_m", 33), "_row": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")


def before(placed: DataFrame, value: Column, alias: str) -> DataFrame:
    """``_pid`` with the sum of ``value`` over all partitions before it: one row
    for each partition, so its size is bounded by the partition count."""
    from pyspark.sql import Window

    sums = placed.groupBy("_pid").agg(F.sum(value).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias(alias))


def with_index(df: DataFrame, keys: list[Column], scratch: Scratch, name: str, alias: str = "_idx") -> DataFrame:
    """Rows numbered from 0 in the total order of ``keys``."""
    placed = in_total_order(df, keys, scratch, name)
    first = scratch.cut(before(placed, F.lit(1), "_before"), f"{name}_before")
    return placed.join(F.broadcast(first), "_pid").withColumn(alias, F.col("_before") + F.col("_row")).drop("_pid", "_row", "_before")


def only(docs: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of ``docs`` for each of the distinct ``places`` (doc, th)."""
    places = places.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"))  # names that no table has
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__hash": F.xxhash64("text")})
    here = (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__th"))
    twice = keyed.groupBy(F.col("__id").alias("__doc"), F.col("__hash").alias("__th")).agg(F.count("*").alias("__n")).where("__n > 1")
    twice = scratch.cut(twice.select("__doc", "__th"), "repeated")
    held = keyed.join(places, here, "left_semi")
    single = held.join(twice, here, "left_anti").select(*docs.columns)
    return single.unionByName(held.join(twice, here, "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, in order: what Python makes of their texts is small
    beside a batch. An empty batch stays one."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing. Workers outlive the
    stage, and what one stage has gathered would stand beside all that later ones do."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
