"""Connected components of a distributed graph by alternating large and small
stars. Only minima are gathered by node; edges of a very common node stay spread
over tasks (its join splits), and each step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Joins each node ``u`` with the least of itself and its neighbours ``v``."""
    least = scratch.cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
    return edges.join(least, "u")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """``edges`` (u, v: long) to (u, root): the smallest node that ``u`` reaches,
    for every node but the roots. Self-loops, repeats and nulls don't count."""
    e = scratch.cut(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "edges-0")
    sign = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = tuple(e.agg(*sign).head())
    for k in range(1, rounds + 1):
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        large = _star(both, scratch, f"large-{k}").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        large = scratch.cut(large, f"spread-{k}")
        small = _star(large, scratch, f"small-{k}")
        small = small.selectExpr("v as u", "m as v").unionByName(small.selectExpr("u", "m as v")).where("u <> v").distinct()
        e = scratch.cut(small, f"edges-{k}")
        now = tuple(e.agg(*sign).head())
        scratch.drop(f"edges-{k - 1}", f"large-{k}", f"spread-{k}", f"small-{k}")
        if now == before:
            return e.withColumnRenamed("v", "root")
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")
