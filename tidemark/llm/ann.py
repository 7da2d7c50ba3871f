"""Approximate nearest neighbours by learned partitions.

A bounded sample (``sample`` rows, the smallest by a hash of their id) gives a
neighbour graph; recursive spectral bisection cuts it into balanced parts of few
cut edges; a small network learns which parts hold a vector's neighbours. Every
row is indexed under its likeliest part. A query goes to its ``probes`` likeliest
parts, as many as reach ``coverage`` of the sample's true neighbours: first to the likeliest, then
to the others, which return only what beats its k-th product. All are exact
products. A part of many rows or queries is dealt to cells, so
no task holds more than ``cell`` rows and ``cell`` queries.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows of a null id or of a length other than the commonest. Ties go to the
smaller id; fewer candidates give fewer ranks; repeated ids are separate
candidates, but never of a query of their own id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

_FOUND = "query_id long, vec_id long, score double"


def neighbours(x: np.ndarray, k: int, block: int = 1000) -> np.ndarray:
    """The ``k`` largest inner products of each row with the others."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisected(near: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """2^depth parts of equal size: at each level every part is halved at the
    median of a vector smoothed along its edges."""
    n, k = near.shape
    part = np.zeros(n, np.int64)
    flat, source = near.ravel(), np.repeat(np.arange(n), k)
    for _ in range(depth):
        keep = part[flat] == part[source]
        a, b = source[keep], flat[keep]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        size = np.bincount(part)
        x = rng.standard_normal(n)
        for _ in range(60):
            x -= (np.bincount(part, x * degree) / np.bincount(part, degree))[part]
            x = (x + np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / degree
            x /= np.sqrt(np.bincount(part, x * x) / size)[part] + 1e-12
        order = np.lexsort((x, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - (np.cumsum(size) - size)[part[order]]
        part = 2 * part + (rank >= size[part] // 2)
    return part


class Router:
    """A network of one hidden layer from a vector to its parts' odds."""

    def __init__(self, inputs: int, parts: int, hidden: int, rng: np.random.Generator):
        self.w = [rng.standard_normal((inputs, hidden)) * (2 / inputs) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * hidden**-0.5, np.zeros(parts)]
        self.scale = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, odds: np.ndarray, rng: np.random.Generator, epochs: int = 30, batch: int = 256, rate: float = 3e-3) -> None:
        """Cross-entropy against the odds, by Adam."""
        self.scale = 1 / (np.sqrt((x * x).mean()) + 1e-12)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xs = x[rows] * self.scale
                h = np.maximum(xs @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p = (p / p.sum(1, keepdims=True) - odds[rows]) / len(rows)
                back = (p @ self.w[2].T) * (h > 0)
                t += 1
                step = rate * (1 - epoch / epochs)
                for i, g in enumerate((xs.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def fitted(x: np.ndarray, rows: int, per_part: int, coverage: float, seed: int = 1, k: int = 20) -> tuple[Router, int, int]:
    """Router, number of parts and of probes, from a sample of ``rows`` rows."""
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(1.0, rows / per_part)))))  # two parts at least
    depth = min(depth, max(0, int(np.log2(max(1, len(x) / 64)))))  # of 64 rows of the sample each
    parts, k = 1 << depth, min(k, len(x) - 1)
    router = Router(x.shape[1], parts, 64, rng)
    if parts == 1:
        return router, 1, 1
    near = neighbours(x, k)
    part = bisected(near, depth, rng)
    held = rng.random(len(x)) < 0.1
    odds = np.zeros((len(x), parts))
    np.add.at(odds, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 1 / (2 * k))
    odds[np.arange(len(x)), part] += 0.5
    router.fit(x[~held], odds[~held], rng)
    z = router.scores(x)
    home = z.argmax(1)
    rank = np.argsort(np.argsort(-z[held], axis=1), axis=1)
    need = np.take_along_axis(rank, home[near[held]], axis=1)
    share = np.array([(need <= p).mean() for p in range(parts)])
    return router, parts, int(np.argmax(share >= coverage)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top(queries: np.ndarray, ids: np.ndarray, lows: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's ``k`` largest inner products of at least its ``lows``. Products
    that may be among them are taken again one by one, so that equal vectors score
    equally."""
    out: list[tuple] = []
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256] @ rows.T
        s[ids[at : at + 256, None] == row_ids[None, :]] = -np.inf
        n = min(k, s.shape[1])
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        least = np.maximum(least, lows[at : at + 256])
        slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
        for i in np.flatnonzero(s.max(1) >= least - slack):
            found = np.flatnonzero((s[i] >= least[i] - slack[i]) & (s[i] > -np.inf))
            exact = (rows[found] * queries[at + i]).sum(1)
            best = np.lexsort((row_ids[found], -exact))[:k]
            best = best[exact[best] >= lows[at + i]]
            out.append((np.full(len(best), ids[at + i]), row_ids[found[best]], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 10_000, per_part: int = 1024, coverage: float = 0.95, cell: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the rows that ``is_query``."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"), is_query.alias("is_query"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    lengths = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = lengths[0]["n"], lengths[0]["count"]
    v = v.where(F.size("x") == width)
    few = v.select("x", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).collect()
    router, parts, probes = fitted(np.array([r["x"] for r in few]), rows, per_part, coverage)
    model = spark.sparkContext.broadcast(router)  # its size depends on width and parts alone

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-model.value.scores(_matrix(batch.column(1))), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order))], names=[*batch.schema.names, "parts"])

    routed = scratch.cut(v.mapInArrow(route, "vec_id long, x array<double>, is_query boolean, parts array<int>"), "routed")
    home = F.element_at("parts", 1).alias("part")
    sizes = routed.groupBy(home).agg(F.ceil(F.count("*") / cell).cast("int").alias("row_cells"))  # one row for each part
    asked = routed.where("is_query").select("vec_id", "x", F.posexplode("parts").alias("probe", "part"))
    loads = asked.groupBy("part").agg(F.ceil(F.count("*") / cell).cast("int").alias("query_cells"))
    cells = F.broadcast(scratch.cut(sizes.join(loads, "part"), "cells"))
    some = lambda n, salt: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = routed.select("vec_id", "x", home).join(cells, "part").withColumn("rc", some("row_cells", 2)).select("part", every("query_cells").alias("qc"), "rc", "vec_id", "x")
    right = right.select(*[F.col(c).alias(f"row_{c}") for c in right.columns])

    def rerank(q: pa.Table, r: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if q.num_rows and r.num_rows:
            found = top(_matrix(q["x"]), q["vec_id"].to_numpy(), q["low"].to_numpy(), _matrix(r["row_x"]), r["row_vec_id"].to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    def reranked(queries: DataFrame) -> DataFrame:
        key = ["part", "qc", "rc"]
        left = queries.join(cells, "part").withColumn("qc", some("query_cells", 1)).select("part", "qc", every("row_cells").alias("rc"), "vec_id", "x", "low")
        return left.groupBy(*key).cogroup(right.groupBy(*[f"row_{c}" for c in key])).applyInArrow(rerank, _FOUND)

    # the likeliest part first; the others then return only what beats its k-th
    near = scratch.cut(reranked(asked.where("probe = 0").withColumn("low", F.lit(float("-inf")))), "nearest")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    lows = scratch.cut(near.withColumn("_r", rank).where(F.col("_r") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_low")), "lows")
    rest = asked.where("probe > 0").join(lows, F.col("vec_id") == F.col("_q"), "left").withColumn("low", F.coalesce("_low", F.lit(float("-inf"))))
    found = near.unionByName(reranked(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
