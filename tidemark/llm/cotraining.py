"""A quality classifier by co-training.

Two logistic classifiers see a document from different sides: its words (hashed
words, word shapes and a few counts) and its page metadata (language, source,
recorded length). Over several rounds each gives the other its most confident
labels for a pool of unlabelled documents. Both are then calibrated on held-out
labels, and their evidence beyond the prior is added up. Every document is
scored; one is rejected if its probability of being good is below ``least``.

The classifiers are fitted on at most ``labelled`` labelled and ``pool``
unlabelled documents, those of the smallest hashes of their ids; the models'
size is fixed. Scoring is one pass without a shuffle.

Null text is empty; null language, source and n_chars have features of their own;
labels that are null, conflict or name no document don't count; without labels of
both kinds every document scores 0.5 and none is rejected; repeated rows are
scored alike; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parts, remembered

_WORDS, _SHAPES, _FACTS = 1 << 15, 1 << 10, 5
_META = 341
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")


class _Buckets(dict):
    """Word to its bucket, and in the low 16 bits its shape's; of the last ``most``
    words, and of as many before them, from which those still in use come back."""

    def __init__(self, most: int = 100_000):
        self.most, self.older = most, {}

    def __missing__(self, word: bytes) -> int:
        found = self.older.get(word)
        if found is None:
            shape = _DIGITS.sub(b"0", _LETTERS.sub(b"a", word))
            found = zlib.crc32(word.lower()) % _WORDS << 16 | _WORDS + zlib.crc32(shape) % _SHAPES
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words: their numbers and values; shares of all words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.array([_WORDS + _SHAPES + _FACTS]), np.ones(1)
    both = np.fromiter(map(remembered("buckets", _Buckets).__getitem__, words), np.int64, len(words))
    pairs = np.stack([both >> 16, both & 0xFFFF], 1)
    ids, counts = np.unique(pairs, return_counts=True)
    n = len(words)
    top = counts[ids < _WORDS].max() / n
    repeats = (pairs[1:, 0] == pairs[:-1, 0]).sum() / n
    facts = [top, repeats, min(len(data) / n, 40) / 20, (ids < _WORDS).sum() / n, np.log1p(n) / 10]
    at = _WORDS + _SHAPES
    value = counts / n
    value[ids < _WORDS] = np.sqrt(value[ids < _WORDS]) / 2
    return np.concatenate([ids, at + np.arange(_FACTS), [at + _FACTS]]), np.concatenate([value, facts, [1.0]])


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the page: language, source and recorded length; nothing of the text."""
    n = max(0, n_chars or 0)
    bands = [min(int(np.log2(n + 1)), 31) + 300, 340]
    ids = [zlib.crc32(repr(lang).encode()) % 32, 32 + zlib.crc32(repr(source).encode()) % 256, 290, 291, *bands]
    return np.array(ids), np.array([0.5, 0.5, np.log1p(n) / 10, float(n_chars is None), 0.5, 1.0])


class Sparse:
    """Rows of numbered features."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int):
        self.row, self.ids, self.values = np.repeat(np.arange(len(lengths)), lengths), ids, values
        self.n, self.width = len(lengths), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.ids], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = 120, rate: float = 0.15, ridge: float = 1e-5) -> np.ndarray:
    """Weighted logistic regression by full-batch Adam."""
    w = np.zeros(x.width) if start is None else start.copy()
    m, v, total = np.zeros_like(w), np.zeros_like(w), weight.sum()
    for t in range(1, steps + 1):
        g = x.back((_sigmoid(x.dot(w)) - y) * weight) / total + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling with smoothed targets: logit = a z + b, a not below 0."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = z.std() + 1e-9
    a, b, x = 0.0, float(np.log((n1 + 1) / (n0 + 1))), z / scale
    for _ in range(50):  # Newton
        p = _sigmoid(a * x + b)
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, [(r * x).sum() + 1e-3 * a, r.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (max(0.0, a) / scale, b) if a > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


class Classifier:
    """Weights and scaling of both views; its size doesn't depend on the corpus."""

    def __init__(self, text: np.ndarray | None, meta: np.ndarray | None, scales: list[tuple[float, float]], prior: float):
        self.text, self.meta, self.scales, self.prior = text, meta, scales, prior

    def scores(self, texts: list, langs: list, sources: list, sizes: list) -> np.ndarray:
        """Of each document: by its words, by its metadata, by both."""
        if self.text is None:
            return np.full((len(texts), 3), 0.5)
        out = np.empty((len(texts), 3))
        for i, (text, lang, source, n) in enumerate(zip(texts, langs, sources, sizes, strict=True)):
            for k, ((ids, values), w) in enumerate(((content(text), self.text), (metadata(lang, source, n), self.meta))):
                a, b = self.scales[k]
                out[i, k] = a * float(values @ w[ids]) + b
        out[:, 2] = out[:, 0] + out[:, 1] - self.prior
        return _sigmoid(out)


def cotrain(views: list[Sparse], labels: np.ndarray, held: np.ndarray, rounds: int = 4, share: float = 0.1, sure: float = 0.95) -> Classifier:
    """``labels`` of the first rows, ``held`` of them for calibration; the other
    rows are the pool."""
    y = labels.astype(float)
    balance = np.where(y > 0, 0.5 / max(y[~held].mean(), 1e-6), 0.5 / max(1 - y[~held].mean(), 1e-6))
    weight = np.where(held, 0.0, balance)
    m, n = len(y), views[0].n - len(y)
    given = [np.full(n, np.nan), np.full(n, np.nan)]  # what each view has been told of the pool
    w: list = [None, None]
    for r in range(rounds + 1):
        for k in range(2):
            told = np.nan_to_num(given[k], nan=0.0)
            ok = ~np.isnan(given[k])
            w[k] = logistic(views[k], np.concatenate([y, told]), np.concatenate([weight, np.where(ok, 0.5, 0.0)]), w[k], steps=120 if r == 0 else 60)
        if r == rounds or not n:
            break
        for k in range(2):
            other, z = 1 - k, views[k].dot(w[k])
            a, b = calibrated(z[:m][held], y[held])
            p = _sigmoid(a * z[m:] + b)
            free = np.isnan(given[other])
            for side, rate in ((p, y.mean()), (1 - p, 1 - y.mean())):
                order = np.argsort(-np.where(free, side, -1), kind="stable")[: max(1, int(share * rate * n))]
                order = order[(side[order] >= sure) & free[order]]
                given[other][order] = float(side is p)
    scales = [calibrated(views[k].dot(w[k])[:m][held], y[held]) for k in range(2)]
    prior = float(np.log((y[held].sum() + 1) / ((1 - y[held]).sum() + 1)))
    return Classifier(w[0], w[1], scales, prior)


def _read(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]


def _view(ids: pa.ListArray, values: pa.ListArray, order: np.ndarray, width: int) -> Sparse:
    """The rows at ``order``: no object for each."""
    ends, i, v = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy(), values.flatten().to_numpy()
    lengths = np.diff(ends)[order].astype(np.int64)
    at = np.repeat(ends[order] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return Sparse(lengths, i[at].astype(np.int64), v[at], width)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 4000, pool: int = 4000, seed: int = 1) -> Classifier:
    """Co-trains on bounded samples of ``labels`` (doc_id, quality) and ``docs``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    good = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("y"))
    known = good.where("lo = y").select("_id", "y").join(ids.distinct(), "_id", "left_semi")
    lot = F.xxhash64("_id", F.lit(seed))
    known = known.orderBy(lot, "_id").limit(labelled)
    other = ids.where("_id is not null").distinct().join(known, "_id", "left_anti").orderBy(lot, "_id").limit(pool).withColumn("y", F.lit(None).cast("int"))
    chosen = {r["_id"]: r["y"] for r in known.select("_id", F.col("y").cast("int").alias("y")).unionByName(other).collect()}
    counts = np.bincount([y for y in chosen.values() if y is not None], minlength=2)
    if counts.min() < 10:
        return Classifier(None, None, [], 0.0)
    picked = docs.sparkSession.createDataFrame([(k,) for k in chosen], "_id long")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = _read(batch)
            found = [content(t) for t in columns[0]], [metadata(*x) for x in zip(*columns[1:], strict=True)]
            flat = [pa.array([x[i].tolist() for x in view], pa.list_(kind)) for view in found for i, kind in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), *flat], names=["id", "h", "ti", "tv", "mi", "mv"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        first: dict[int, int] = {}
        for _, i, k in sorted(zip(rows.column("h").to_pylist(), rows.column("id").to_pylist(), range(rows.num_rows), strict=True)):
            first.setdefault(i, k)  # of repeated ids one
        have = sorted(first, key=lambda i: (chosen[i] is None, zlib.crc32(str(i).encode()), i))
        order = np.array([first[i] for i in have])
        views = [_view(rows.column(i), rows.column(v), order, width) for i, v, width in (("ti", "tv", _WORDS + _SHAPES + _FACTS + 1), ("mi", "mv", _META))]
        del rows
        y = np.array([chosen[i] for i in have if chosen[i] is not None])
        held = np.zeros(len(y), bool)
        for side in (0, 1):
            held[np.flatnonzero(y == side)[::4]] = True
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(cotrain(views, y, held))])], names=["model"])

    fields = ["text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")]
    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(*fields).alias("_h"), *fields).join(F.broadcast(picked), "_id")
    rows = some.mapInArrow(features, "id long, h long, ti array<int>, tv array<double>, mi array<int>, mv array<double>")
    # bounded by the samples; in one task, so that the driver holds the model alone
    return pickle.loads(rows.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def score(docs: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """``doc_id``, the three probabilities of being good, and ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p = sent.value.scores(*_read(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= least)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(rows, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p = sent.value.scores(*_read(batch))
            yield batch.filter(pa.array(p[:, 2] >= least))

    return docs.mapInArrow(rows, docs.schema)
