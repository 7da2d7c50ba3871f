"""Repeated passages: every window of words that also starts in a document of a
smaller ``doc_id`` is removed, exactly, at word level.

Seed and extend without pairs. Each window has one anchor, the least of its seed
hashes (winnowing): equal windows have equal anchors, so only windows whose
anchor occurs in two documents can repeat. Anchors are matched by their smallest
and largest document alone, with map-side combining. Around matched anchors all
windows that hold them are laid out both ways and matched in the same manner, by
128 bits of hash;
a window that starts earlier elsewhere marks its words, and marks that touch
join to maximal repeats. No two occurrences of a passage are ever paired.

Windows are judged on the input. Null text has no words; documents of fewer
words than a window stay whole; rows of one doc_id are documents that do not
remove from one another; rows of a null id count as the largest and don't remove from one another. Places
belong to (id, text hash), so rows of one id and different texts don't share them. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

_ODD = 0x9E3779B97F4A7C15  # an odd multiplier, so that it has an inverse mod 2^64
_INVERSE = pow(_ODD, -1, 1 << 64)
_LAST = (1 << 63) - 1


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text
    so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factors = np.full((2, size), [[_ODD], [_INVERSE]], np.uint64)
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.of(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _finished((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def hashed(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def anchors(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The anchor of every window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    return _least(rolled(hashes, seed), window - seed + 1).view(np.int64)


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in documents of different ids, with the smallest."""
    return rows.groupBy(*key).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(*key, "least")


def windows(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window, which together decide."""
    return rolled(hashes, window), rolled(_finished(hashes ^ np.uint64(_ODD)), window)


def repeats(docs: DataFrame, scratch: Scratch, window: int = 50, seed: int = 26) -> DataFrame:
    """``doc``, ``th`` (text hash) and ``at``: the starts of windows that a smaller document has."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text", F.xxhash64("text").alias("th"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(anchors(hashed(words_of(t)), window, seed)) for t in part.column(1).to_pylist()]
                doc, th = (np.repeat(part.column(i).to_numpy(), [len(x) for x in found]) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(doc), pa.array(th)], names=["anchor", "doc", "th"])

    seeded = scratch.cut(texts.mapInArrow(seeds, "anchor long, doc long, th long"), "seeds")
    matched = scratch.cut(_shared(seeded, "anchor").select("anchor"), "anchors")
    by_doc = seeded.join(matched, "anchor").groupBy("doc", "th").agg(F.collect_set("anchor").alias("anchors"))
    by_doc = scratch.cut(by_doc, "matched")
    scratch.drop("seeds", "anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, docs_, ths, places = [np.zeros((2, 0), np.int64)], [], [], [np.zeros(0, np.int32)]
                for doc, text, th, known in zip(part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(3), strict=True):
                    hashes = hashed(words_of(text))
                    place = np.flatnonzero(np.isin(anchors(hashes, window, seed), known.values.to_numpy())).astype(np.int32)
                    if len(place):
                        keys.append(np.stack([x[place].view(np.int64) for x in windows(hashes, window)]))
                        places.append(place)
                        docs_.append(np.full(len(place), doc))
                        ths.append(np.full(len(place), th))
                doc, th = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (docs_, ths))
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(keys, axis=1)), doc, th, pa.array(np.concatenate(places))], names=["key", "more", "doc", "th", "at"])

    laid = texts.join(by_doc, ["doc", "th"]).select("doc", "text", "th", "anchors")
    laid = scratch.cut(laid.mapInArrow(extend, "key long, more long, doc long, th long, at int"), "windows")
    scratch.drop("matched")
    earlier = scratch.cut(_shared(laid, "key", "more"), "earlier")
    return laid.join(earlier, ["key", "more"]).where("doc > least").select("doc", "th", "at")


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, window: int = 50, seed: int = 26) -> DataFrame:
    """Each document with ``n_words``, ``n_removed``, its kept text and that
    text's SHA-256 (words joined by one space)."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    found = repeats(docs, scratch, window, seed).groupBy("doc", "th").agg(F.collect_set("at").alias("at"))
    found = scratch.cut(found, "marks")
    scratch.drop("windows", "earlier")
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, sha = [], [], [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text)
                n_words.append(len(words))
                if at.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    places = at.values.to_numpy()
                    edge[places] += 1
                    edge[places + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(words)
                n_removed.append(n_words[-1] - len(words))
                kept.append(joined.decode())
                sha.append(hashlib.sha256(joined).hexdigest())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    marked = texts.join(found, ["doc", "th"], "left").select("doc_id", "text", "at")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
