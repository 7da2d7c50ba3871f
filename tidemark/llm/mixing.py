"""Mixing sources to target weights.

Each source's words, in ascending ``doc_id``, form blocks of fixed length. For
every output shard the number of slots of each source is one multinomial draw.
Slots of a source are numbered through all shards. What the draws give a source
beyond its target, its last slots, goes to the sources that they left short, so
totals meet their targets to a slot. Slot ``j`` takes block ``P(j mod n)`` where
``P`` is a pseudorandom permutation of the source's ``n`` blocks, another one on
each pass. Slots and blocks are joined by (source, block), keys that spread a hot
source evenly.

Null text has no words; documents without words take nothing; a null source is a
source, the last in order; repeated rows are separate documents; an empty table
gives an empty result; extra columns are ignored. Totals of sources go to the
driver; more than ``MOST_SOURCES`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, Scratch, before, in_total_order, parts

WEIGHTS = (5, 2, 1)
MOST_USES = 3
MOST_SOURCES = 1 << 16
_SLOTS = "shard long, source_no int, slot long, block long"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_USES) -> list[float]:
    """Shares of all words by weight, none above ``most`` times its own size;
    what is cut off goes to the others by weight."""
    size = np.asarray(sizes, float)
    weight = np.resize(np.asarray(weights, float), len(size))
    target, free, left = np.zeros(len(size)), np.ones(len(size), bool), size.sum()
    while free.any() and left > 0:
        share = np.where(free, left * weight / weight[free].sum(), 0)
        over = free & (share > most * size)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = most * size[over]
        left = size.sum() - target[~free | over].sum()
        free &= ~over
    return target.tolist()


def whole(goals: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Goals as whole numbers of the same sum, none above ``most``: the largest
    remainders are rounded up."""
    out = np.minimum(np.floor(goals + 1e-9).astype(np.int64), most)
    rest = min(round(float(goals.sum())), int(most.sum())) - int(out.sum())
    order = np.argsort(-np.where(out < most, goals - out, -1.0), kind="stable")[: max(0, rest)]
    out[order] = np.minimum(out[order] + 1, most[order])
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x + np.uint64(key & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of 0..n-1: a
    Feistel network on the next power of four, walked until back below n."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b = x[todo] >> shift, x[todo] & low
        for r in range(4):
            a, b = b, a ^ (_mixed(b, key * 4 + r) & low)
        x[todo] = a << shift | b
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


class Mix:
    """The mix of ``docs`` (doc_id, text, source): its tables are ``documents``
    (one row for each document), ``pieces`` (each document's words in blocks) and
    ``slots`` (the blocks of each shard in order). ``tie``: a column that numbers
    the rows."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block: int = 64, shard_slots: int = 1 << 12, seed: int = 1, tie: str | None = None):
        self.spark, self.scratch, self.block, self.seed = docs.sparkSession, scratch, block, seed
        sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
        sized = scratch.cut(sized, "sized")
        rows = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.asc_nulls_last("source")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        sizes = [r["n"] for r in rows]
        goals = targets(sizes)
        self.blocks = [-(-n // block) for n in sizes]
        starts = [int(x) for x in np.cumsum([0, *sizes])[: len(sizes)]]
        self.sources = self.spark.createDataFrame([(k, r["source"], n, g, s) for k, (r, n, g, s) in enumerate(zip(rows, sizes, goals, starts, strict=True))], "source_no int, _source string, source_size long, target double, _start long")
        placed = in_total_order(sized, [F.asc_nulls_last("source"), F.col("doc_id"), F.col("size"), F.col("_text"), F.col("_tie")], scratch, "placed")
        within = Window.partitionBy("_pid").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        ahead = before(placed, F.col("size"), "_ahead")
        named = placed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(ahead), "_pid")
        named = named.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("_source")))
        row_id = F.shiftleft("_pid", 33).bitwiseOR(F.col("_row")).alias("row_id")
        first = (F.col("_ahead") + F.col("_in") - F.col("_start")).alias("first")
        self.documents = scratch.cut(named.select(row_id, "doc_id", "source", "size", "_tie", "source_no", "source_size", "target", first), "documents")
        b = F.lit(block)
        spans = self.documents.where("size > 0").select("row_id", "source_no", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
        low, high = F.greatest(F.col("first"), F.col("block") * b), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b)
        self.pieces = spans.select("row_id", "source_no", "block", (low - F.col("first")).alias("from_word"), (high - F.col("first")).alias("to_word"))
        self.slots = self._slots(sizes, goals, shard_slots)

    def _slots(self, sizes: list[int], goals: list[float], shard_slots: int) -> DataFrame:
        have, seed = np.asarray(self.blocks, np.int64), self.seed
        due = whole(np.asarray(goals) * have / np.maximum(np.asarray(sizes, float), 1), MOST_USES * have)
        total = int(due.sum())
        if not total:
            return self.spark.createDataFrame([], _SLOTS)
        share, shards = due / total, -(-total // shard_slots)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = batch.column(0).to_numpy()
                count = np.array([np.random.Generator(np.random.Philox(key=[seed, k])).multinomial(min(shard_slots, total - k * shard_slots), share) for k in shard.tolist()], np.int64).reshape(-1, len(share))
                at, source = np.nonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(source.astype(np.int32)), pa.array(count[at, source])], names=["shard", "source_no", "n"])

        drawn = self.spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long").withColumn("_lot", F.col("shard").bitwiseAND(~1023))
        drawn = self.scratch.cut(drawn, "drawn")
        sums = np.zeros(len(due), np.int64)
        for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # one for each source
            sums[r["source_no"]] = r["n"]
        short = np.cumsum(np.concatenate([[0], np.maximum(due - sums, 0)]))
        over = np.cumsum(np.concatenate([[0], np.maximum(sums - due, 0)]))
        earlier = Window.partitionBy("source_no").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
        lots = drawn.groupBy("source_no", "_lot").agg(F.sum("n").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
        within = Window.partitionBy("source_no", "_lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        started = drawn.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(lots, ["source_no", "_lot"]).select("shard", "source_no", "n", (F.col("_ahead") + F.col("_in")).alias("start"))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, first, n, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    slot = np.arange(start, start + n, dtype=np.int64)
                    source = np.full(n, first)
                    gone = slot >= due[first]  # goes to a source that the draws left short
                    place = over[first] + slot[gone] - due[first]
                    source[gone] = np.searchsorted(short, place, "right") - 1
                    slot[gone] = sums[source[gone]] + place - short[source[gone]]
                    taken = np.empty_like(slot)
                    for k in np.unique(source):
                        for turn in range(MOST_USES):
                            ok = (source == k) & (slot // have[k] == turn)
                            if ok.any():
                                taken[ok] = permuted(slot[ok] % have[k], int(have[k]), (seed * 1_000_003 + int(k)) * MOST_USES + turn)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(source.astype(np.int32)), pa.array(slot), pa.array(taken)], names=["shard", "source_no", "slot", "block"])

        return started.mapInArrow(number, _SLOTS)

    def uses(self) -> DataFrame:
        """``pieces`` with ``uses``, how often the mix takes their block."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        # written first: the planner takes slots for as few as the draws they come from, and would broadcast them
        return self.pieces.join(self.scratch.cut(times, "times"), ["source_no", "block"])

    def taken(self) -> DataFrame:
        words = self.uses().groupBy("row_id").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")).alias("taken"))
        words = self.scratch.cut(words, "words")
        return self.documents.join(words, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, scratch: Scratch, block: int = 64, seed: int = 1) -> DataFrame:
    """The mix as documents: each as often as its blocks are used, a copy whose
    blocks aren't all used holding the words of those that are."""
    names = docs.columns
    rows = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # written, so the numbers hold
    mix = Mix(rows, scratch, block, seed=seed, tie="__row")
    spans = mix.uses().groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word", "uses"))).alias("spans"))
    spans = mix.documents.join(spans, "row_id").select(F.col("_tie").alias("__at"), F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    spans = scratch.cut(spans, "spans")
    held = rows.join(spans, F.col("__row") == F.col("__at")).select(*names, "__size", "__spans")
    schema = docs.schema
    at = names.index("text")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            picks, texts = [], []
            for i, (text, size, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__size").to_pylist(), batch.column("__spans").to_pylist(), strict=True)):
                words = None
                for k in range(1, MOST_USES + 1):
                    kept = [(s["from_word"], s["to_word"]) for s in spans if s["uses"] >= k]
                    if not kept:
                        break
                    if sum(b - a for a, b in kept) == size:
                        texts.append(text)
                    else:
                        words = words or text.encode().split()
                        texts.append(b" ".join(w for a, b in kept for w in words[a:b]).decode())
                    picks.append(i)
            rows = batch.select(names).take(pa.array(picks, pa.int64()))
            columns = list(rows.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t) for t in texts], rows.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(copies, schema)
