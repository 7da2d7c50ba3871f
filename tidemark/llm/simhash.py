"""SimHash near-duplicates: 64-bit fingerprints of word shingles and a binary
trie self-join under a Hamming budget.

Fingerprints within ``d`` bits agree in at least two of ``d + 2`` blocks, so the
join is dealt out by pairs of equal blocks. In each cell a trie over its sorted
fingerprints is traversed by pairs of nodes: differing bits add up on the way
down, and a pair beyond the budget is dropped with all below it. A cell returns
no pairs but each fingerprint's link to the smallest of its group there; a cell
of more than ``most`` fingerprints is dealt anew by pairs of subtrees. Groups
then join up by connected components.

Null or empty text has fingerprint zero and links like any other; equal texts
meet in one fingerprint before the join; null ids take part but never name a
group (a group of null ids alone has a null name); rows of one id and different
texts link as separate documents; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import Scratch, only, parts, with_index

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if over half of the shingles' hashes have it set."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # both take ASCII alone
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[:-1]]
    last = ends[width - 1 :] or ends[-1:]
    return majority(np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, last, strict=False)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it set."""
    over = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        over += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp``, the fingerprint as a signed number, and ``th``, a hash of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=["doc_id", "fp", "th"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(rows, "doc_id long, fp long, th long")


def trie_pairs(values: np.ndarray, budget: int, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``values`` within ``budget`` bits.

    A node is a range of values that share their leading bits. Pairs of nodes go
    down together, depth first by chunks, so memory stays bounded.
    """
    n = len(values)
    todo = [(0, np.array([[0], [n], [0], [n], [0]], np.int64))] if n > 1 else []
    while todo:
        bit, pairs = todo.pop()
        a0, a1, b0, b1, d = pairs
        leaf = (a1 - a0) * (b1 - b0) <= 4
        for i, j in ((i, j) for i in range(4) for j in range(4) if (i + 1) * (j + 1) <= 4):  # compared outright
            ok = leaf & (a0 + i < a1) & (b0 + j < b1)
            x, y = (a0 + i)[ok], (b0 + j)[ok]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            if near.any():
                yield x[near], y[near]
        a0, a1, b0, b1, d = pairs[:, ~leaf]
        if not len(d):
            continue
        one = np.uint64(1 << (BITS - 1 - bit))
        ones = np.concatenate([[0], np.cumsum((values & one) != 0)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the bit turns to 1
        same = a0 == b0
        parts = [(a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None), (a0, am, bm, b1, d + 1, None), (am, a1, b0, bm, d + 1, same)]
        below = []
        for w, x, y, z, e, skip in parts:
            ok = (w < x) & (y < z) & (e <= budget) & ~((w == y) & (x - w < 2))
            ok = ok if skip is None else ok & ~skip
            below.append(np.stack([w, x, y, z, e])[:, ok])
        found = np.concatenate(below, axis=1)
        todo += [(bit + 1, found[:, i : i + chunk]) for i in range(0, found.shape[1], chunk)]


def groups(values: np.ndarray, budget: int) -> np.ndarray:
    """For each of the sorted distinct ``values`` the first index of its group."""
    root = np.arange(len(values))
    for x, y in trie_pairs(values, budget):
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root != root[root]).any():
                root = root[root]
    return root


def links(fps: DataFrame, budget: int, scratch: Scratch, most: int = 1 << 14, direct: bool = False) -> DataFrame:
    """Edges (u, v) between the ``node`` numbers of ``fps`` (fp, node) that join
    up all fingerprints within ``budget`` bits: a spanning forest of each cell.
    ``direct``: from each to the smallest node of those within the budget, by cell."""
    blocks = budget + 2
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in pair) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    dealt = fps.select("fp", "node", F.explode(cells).alias("c")).select("fp", "node", "c.*")
    sizes = scratch.cut(dealt.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    # a large cell goes to pairs of subtrees: by leading bits of what the blocks leave
    depth = F.when(F.col("n") > most, F.least(F.lit(40), F.ceil(F.log2(F.col("n") / most)) + 1)).otherwise(0).cast("int")  # no cell has 2^40 times as many
    free = F.element_at(F.array(*[F.lit(~m) for m in signed]), F.col("k") + 1)
    rest = _gathered(F.col("fp").bitwiseAND(free), masks)
    held = dealt.join(sizes, ["k", "key"]).withColumn("depth", depth).withColumn("rest", rest)
    part = F.expr("shiftrightunsigned(rest, 64 - depth)")
    top = sizes.agg(F.max(depth)).head()[0] or 0  # the deepest that any cell goes
    reach = sorted(sum(1 << i for i in at) for k in range(budget + 1) for at in combinations(range(top), k))
    near = F.expr(f"filter(array({', '.join(f'{m}L' for m in reach)}), m -> m < shiftleft(1L, depth))")
    small = held.where("depth = 0").select("k", "key", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "fp", "node")
    large = held.where("depth > 0").withColumn("own", part).select("k", "key", "own", "fp", "node", F.explode(near).alias("m"))
    large = large.withColumn("other", F.col("own").bitwiseXOR(F.col("m"))).select("k", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "node")
    cell = ["k", "key", "p", "q"]
    dealt = small.unionByName(large).repartition(*cell).sortWithinPartitions(*cell)

    edges_of = _direct if direct else _forest

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            fp, node = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *turns], [*turns, len(fp)], strict=True):
                key = tuple(keys[:, a])
                if key != last and held:
                    yield from edges_of(held, budget)
                    held = []
                last = key
                held.append((fp[a:b], node[a:b]))
        if held:
            yield from edges_of(held, budget)

    return dealt.mapInArrow(edges, "u long, v long")


def _gathered(rest, masks):
    """The bits that a cell's blocks leave, moved to the top by its number ``k``."""
    out = None
    for k, m in enumerate(masks):
        moved, at, i = None, BITS, BITS
        while i > 0:  # runs of free bits, from the top
            if m >> (i - 1) & 1:
                i -= 1
                continue
            j = i
            while j > 0 and not m >> (j - 1) & 1:
                j -= 1
            run = ((1 << i) - (1 << j)) - (1 << BITS if i == BITS else 0)
            piece = F.shiftleft(rest.bitwiseAND(F.lit(run)), at - i)
            moved = piece if moved is None else moved.bitwiseOR(piece)
            at -= i - j
            i = j
        out = F.when(F.col("k") == k, moved) if out is None else out.when(F.col("k") == k, moved)
    return out


def _forest(held: list, budget: int) -> Iterator[pa.RecordBatch]:
    fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
    if len(fp) < 2:
        return
    order = np.argsort(fp.view(np.uint64))
    root = groups(fp[order].view(np.uint64), budget)
    node = node[order]
    joined = root != np.arange(len(root))
    if joined.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], names=["u", "v"])


def _direct(held: list, budget: int) -> Iterator[pa.RecordBatch]:
    fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
    if len(fp) < 2:
        return
    order = np.argsort(fp.view(np.uint64))
    node, best = node[order], node[order]
    for x, y in trie_pairs(fp[order].view(np.uint64), budget):
        np.minimum.at(best, x, node[y])
        np.minimum.at(best, y, node[x])
    linked = best < node
    if linked.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(best[linked])], names=["u", "v"])


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest doc_id that it reaches by links of at most ``budget`` bits."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    return _grouped(docs, width, budget, seed, scratch).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, width: int, budget: int, seed: int, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``fp``, ``th``, ``component_id`` and ``group``, a number for each group."""
    of = scratch.cut(fingerprints(docs, width, seed), "fingerprints")
    # nodes are numbered by smallest id, those of null ids alone after all others, so a root has its group's smallest id
    fps = of.groupBy("fp").agg(F.min("doc_id").alias("least"))
    fps = scratch.cut(with_index(fps, [F.asc_nulls_last("least"), F.col("fp")], scratch, "ordered", "node"), "distinct")
    roots = scratch.cut(components(links(fps.select("fp", "node"), budget, scratch), scratch), "roots")
    named = fps.join(roots, fps["node"] == roots["u"], "left").select("fp", F.coalesce("root", "node").alias("group"))
    named = scratch.cut(named.join(fps.select(F.col("node").alias("group"), F.col("least").alias("component_id")), "group"), "named")
    return of.join(named, "fp").select("doc_id", "fp", "th", "component_id", "group")


def one_of_each(docs: DataFrame, width: int = 3, budget: int = 2, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row for each group: that of the smallest id, null ids
    last, and of an id's texts the one of the smallest hash. Only ids and text
    hashes are matched; texts move once."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    found = _grouped(docs, width, budget, seed, scratch)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "th")).alias("keep")
    return only(docs, scratch.cut(found.groupBy("group").agg(first).select("keep.*"), "heads"), scratch)
