"""Best-fit packing of tokenized documents into fixed-size sequences.

Only documents longer than a sequence are cut. The plan is made on the counts of
pieces by length: at most ``capacity`` numbers, however many documents there are.
Large lengths are sorted, dealt into groups of equal cardinality and rounded up
to their group's longest (linear grouping); configurations of these few sizes
are optimised by column generation; actual lengths then take the rounded ones'
places, and what is left, the small lengths last, goes best-fit into the
remaining room. Every entry of the plan covers a run of equal pieces, so placing
a piece is a look-up by its rank among all pieces in order of length.

Null text is empty (a document of the end id alone); repeated rows are separate
documents; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import encoder
from tidemark.llm.shared import Scratch, parts, with_index

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

#: Sequences filled alike: their number and (length, repeats) in order of place.
Bins = tuple[int, tuple[tuple[int, int], ...]]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        size, end = enc.dtype.itemsize, np.asarray([end_id], enc.dtype).tobytes()
        for batch in parts(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                wide = np.frombuffer(ids, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(wide), capacity)):
                    part = wide[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), *([ids[at * size : (at + capacity) * size]] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[:n], strict=True)], names=names[:n])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES + ", ids binary" * keep_ids)


class _Open:
    """Bins with room, by the room left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []

    def put(self, room: int, count: int, slots: tuple) -> None:
        if not self.by_room[room]:
            bisect.insort(self.rooms, room)
        self.by_room[room].append((count, slots))

    def fit(self, length: int, count: int) -> None:
        """Places ``count`` pieces of one length, each time in the tightest room."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                room, bins, slots = self.capacity, count, ()
            else:
                room = self.rooms[i]
                bins, slots = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.rooms[i]
            each = min(room // length, count)
            used = min(bins, count // each)
            if used < bins and slots:
                self.put(room, bins - used, slots)
            self.put(room - each * length, used, (*slots, (length, each)))
            count -= used * each

    def bins(self) -> list[Bins]:
        return [b for found in self.by_room.values() for b in found]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: most worth in ``room``."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(sizes.min()), room + 1):
        ok = sizes <= c
        gain = np.where(ok, worth + best[np.where(ok, c - sizes, 0)], -1.0)
        k = int(gain.argmax())
        best[c], last[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[room]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 150) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of configurations of few sizes from the cutting-stock
    relaxation, solved by column generation with the revised simplex method."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _best_pattern(sizes, np.maximum(worth, 0), room)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = pattern
    return [(int(np.floor(v + 1e-9)), basis[:, j].astype(np.int64)) for j, v in enumerate(x) if v >= 1]


def plan(counts: dict[int, int], capacity: int, groups: int = 32, large: float = 1 / 8, quantum: int = 8) -> list[Bins]:
    """Bins for ``counts`` pieces of each length (1 to ``capacity``)."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[Bins] = []
    if c := left.pop(capacity, 0):
        done.append((c, ((capacity, 1),)))
    big = sorted((n for n in left if n > capacity * large), reverse=True)
    total = sum(left[n] for n in big)
    opened = _Open(capacity)
    if big and total >= 2 * groups:
        each, dealt = total // groups, [[] for _ in range(groups + 1)]
        k, room = 0, each
        for n in big:  # group by group, longest first
            c = left.pop(n)
            while c:
                take = min(c, room) if k < groups else c
                dealt[k].append([n, take])
                c, room = c - take, room - take
                if not room and k < groups:
                    k, room = k + 1, each
        dealt = [g for g in dealt if g]
        sizes = np.asarray([-(-g[0][0] // quantum) for g in dealt])
        demand = np.asarray([float(sum(c for _, c in g)) for g in dealt])
        keep, of = np.unique(sizes, return_inverse=True)  # groups of one rounded size are one
        merged: list[list] = [[] for _ in keep]
        for k, g in zip(of, dealt, strict=True):
            merged[k] += g
        for times, pattern in configurations(keep, np.bincount(of, demand), capacity // quantum):
            slots = [k for k, n in enumerate(pattern) for _ in range(n)]
            while times and slots and all(sum(c for _, c in merged[k]) >= slots.count(k) for k in set(slots)):
                heads, used = [], defaultdict(int)
                for k in slots:  # the longest that are left take the rounded ones' places
                    heads.append(merged[k][0][0])
                    used[k, merged[k][0][0]] += 1
                run = min([times, *(merged[k][0][1] // n for (k, _), n in used.items())])
                if run == 0:  # a head that is too short for all its slots: one bin from the next heads
                    heads = []
                    for k in slots:
                        heads.append(merged[k][0][0])
                        merged[k][0][1] -= 1
                        if not merged[k][0][1]:
                            merged[k].pop(0)
                    run = 1
                else:
                    for (k, _), n in used.items():
                        merged[k][0][1] -= run * n
                        if not merged[k][0][1]:
                            merged[k].pop(0)
                opened.put(capacity - sum(heads), run, tuple((n, 1) for n in heads))
                times -= run
        for g in merged:
            for n, c in g:
                left[n] = left.get(n, 0) + c
    for n in sorted(left, reverse=True):
        opened.fit(n, left[n])
    return done + opened.bins()


def best_plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """The plan of fewest bins over a few numbers of groups and bounds of what is
    large, all by linear grouping."""
    tried = [(32, 1 / 8, 8), (64, 1 / 4, 8), (100, 1 / 3, 4)]
    return min((plan(counts, capacity, *t) for t in tried), key=lambda bins: sum(n for n, _ in bins))


def placements(bins: list[Bins], counts: dict[int, int]) -> dict[str, np.ndarray]:
    """The plan by rank of a piece in order of length: from each rank on, the
    first sequence, the place in it, and how many pieces go into one sequence."""
    first, at = {}, 0
    for n in sorted(counts):
        first[n] = at
        at += counts[n]
    rows, sequence = [], 0
    for count, slots in bins:
        offset = 0
        for n, each in slots:
            rows.append((first[n], sequence, offset, each, n))
            first[n] += count * each
            offset += n * each
        sequence += count
    rows.sort()
    return dict(zip(("rank", "sequence", "offset", "each", "length"), np.asarray(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, scratch: Scratch | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and place; ``keep_ids`` adds the ids."""
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    pieces = scratch.cut(tokenize(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    by_rank = docs.sparkSession.sparkContext.broadcast(placements(best_plan(counts, capacity), counts))  # runs of lengths, not pieces
    keys = [F.col(c) for c in ("length", "doc_id", "piece")]
    ranked = with_index(pieces, keys, scratch, "ranked")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = by_rank.value
        for batch in batches:
            rank = batch.column("_idx").to_numpy()
            if len(rank):
                i = np.searchsorted(p["rank"], rank, "right") - 1
                k = rank - p["rank"][i]
                sequence, offset = p["sequence"][i] + k // p["each"][i], p["offset"][i] + k % p["each"][i] * p["length"][i]
            else:
                sequence = offset = np.zeros(0, np.int64)
            kept = batch.drop_columns(["_idx"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", ids binary" * keep_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces that kept their ids: at most
    ``capacity`` ids meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("length"))
