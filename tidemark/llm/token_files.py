"""Token-id files: documents as fixed-length sequences in Arrow IPC files.

A shard is one Arrow IPC file whose record batches hold two fixed-size-list
columns, ``ids`` and ``mask`` (a byte each, 0: padding), so that sequence ``i`` of a
memory-mapped shard is a slice without a copy or a parse. The documents of a
shard follow one another in ascending ``doc_id``; only its last sequence is
padded. So a shard has two masks at most: the column is dictionary-encoded, the
masks are in the file once and each sequence names its own by a byte. Beside the
shard lies an index file with each document's place in it.

Null text counts as empty (only the end id is written); null ids come first;
repeated rows are written as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import encoder
from tidemark.llm.files import open_fs, ready
from tidemark.llm.shared import Scratch

MANIFEST = "shard long, path string, index_path string, first_id long, docs long, tokens long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Packs id bytes into fixed-length sequences, ``per_batch`` to a record batch."""

    def __init__(self, uri: str, length: int, dtype: np.dtype, per_batch: int):
        system, path = ready(uri)
        self.length, self.dtype, self.room = length, dtype, length * per_batch * dtype.itemsize
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.out = system.open_output_stream(path)
        deltas = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)  # the mask of the last sequence comes late
        self.writer = pa.ipc.new_file(self.out, self.schema, options=deltas)
        self.held = bytearray()

    def add(self, ids: bytes) -> None:
        self.held += ids
        while len(self.held) >= self.room:
            self._batch(bytes(self.held[: self.room]))
            del self.held[: self.room]

    def _batch(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.dtype)
        n, padding = -(-len(ids) // self.length), -len(ids) % self.length
        masks, own = np.ones(self.length, np.uint8), np.zeros(n, np.int8)
        if padding:
            masks, own[-1] = np.concatenate([masks, masks]), 1
            masks[-padding:] = 0
            ids = np.concatenate([ids, np.zeros(padding, self.dtype)])
        ids, masks = (pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, masks))
        columns = [ids, pa.DictionaryArray.from_arrays(pa.array(own), masks)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(bytes(self.held))
        self.writer.close()
        self.out.close()


class Shard:
    """A shard opened for random access; local files are memory-mapped."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        local = system.type_name == "local"
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.per_batch = self.reader.get_batch(0).num_rows if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        batch, row = self.reader.get_batch(i // self.per_batch), i % self.per_batch
        ids, mask = batch.column("ids")[row].values, batch.column("mask")
        return ids.to_numpy(), mask.dictionary[mask.indices[row].as_py()].values.to_numpy()

    def runs(self) -> Iterator[np.ndarray]:
        """The ids of each record batch, padding left out."""
        for i in range(self.batches):
            batch = self.reader.get_batch(i)
            ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask")
            sizes = mask.dictionary.flatten().to_numpy().reshape(-1, self.length).sum(1, dtype=np.int64)
            n = int(sizes[mask.indices.to_numpy()].sum())
            yield ids if n == len(ids) else ids[:n]


def write(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 0, length: int = 2048, per_batch: int = 256) -> DataFrame:
    """Encodes ``text`` of ``docs`` and writes shards in ascending ``doc_id``.
    Returns the manifest: one row for each shard.

    A task that is run again writes files of a new name, and only files that the
    manifest names are ever read.
    """
    folder = scratch.at("shards")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        enc, out, offset, n, first = encoder(tokenizer), None, 0, 0, None
        end = np.asarray([end_id], enc.dtype).tobytes()
        fields = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = ShardWriter(f"{path}.arrow", length, enc.dtype, per_batch)
                system, place = ready(f"{path}.index.arrow")
                sink = system.open_output_stream(place)
                index = pa.ipc.new_file(sink, fields)
                first = batch.column(0)[0].as_py()
            ids = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            for x in ids:
                out.add(x)
            sizes = np.asarray([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            starts = offset + np.cumsum(sizes) - sizes
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(sizes)], schema=fields))
            offset, n = offset + int(sizes.sum()), n + len(ids)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}.arrow", "index_path": f"{path}.index.arrow", "first_id": first, "docs": n, "tokens": offset}])

    placed = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.cut(placed.mapInArrow(shards, MANIFEST), "manifest")


def entries(manifest: DataFrame) -> DataFrame:
    """Reads every shard back: each document with its place in the whole corpus,
    its number of ids and the CRC-32 of its ids as unsigned 32-bit integers.

    The manifest has one row for each partition written, which bounds the running
    total taken over it.
    """
    from pyspark.sql import Window

    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", "index_path", F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long").alias("base"))
    n = manifest.sparkSession.sparkContext.defaultParallelism * 4

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _shard_entries(row)

    return placed.repartition(n, "shard").mapInArrow(read, ENTRIES)


def _shard_entries(row: dict) -> Iterator[pa.RecordBatch]:
    system, place = open_fs(row["index_path"])
    with system.open_input_file(place) as f:
        index = pa.ipc.open_file(f)
        runs, held = Shard(row["path"]).runs(), np.zeros(0, np.uint16)
        for i in range(index.num_record_batches):
            docs = index.get_batch(i)
            crcs = []
            for n in docs.column("tokens").to_numpy():
                parts = [held]
                have = len(held)
                while have < n:
                    parts.append(next(runs))
                    have += len(parts[-1])
                held = np.concatenate(parts) if len(parts) > 1 else held
                crcs.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                held = held[n:]
            start = pa.array(docs.column("offset").to_numpy() + row["base"])
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
