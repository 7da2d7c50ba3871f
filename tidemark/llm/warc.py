"""WARC archives: one gzip member for each record, written in parallel shards
and read back sequentially.

Equal payloads are stored once: the page with the smallest ``page_id`` is a
``response`` record, the others are ``revisit`` records that name it. Pages of a
null id come after all others; exact repeats of the first page are responses
too. Null html is an empty payload, a null url an empty target. Extra columns
are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.files import open_fs, ready
from tidemark.llm.shared import Scratch

IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


class BadArchive(ValueError):
    """An archive that breaks the format, or a digest that doesn't fit."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(url.split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _uri(refers_to))] if refers_to is not None else []),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def members(source, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each gzip member, unpacked piece by piece as it is read;
    never more than one member is held."""
    data, unpack, parts = source.read(chunk), None, []
    while data:
        unpack = unpack or zlib.decompressobj(31)
        try:
            parts.append(unpack.decompress(data))
        except zlib.error as e:
            raise BadArchive(f"not a gzip member: {e}") from e
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data or source.read(chunk), None, []
        else:
            data = source.read(chunk)
    if unpack is not None:
        raise BadArchive("the archive ends within a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record, framed by Content-Length."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise BadArchive("a record without a WARC head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise BadArchive("a record without a length") from e
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("a block that doesn't fit its length")
    return fields, rest[:n]


def read_records(source) -> Iterator[dict]:
    """Each record of an open archive with its payload (None for revisits)."""
    for member in members(source):
        fields, block = parse(member)
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = fields["warc-type"]
        ok = digest(block) == fields.get("warc-block-digest", "").removeprefix("sha1:")
        if kind == "response":
            ok = ok and digest(payload) == said and len(payload) == length
        yield {"fields": fields, "type": kind, "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": said, "digest_ok": ok}


def _page(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to WARC shards; returns their paths.

    Payloads are matched by digest over ids alone, the first page of each digest
    is found with map-side combining, and only digests that occur twice are
    joined back, so pages of one very common payload spread over all tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    ids = base.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    twice = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    twice = scratch.cut(twice, "payloads")
    later = ids.join(twice, "sha").where("page_id is null or page_id > refers_to").distinct()
    later = scratch.cut(later.withColumnsRenamed({"page_id": "_id", "sha": "_sha"}), "revisits")
    full = base.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    folder = scratch.at("archives")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system, place = ready(path)
                    out = system.open_output_stream(place, compression=None)
                out.write(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n}])

    full = full.select("page_id", "url", "html", "refers_to")
    return scratch.cut(full.mapInArrow(shards, "path string, records long"), "manifest")


def read(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """Reads archives sequentially, a shard to a task at a time. ``strict``:
    a digest that doesn't fit raises; else it shows in ``digest_ok``."""
    n = manifest.sparkSession.sparkContext.defaultParallelism * 4

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = open_fs(path)
                with system.open_input_stream(place, compression=None) as f:
                    yield from _tables(path, f)

    def _tables(path: str, source) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])
        for r in read_records(source):
            if strict and not r["digest_ok"]:
                raise BadArchive(f"{path}: {r['fields'].get('warc-record-id')} doesn't fit its digest")
            f = r["fields"]
            held.append({"page_id": _page(f["warc-record-id"]), "url": f.get("warc-target-uri"), "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["type"], "refers_to": _page(f.get("warc-refers-to")), "digest_ok": r["digest_ok"]})
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.select("path").repartition(n, "path").mapInArrow(rows, RECORDS)
