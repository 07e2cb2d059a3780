"""WARC files: a writer, and a sequential reader of one gzip member per record.

The reader takes a stream in pieces, inflates member after member, finds the
header's end, counts the content length off, and checks block and payload
against the SHA-1 digests that the header gives; it holds one record at a time.
It takes archives of any writer: records of all types, with or without digests
(other algorithms are not checked), each a gzip member of its own; anything
else in a file raises and says where. Files live in the shared folder and are
opened through pyarrow's file systems, so any store that it knows will do.

The writer first finds repeated payloads from (page_id, digest, size) alone.
Up to BROADCAST_ROWS of them are broadcast, and payloads never move. Beyond
that, pages are joined with their marks by page and digest, so payloads move
once, spread evenly however often one of them occurs.

Edge cases: a null payload is an empty one; payloads of any bytes, also empty
ones, take part in revisits from REVISIT_BYTES on; of equal payloads the one
with the largest page_id is the response (all rows of a repeated page_id are);
a null page_id is written as `none`, reads back as null and revisits the rest
of its group, and where all of a group are null, all are responses; very long
payloads are records like others, held one at a time; a cut or damaged file
raises; an empty table gives no archive and no rows; columns of the input with
other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import scratch_path, stored

from .common import arrow

REVISIT_BYTES = 0
#: Repeated payloads that may be broadcast: 50 bytes each.
BROADCAST_ROWS = 100_000
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n") + packer.flush()


def members(pieces: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member of a stream."""
    left, read = b"", 0

    def more() -> bytes:
        nonlocal read
        got = next(pieces, b"")
        read += len(got)
        return got

    def inflate() -> Iterator[bytes]:
        nonlocal left
        packer = zlib.decompressobj(31)
        while not packer.eof:
            raw = packer.unconsumed_tail or left or more()
            if not raw:
                raise ValueError("the file ends within a gzip member")
            left = b""
            try:
                out = packer.decompress(raw, PIECE)
            except zlib.error as e:
                raise ValueError(f"no sound gzip member near byte {read - len(raw)}: {e}") from e
            if out:
                yield out
        left = packer.unused_data

    while True:
        if not left:
            left = more()
        if not left:
            return
        yield inflate()


def agrees(digest: str | None, raw: bytes) -> bool:
    """Whether bytes have the digest that a header gives; one that is absent or of another algorithm is not checked."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == sha1_base32(raw) if len(value) == 32 else value.lower() == hashlib.sha1(raw).hexdigest()


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; raises on a wrong frame or digest."""
    for member in members(pieces):
        held = bytearray()
        for piece in member:
            held += piece
            if b"\r\n\r\n" in held:
                break
        head, found, rest = bytes(held).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError("a record has no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError("a record has no content length")
        length = int(fields["content-length"])
        block = bytearray(rest)
        for piece in member:
            block += piece
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise ValueError(f"a record of {length} bytes holds {len(block) - 4}")
        del block[length:]
        if not agrees(fields.get("warc-block-digest"), bytes(block)):
            raise ValueError("a block does not match its digest")
        yield fields, bytes(block)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What stands after the HTTP header of a response or request; the whole block of other records."""
    if fields.get("warc-type") in ("response", "request", "revisit") and fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each page into archives of the folder: a row (file, records) for each archive."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    with_digest = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload"), F.sha1(raw).alias("_digest"), F.octet_length(raw).alias("_n"))
    # of equal payloads, the first row of the largest page_id is the response; the payload itself stays out of the shuffle
    slim = stored(with_digest.select("page_id", "_digest", "_n"), "digests")
    heads = slim.where(F.col("_n") >= least).groupBy("_digest").agg(F.count("*").alias("_copies"), F.max("page_id").alias("response_id"))
    many = stored(heads.where("_copies > 1 and response_id is not null").select("_digest", "response_id"), "revisited")
    if many.count() <= BROADCAST_ROWS:
        marked = with_digest.join(F.broadcast(many), "_digest", "left")
    else:
        marks = slim.join(many, "_digest").select(F.coalesce("page_id", F.lit(-1)).alias("_page"), F.col("page_id").isNull().alias("_none"), "_digest", "response_id").distinct()
        keyed = with_digest.withColumn("_page", F.coalesce("page_id", F.lit(-1))).withColumn("_none", F.col("page_id").isNull())
        marked = keyed.join(marks, ["_page", "_none", "_digest"], "left")
    rows = marked.select("page_id", "url", "payload", "response_id")
    fs_folder = folder

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(fs_folder)
        fs.create_dir(path, recursive=True)
        name, out, n = uuid.uuid4().hex, None, 0
        for batch in batches:
            for page, url, payload, response in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "response_id")), strict=True):
                page, url, payload, response = page.as_py(), url.as_py(), payload.as_py(), response.as_py()
                digest = sha1_base32(payload)
                revisit = response is not None and response != page
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                block = http if revisit else http + payload
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'none' if page is None else page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{response}>"), ("WARC-Profile", PROFILE)]
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.part", compression=None)
                out.write(record(fields, block))
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{path}/{name}.part", f"{path}/{name}.warc.gz")  # a failed task leaves no archive
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([n], pa.int64())], ["file", "records"])

    # the archives that count are those of the tasks whose rows were stored
    return stored(arrow(rows, put, "file string, records long"), "archives")


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def row_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, full payload's size and digest, type, response's page_id, address and id of a record."""

    def page(name: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest")
    size: int | None = None
    if kind == "revisit":  # the payload lies elsewhere
        size = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
    else:
        payload = payload_of(fields, block)
        size = len(payload)
        if not agrees(digest, payload):
            raise ValueError(f"a payload does not match its digest: {fields.get('warc-record-id')}")
        digest = digest or "sha1:" + sha1_base32(payload)
    return page(fields.get("warc-record-id")), size, digest and digest.partition(":")[2], kind, page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), fields.get("warc-record-id")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """archives: (file). One row for each record of the archives in the folder, of any type."""
    files = archives.select("file").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "file")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in records(iter(lambda: stream.read(PIECE), b"")):
                        rows.append(row_of(fields, block))
                        if len(rows) == 1000:
                            yield table_of(rows)
                            rows = []
                if rows:
                    yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    return arrow(files, get, OUT)


def round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes all pages as archives into the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder)


def oracle(least: int = REVISIT_BYTES) -> str:
    """DuckDB SQL for round_trip(pages), of pages with distinct ids: base32 is spelt out by groups of 20 bits."""
    group = "list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * g, 5) AS BIGINT) >> k) & 31 AS BIGINT) + 1, 1))"
    return f"""
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM page),
named AS (SELECT page_id, n, array_to_string(flatten(list_transform(range(8), lambda g: {group})), '') AS digest FROM hashed),
head AS (SELECT *, CASE WHEN n >= {least} THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS response FROM named)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to FROM head"""
