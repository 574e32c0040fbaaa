"""Operator 1: WARC archives, written and read record by record.

Writing: a task streams its rows into archives of bounded size, one gzip member per record. Archives of a task attempt
that failed are never seen: what counts is the table of archives that Spark has committed. Reading: one archive is read
from front to back by one task, a member is decompressed piece by piece, the content length frames its block, and the
digests are computed anew and compared. Neither holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.shared import written
from fleetlens.session import fresh_path

#: Compressed bytes after which a task begins another archive, and bytes read at once.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: What the record ids of pages begin with, with an id and without one.
PAGE_SPACE, NAMELESS_SPACE = 0x7061676573008000, 0x7061676573018000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(data: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    if page_id is None:
        return f"urn:uuid:{uuid.UUID(int=NAMELESS_SPACE << 64 | uuid.uuid4().int & (1 << 64) - 1)}"
    return f"urn:uuid:{uuid.UUID(int=PAGE_SPACE << 64 | page_id & (1 << 64) - 1)}"


def page_of(name: str | None) -> int | None:
    """The page id in a record id; None for other records."""
    try:
        number = uuid.UUID((name or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if number >> 64 != PAGE_SPACE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP head alone, with the length of the payload it stands for."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + press.flush()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def write_archives(
    pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for every row under `folder`, which all executors must reach; gives (path, records) per archive.

    The payload is the html in UTF-8, empty for a null. Of equal payloads of at least `least` bytes the one with the
    smallest page id is the response and the others revisit it; rows that share that id too are responses all, and
    rows without an id revisit where the payload has a response with one. Repeated rows give repeated records, an empty
    table gives no archive, and columns of other names stay outside.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.length("payload") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    marked = rows.join(repeated, "digest", "left").withColumn("refers_to", F.when(again, F.col("first"))).drop("first")

    def archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        store, base = _place(folder)
        try:
            for batch in batches:
                for id_, link, data, digest, to in zip(
                        batch["page_id"].array, batch["url"], batch["payload"], batch["digest"], batch["refers_to"].array):
                    if out is None:
                        name, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                    own = None if pd.isna(id_) else int(id_)
                    out.write(record(own, link, bytes(data), base32, None if pd.isna(to) else int(to), date))
                    count += 1
                    if out.tell() >= archive_bytes:
                        out.close()
                        out = None
                        yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [count]})
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [count]})

    store, base = _place(folder)
    store.create_dir(base)
    # pandas has no null among plain integers, so ids travel as decimals in text
    marked = marked.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return written(marked.mapInPandas(archived, "path string, records long"), "archives")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archives in a folder of any store that Spark reads; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator over decompressed pieces that must be used up in turn."""
    rest = stream.read(CHUNK)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while True:
                piece = inflate.decompress(rest, CHUNK)
                rest = inflate.unconsumed_tail or inflate.unused_data
                if piece:
                    yield piece
                if inflate.eof:
                    rest = rest or stream.read(CHUNK)
                    return
                if not rest:
                    rest = stream.read(CHUNK)
                    if not rest:
                        raise EOFError("the archive ends inside a record")

        yield pieces()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parsed(pieces: Iterator[bytes], keep: bool = True) -> dict:
    """One record from its member. The block is framed by Content-Length; digests are computed piece by piece."""
    held = b""
    while b"\r\n\r\n" not in held:
        piece = next(pieces, None)
        if piece is None:
            raise EOFError("a record ends inside its head")
        held += piece
    head, _, held = held.partition(b"\r\n\r\n")
    fields = _fields(head)
    left = int(fields.get("content-length", 0))
    block_sum, payload_sum, http, payload = hashlib.sha1(), hashlib.sha1(), b"", []
    in_payload, size = "application/http" not in fields.get("content-type", ""), 0
    while True:
        part, held = held[:left], held[left:]
        left -= len(part)
        block_sum.update(part)
        if not in_payload:
            http += part
            if b"\r\n\r\n" in http:
                http, _, part = http.partition(b"\r\n\r\n")
                in_payload = True
            else:
                part = b""
        payload_sum.update(part)
        size += len(part)
        if keep and part:
            payload.append(part)
        if not left:
            break
        held = next(pieces, None)
        if held is None:
            raise EOFError("a record is shorter than its length says")
    for _ in pieces:
        pass
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields.get("warc-type") == "revisit"
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    sums = [b32(block_sum) == fields["warc-block-digest"].removeprefix("sha1:")] if "warc-block-digest" in fields else []
    if claimed and not revisit:
        sums.append(b32(payload_sum) == claimed)
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"),
        "page_id": page_of(fields.get("warc-record-id")), "refers_to": page_of(fields.get("warc-refers-to")),
        "payload_bytes": int(_fields(http).get("content-length", size)) if revisit else size,
        "payload_digest": claimed or b32(payload_sum), "verified": all(sums) if sums else None,
        "payload": b"".join(payload) if keep and not revisit else None,
    }


FIELDS = (
    "record_type string, record_id string, url string, page_id long, refers_to long, payload_bytes long, "
    "payload_digest string, verified boolean, payload binary")


def read_archives(found: DataFrame, payload: bool = True, at_once: int = 200) -> DataFrame:
    """The records of the archives in `found.path`, in archive order within an archive.

    `verified` is whether the digests that a record states are those of what was read (null if it states none); a
    revisit's payload is null and its length the one it states. A damaged archive ends the job with an error.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, place = _place(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        rows.append(parsed(member, payload))
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) >= at_once or size > 4 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows)

    return found.select("path").repartition(max(1, found.count())).mapInPandas(records, FIELDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, dtype="object").astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "verified": "boolean"})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to new archives in the shared folder and read their records back, without payloads."""
    folder = fresh_path(pages.sparkSession, "llm-warc")
    return read_archives(write_archives(pages, folder, least), payload=False)
