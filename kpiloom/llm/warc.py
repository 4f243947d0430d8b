"""WARC archives: one gzip member per record, and a reader that can split inside a file.

A reading task owns a byte range of one file: it looks for the gzip magic, tries
each candidate by decoding the beginning of the member and its header, and yields
the records that start inside its range, reading past the end for the last one.
Records of a file lie one after the other: a task checks that each begins where the one
before ends, and that another record or the file's end follows its last one, so a record
that does not decode is an error and never skipped.
Files are reached through pyarrow's file systems (file, hdfs, s3, gs), by the URI
of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import fresh_path, ship_package
from kpiloom.sources.extracts import written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: How records of any version of the format begin.
BEGINNING = b"WARC/"


@dataclass(frozen=True)
class WarcParams:
    """Records with payloads of ``least`` bytes or more are revisits of an equal one.

    ``file_bytes`` ends an archive file, ``split`` is the range of one reading task. ``date``
    is the records' date, by default that of the writing. ``strict`` raises where bytes of
    a file belong to no record.
    """

    least: int = 0
    file_bytes: int = 64 << 20
    split: int = 4 << 20
    date: str | None = None
    strict: bool = True


def _open(uri: str):
    from pyarrow.fs import FileSystem

    if "://" in uri or uri.startswith("file:"):
        head = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
        return FileSystem.from_uri(head)
    return FileSystem.from_uri(f"file://{uri}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes,
    date: str = "1970-01-01T00:00:00Z", record_id: str | None = None,
) -> bytes:
    """One WARC record as a gzip member. Header values have control characters percent-encoded.

    Every record has an id of its own; page ids, which may repeat, are in fields beside it.
    """
    clean = "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id or uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(payload)}")
    body = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def plan_records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Append record_type, refers_to, payload (binary) and payload_sha to pages.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response.
    A null html is an empty payload; a null page_id is a response of its own only if
    no other record has its payload; rows that repeat a page_id with the same
    payload are all responses.
    """
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", body.alias("payload"), sha.alias("payload_sha"))
    last = (
        pages.select("page_id", sha.alias("payload_sha"))
        .groupBy("payload_sha")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    # most payloads are alone: only the shared ones meet the table of winners
    revisit = (F.octet_length("payload") >= params.least) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return base.join(last, "payload_sha", "left").select(
        "page_id", "url", "payload", "payload_sha",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write all pages below ``folder`` and return the table of files (path, bytes, records).

    The table is written through Spark's committer and names only files of finished
    attempts; what a lost or repeated task left behind is never read.
    """
    spark = pages.sparkSession
    ship_package(spark)
    limit = params.file_bytes
    date = params.date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())],
                ["path", "bytes", "records"],
            )

        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                page_id, url, payload, sha, kind, refers = (c[k].as_py() for c in columns)
                if out is None:
                    name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                body = payload if kind == "response" else b""
                # the file's name is its own, so a number within it makes an id of its own
                own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{count}")
                member = record(page_id, url, kind, digest, len(payload), refers, body, date, str(own))
                out.write(member)
                size += len(member)
                count += 1
                if size >= limit:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    files = plan_records(pages, params).mapInArrow(run, "path string, bytes long, records long")
    return written(spark, "warc-files", files)


class _Tail:
    """Bytes of a file from ``at`` on, read in steps."""

    def __init__(self, source, at: int, step: int = 1 << 16):
        self.source, self.at, self.step = source, at, step

    def read(self) -> bytes:
        self.source.seek(self.at)
        data = self.source.read(self.step)
        self.at += len(data)
        return data


def _member(source, at: int) -> tuple[bytes, int] | None:
    """The record of the member at ``at`` and where it ends; None if there is none.

    A candidate is dropped as soon as it does not decode, or decodes to something
    that does not begin like a record.
    """
    tail, packer, parts, seen = _Tail(source, at), zlib.decompressobj(31), [], 0
    while not packer.eof:
        data = tail.read()
        if not data:
            return None
        try:
            part = packer.decompress(data)
        except zlib.error:
            return None
        parts.append(part)
        seen += len(part)
        if seen >= len(BEGINNING) and len(parts) <= 2 and not b"".join(parts).startswith(BEGINNING):
            return None
    return b"".join(parts), tail.at - len(packer.unused_data)


def _begins(source, at: int) -> bool:
    """Whether a member that begins like a record starts at ``at``."""
    source.seek(at)
    packer, seen = zlib.decompressobj(31), b""
    while len(seen) < len(BEGINNING) and not packer.eof:
        data = source.read(1 << 12)
        if not data:
            return False
        try:
            seen += packer.decompress(data, 1 << 10)
        except zlib.error:
            return False
    return seen.startswith(BEGINNING)


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            name = name.lower()
            out[name] = value
    return out


def records_in(source, start: int, end: int, step: int = 1 << 20, size: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header by lower-cased name, block) of the records that start in [start, end) of an open file.

    With the file's ``size``, bytes that belong to no record raise: before the first
    record of the file, between two records, and between the range's last record and
    what follows it, which must be another record or the file's end. As every range
    checks what follows its own records, nothing between two ranges goes unseen.
    """
    at, window, base = start, b"", start
    ended = 0 if start == 0 else None
    while at < end:
        if at < base or at + len(MAGIC) > base + len(window):
            source.seek(at)
            window, base = source.read(min(step, end - at) + len(MAGIC) - 1), at
        hit = window.find(MAGIC, at - base)
        if hit < 0 or base + hit >= end:
            at = max(at + 1, base + len(window) - len(MAGIC) + 1)
            if len(window) < len(MAGIC):
                break
            continue
        at = base + hit
        found = _member(source, at)
        head, gap, rest = (found[0] if found else b"").partition(b"\r\n\r\n")
        header = fields_of(head) if found and gap else {}
        if not header.get("content-length", "").isdigit():
            if size is not None and _begins(source, at):
                raise ValueError(f"the record at {at} does not decode")
            at += 1
            continue
        if size is not None and ended is not None and at != ended:
            raise ValueError(f"bytes {ended} to {at} hold no record")
        length = int(header["content-length"])
        if size is not None and len(rest) < length:
            raise ValueError(f"the record at {at} is shorter than it says")
        yield at, header, rest[:length]
        at = ended = found[1]
    if size is not None and ended is not None and ended < size and not (ended > start and _begins(source, ended)):
        raise ValueError(f"no record follows at {ended} of {size} bytes")


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """A record's payload: its block, without the protocol's header where it holds one."""
    if header.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read(spark: SparkSession, files: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """All records of the files (path, bytes): path, offset, page_id, url, record_type,
    refers_to, payload_digest, payload_bytes, payload (null unless a response or resource).

    Every range of ``split`` bytes is a task's own piece of work, whatever the file.
    Bytes that belong to no record raise (``strict``), as does a payload that does not
    have its SHA-1 digest, but for protocol messages, whose digests may be of what they
    encode. Archives of others are read too: any version and letter case, any record
    type, page ids null, a missing digest computed. A task holds one record at a time,
    whole, and up to 8 MB of finished ones.
    """
    ship_package(spark)
    split, strict = params.split, params.strict

    def number(value: str | None) -> int | None:
        return int(value) if value and value.lstrip("-").isdigit() else None

    def row_of(path: str, offset: int, header: dict[str, str], block: bytes) -> tuple:
        kind = header.get("warc-type", "").lower()
        payload = payload_of(header, block)
        named, _, digest = header.get("warc-payload-digest", "").partition(":")
        told = digest.upper() if named.lower() == "sha1" else None
        held = kind in ("response", "resource")
        if held and told and block is payload and digest_of(payload) != told:
            raise ValueError(f"payload and digest differ: {path} at {offset}")
        size = number(header.get("warc-payload-length"))
        return (
            path, offset, number(header.get("warc-page-id")), header.get("warc-target-uri"), kind,
            number(header.get("warc-refers-to-page-id")) if kind == "revisit" else None,
            told or (digest_of(payload) if held else None), len(payload) if held or size is None else size,
            payload if held else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _open(path)
                rows, held = [], 0
                with fs.open_input_file(place) as source:
                    size = source.size() if strict else None
                    for offset, header, block in records_in(source, start, start + split, size=size):
                        rows.append(row_of(path, offset, header, block))
                        held += len(block)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # one partition for each range; a count that is given is not merged again at run time
    parts = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = files.where(F.col("bytes") > 0).select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")
    )
    dealt = ranges.repartition(int(parts), "path", "start")
    return dealt.mapInArrow(
        run,
        "path string, offset long, page_id long, url string, record_type string, refers_to long,"
        " payload_digest string, payload_bytes long, payload binary",
    )


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    spark = pages.sparkSession
    files = write(pages, fresh_path(spark, "warc"), params)
    return read(spark, files, params)
