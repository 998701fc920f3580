"""WARC archives: a writer with revisit records, and a reader that salvages damage.

Every record is one gzip member.  Spark's text writer lays the members down, with an
empty member between two of them, so archives are written and read wherever Spark can
write and read.  The reader checks each member (its checksum, version line, length,
end mark and payload digest).  After a failed check it looks for the next place where
a member or a version line begins and all checks hold, goes on from there, and reports
the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.skew import join_statistics

#: fixed values: a gzip member of no bytes, beginnings of members and records, base-32 digits
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BLOCK = 1 << 16


@dataclass(frozen=True)
class WarcParams:
    """Payloads of fewer bytes than ``least_revisit_bytes`` are never revisits."""

    least_revisit_bytes: int = 0
    records_per_file: int = 5000
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               params: WarcParams = WarcParams()) -> DataFrame:
    """page_id, url, payload, digest, and for revisits refers_to: the largest id with an equal payload.

    A null payload is an empty one.  Rows that repeat the largest id are all responses; rows
    without an id revisit a row with one, and are responses where there is none.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("payload_digest", payload_digest(F.col("payload")))
    narrow = rows.select("page_id", "payload_digest")
    stats = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    joined = join_statistics(rows, stats, "payload_digest", "n", pages.count())
    again = (F.octet_length("payload") >= params.least_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(again, F.col("last")).alias("refers_to")
    )


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(p: WarcParams):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], p.date)
                pack = zlib.compressobj(p.level, zlib.DEFLATED, 31)
                out.append(pack.compress(raw) + pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return run


def write_archives(rows: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Archives of the rows of ``with_roles`` in a new folder, one member per record."""
    (
        rows.mapInArrow(_members(params), "member binary").select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", params.records_per_file).text(path)
    )


def _member(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """Contents of the gzip member that begins at a place, where it ends or breaks off, and whether it is sound."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    while not unpack.eof and pos < len(data):
        part, before = data[pos : pos + _BLOCK], unpack.copy()
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            # byte by byte up to the damage
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i : i + 1]))
                    pos += 1
            except zlib.error:
                pass
            return b"".join(out), pos, False
        pos += len(part)
    return b"".join(out), pos - len(unpack.unused_data), unpack.eof


@dataclass(frozen=True)
class Broken:
    """What is wrong with a record, and where it ends if its end mark stands where its length says."""

    why: str
    end: int | None = None


def _parsed(raw: bytes, at: int = 0) -> tuple[dict, bytes, int] | Broken:
    """Headers, block and end of the record that begins at a place, or what is wrong with it."""
    if not raw.startswith(VERSION, at):
        return Broken("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return Broken("no end of headers")
    head = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        return Broken("no content length")
    begin = stop + 4
    end = begin + int(head["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        return Broken("no end of record")
    block = raw[begin:end]
    _, _, payload = block.partition(b"\r\n\r\n")
    want = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "response" and want and want != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        # what looks like a record in there is part of this one's payload
        return Broken("payload digest differs", end + 4)
    return head, block, end + 4


def _records(raw: bytes, sound: bool) -> tuple[list[tuple[dict, bytes]], str]:
    """Records of a member's contents whose checks hold, and what is wrong with the rest.

    In a damaged member the record that the damage reached is not among them.
    """
    found, why, pos = [], "", 0
    while 0 <= pos < len(raw):
        one = _parsed(raw, pos)
        if isinstance(one, Broken):
            why = why or one.why
            pos = raw.find(VERSION, pos + 1) if one.end is None else one.end
        elif not sound and one[2] == len(raw):
            break
        else:
            found.append(one[:2])
            pos = one[2]
    return found, why if sound else "damaged member"


def salvage(content: bytes):
    """Sound records as (start, end, headers, block), and gaps as (start, end, None, reason), in order.

    Sound records of a member that is not sound as a whole come before its gap.
    """
    data, at, gap, why = memoryview(content), 0, None, ""

    def records(at):
        """Records at a place, where they end, what is wrong there, and where the search goes on if not at a mark."""
        if content.startswith(MEMBER, at):
            raw, end, sound = _member(data, at)
            found, wrong = _records(raw, sound)
            return found, end, wrong, end if sound else None
        if content.startswith(VERSION, at):
            one = _parsed(content, at)
            return ([], None, one.why, one.end) if isinstance(one, Broken) else ([one[:2]], one[2], "", one[2])
        return [], None, "no member or version line", None

    while at < len(content):
        found, end, wrong, after = records(at)
        if gap is not None and (found or not wrong):
            yield gap, at, None, why
            gap = None
        for head, block in found:
            yield at, end, head, block
        if wrong and gap is None:
            gap, why = at, wrong
        if after is None:
            nexts = [x for x in (content.find(MEMBER, at + 1), content.find(VERSION, at + 1)) if x >= 0]
            after = min(nexts) if nexts else len(content)
        at = after
    if gap is not None:
        yield gap, len(content), None, why


_OUT = ("archive string, start long, end long, gap_reason string, record_type string, page_id long, url string, "
        "refers_to long, payload_digest string, payload_bytes long, payload binary")


def _page(urn: str | None):
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def _read(with_payload: bool):
    names = [c.split()[0] for c in _OUT.split(", ")]
    schema = pa.schema([
        (n, pa.binary() if n == "payload" else pa.int64() if n in ("start", "end", "page_id", "refers_to", "payload_bytes")
         else pa.string()) for n in names])

    def rows(path, content):
        for start, end, head, block in salvage(content):
            if head is None:
                yield (path, start, end, block, *[None] * 7)
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            kind = head.get("warc-type")
            size = len(payload)
            if kind == "revisit":
                told = re.search(rb"(?i)content-length: *(\d+)", http)
                size = int(told[1]) if told else None
            yield (path, start, end, None, kind, _page(head.get("warc-record-id")), head.get("warc-target-uri"),
                   _page(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:"), size,
                   payload if with_payload and kind != "revisit" else None)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                held = []
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    held.append(row)
                    if len(held) == 1000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all archives of a folder.

    A gap has ``gap_reason`` and its bytes' start and end, and no other value.  An empty
    archive has neither.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), _OUT)
