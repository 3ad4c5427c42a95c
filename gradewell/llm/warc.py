"""WARC archives written by Spark's own text writer and read by a salvaging reader.

Writing: of records with equal payloads the one with the smallest page_id is
the response and the others are revisits of it. Every record is a gzip member of its own, as the format asks, so that damage costs the records it
hits. Tasks compress their records and number their files by bytes; Spark's text writer puts the members into files, on any file system
that Spark can write to. Its line separator is a member without content, which adds nothing to what is inflated. Files hold FILE_BYTES of
payload at most, unless one payload is longer.

Reading: archives are read by Spark's binaryFile source, one row a file, and
parsed inside tasks, a member at a time. A record whose header, length or digest fails its check is
not trusted: the reader searches for the next version line or gzip member that
parses, anywhere in the file, resumes there, and logs the bytes between as quarantined. Archives of other writers may have members of many
records: of a damaged one those before the damage are kept, and the gap that is logged is the whole member. A file of more than 2 GB is
beyond that source.

Edge cases: a null html is an empty payload, like an empty one; rows with equal
page_id are kept, and all of them are the response if theirs is the smallest; a row of a null page_id comes after all others: it revisits an
equal payload of one that has an id and else is a response; a null url is
written as an empty target; an empty table gives no records; extra columns are ignored. Only
digests and ids move in the shuffles that find first copies, a payload of many copies is dealt over tasks there, and pages then meet the
list of revisits by id.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._store import fresh_path, spread_join, store, table

END = "\r\n\r\n"
VERSION = b"WARC/1.0\r\n"
#: Types of records, and fields that a header has once.
TYPES = (b"warcinfo", b"response", b"resource", b"request", b"metadata", b"revisit", b"conversion", b"continuation")
ONCE = (b"warc-type", b"warc-record-id", b"content-length", b"warc-date")
MAGIC = b"\x1f\x8b\x08"
NO_ID = "none"
FILE_BYTES = 64 << 20
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()  # a member without content
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "kind string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, file string, start long, end long, reason string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: eight groups of five hexadecimal digits give four letters each."""
    digest = F.sha1(payload)
    parts = []
    for g in range(8):
        n = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _id(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NO_ID))


def revisits(pages: DataFrame) -> DataFrame:
    """id, sha1, first_id of each page whose payload one of a smaller page_id has."""
    slim = pages.select("page_id", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("sha1"))
    copies = slim.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    copies = store(copies, "copies")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = spread_join(slim, copies, "sha1", "page_id", "n", total)
    return store(own.where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(_id("page_id").alias("id"), "sha1", "first_id").distinct(), "revisits")


def with_first_copy(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """page_id, url, payload, first_id: null for a response."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), _id("page_id").alias("id"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    return rows.join(copies, ["id", "sha1"], "left")


def records(pages: DataFrame, copies: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """value, each page as a WARC record, and size, the bytes of its payload in the archive."""
    rows = with_first_copy(pages, copies)
    payload = F.col("payload").cast("binary")
    digest = base32_sha1(payload)
    size = F.octet_length("payload")
    revisit = F.col("first_id").isNotNull() & (size >= min_bytes)
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        uri(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\r\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        digest,
        F.lit("\r\nX-Payload-Length: "),
        size.cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                uri(F.col("first_id")),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
        F.lit(END),
    )
    return rows.select(head.cast("binary").alias("value"), F.octet_length(body).cast("long").alias("size"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives under path, of at most file_bytes payload bytes each unless one payload alone is longer, in one pass over the pages."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for b in batches:
            numbers, members = [], []
            for value, size in zip(b.column("value"), b.column("size").to_pylist(), strict=True):
                if held and held + size > file_bytes:
                    number, held = number + 1, 0
                held += size
                numbers.append(number)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(z.compress(value.as_buffer()) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(members, pa.binary())], names=["file", "member"])

    members = records(pages, revisits(pages), min_bytes).mapInArrow(compress, "file int, member binary")
    # bytes pass through the writer as they are; the separator is given in an encoding that has all bytes
    members.select("file", F.col("member").cast("string")).write.mode("append").partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def _field(lines: dict[bytes, bytes], name: bytes) -> bytes:
    return lines.get(name, b"")


def _parse(data: bytes | memoryview, at: int) -> tuple[dict, int] | str:
    """The record that starts at a version line and its end, or why it cannot be trusted."""
    if data[at : at + len(VERSION)] != VERSION:
        return "no version line"
    fields, pos = {}, at + len(VERSION)
    # line by line up to the first that is none of a header, so a search over many version lines stays linear
    while (stop := data.find(b"\r\n", pos)) != pos:
        if stop < 0:
            return "header without end"
        name, colon, value = data[pos:stop].partition(b":")
        name = name.strip().lower()
        if not colon or b"WARC/1." in name or b"WARC/1." in value or name in fields and name in ONCE:
            return "malformed header line"
        fields[name] = value.strip()
        pos = stop + 2
    kind, length = _field(fields, b"warc-type"), _field(fields, b"content-length")
    if kind not in TYPES or not length.isdigit():
        return "no type or length"
    body, end = stop + 2, stop + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    payload = data[body:end]
    digest = _field(fields, b"warc-payload-digest").removeprefix(b"sha1:")
    if kind == b"response" and digest and base64.b32encode(hashlib.sha1(payload).digest()) != digest:
        return "wrong digest"
    ids = [_field(fields, k).removeprefix(b"<urn:page:").removesuffix(b">") for k in (b"warc-record-id", b"warc-refers-to")]
    if ids[0] != NO_ID.encode() and not ids[0].lstrip(b"-").isdigit():
        return "no record id"
    size = _field(fields, b"x-payload-length")
    return {
        "kind": kind.decode("ascii", "replace"),
        "page_id": None if ids[0] == NO_ID.encode() else int(ids[0]),
        "refers_to": int(ids[1]) if ids[1] else None,
        "url": _field(fields, b"warc-target-uri").decode("utf-8", "replace"),
        "payload_bytes": len(payload) if kind == b"response" else int(size) if size.isdigit() else None,
        "payload_digest": digest.decode("ascii", "replace"),
        "payload": payload,
    }, end + 4


def _sound(data: bytes, at: int) -> bool:
    return not isinstance(_parse(data, at), str)


def _opens_archive(data: bytes, at: int) -> bool:
    """Whether a gzip member that begins here begins with a version line, or is the one that parts members."""
    if data.startswith(EMPTY, at):
        return True
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + (1 << 12)], len(VERSION)) == VERSION
    except zlib.error:
        return False


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What inflates from here, and the member's end if it is sound."""
    z, parts = zlib.decompressobj(31), []
    for i in range(at, len(data), 1 << 16):
        try:
            parts.append(z.decompress(memoryview(data)[i : i + (1 << 16)]))
        except zlib.error:
            break
        if z.eof:
            return b"".join(parts), min(i + (1 << 16), len(data)) - len(z.unused_data)
    return b"".join(parts), None


def _next(data: bytes, at: int, members: bool) -> int:
    """Where the next sound record or member begins; the end if none does."""
    line, member = data.find(VERSION, at), data.find(MAGIC, at) if members else -1
    while line >= 0 or member >= 0:
        if member < 0 or 0 <= line < member:
            if _sound(data, line):
                return line
            line = data.find(VERSION, line + 1)
        else:
            if _opens_archive(data, member):
                return member
            member = data.find(MAGIC, member + 1)
    return len(data)


def salvage(data: bytes, members: bool = True) -> Iterator[dict]:
    """All sound records of an archive's bytes, plain or in gzip members of one record or many, in any order, and its gaps.

    Of a damaged member the records before the damage are kept.
    """
    at = 0
    while at < len(data):
        kept: list[dict] = []
        if members and data.startswith(MAGIC, at):
            out, end = _inflate(data, at)
            if end is not None:
                for row in salvage(out, members=False):
                    yield row | {"start": at, "end": end}
                at = end
                continue
            kept, reason = [r for r in salvage(out, members=False) if r["kind"] != "gap"], "member does not inflate"
        else:
            found = _parse(data, at)
            if not isinstance(found, str):
                yield found[0] | {"start": at, "end": found[1], "reason": None}
                at = found[1]
                continue
            reason = found
        # a failed check: no field of this record is trusted
        resume = _next(data, at + 1, members)
        for row in kept:
            yield row | {"start": at, "end": resume}
        yield {"kind": "gap", "start": at, "end": resume, "reason": reason}
        at = resume


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind gap, with start, end and reason) of all archives under path."""
    names = [c.strip().split(" ")[0] for c in RECORD.split(",")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for row in salvage(bytes(content)):
                    held += len(row.get("payload") or b"") if payloads else 64
                    rows.append({"file": file} | row | ({} if payloads else {"payload": None}))
                    if held > 8 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, RECORD)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to", "payload_bytes", "start", "end"):
        out[c] = out[c].astype("Int64")
    return out.astype({c: object for c in ("kind", "url", "payload_digest", "payload", "file", "reason")}).where(lambda x: x.notna(), None)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    # payload sizes and digests of revisits come from their header, which the writer took from the full payload;
    # a gap in what was just written is a lost page, so the query fails
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in "), F.col("file"))).cast("boolean")
    return (
        read(spark, path, payloads=False)
        .where(F.when(F.col("kind") == "gap", lost).otherwise(F.col("kind").isin("response", "revisit")))
        .select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    )
