"""WARC archives: a distributed writer, and a reader that salvages damaged files.

Writing: each record is a gzip member of its own. Spark's text writer puts the members
into part files on whatever file system the path names; its line separator is an empty
gzip member, so a part file is a valid multi-member gzip stream whose content is exactly
the records.

Reading: members are taken one after the other and checked (gzip CRC, version line,
Content-Length, payload digest). Where a check fails the reader looks for the next gzip
magic or ``WARC/`` version line that begins a valid record, goes on there, and reports
the bytes in between as a quarantined gap. Inside a member that holds several records it
looks for the next version line in the decompressed bytes, also in those that come out
of a member before its damage.

Defined cases: a null payload is the empty payload; of records with equal payloads the
one with the largest id is the response and the others revisit it (null ids count as
smallest; rows that repeat both id and payload are all responses, or all revisits);
payloads below ``min_bytes`` are all responses; an empty table writes an archive without
records; other input columns play no part.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches, join_aggregate

#: An empty gzip member (a fixed value).
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
RECORDS = "file string, at long, n_bytes long, warc_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap string"
URN = "<urn:presswork:page:%s>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers: int | None) -> bytes:
    """One uncompressed record. A revisit holds no payload but keeps its digest and length."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {URN % ('null' if page_id is None else page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {URN % refers}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page_id, url, html, top, n in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "top", "n_bytes")), strict=True):
            digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
            kind = "response" if top is None or page_id == top else "revisit"
            out.append(member(record(kind, page_id, url, html, digest, n, top if kind == "revisit" else None)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n_bytes, top): ``top`` is the id that holds the payload.

    The largest id per digest is found by a partial aggregate on digests alone; pages
    then join it, a join whose hot digests the engine can split.
    """
    p = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.unhex(F.sha1("payload"))})
    small = F.col("n_bytes") < min_bytes
    top = p.where(~small).groupBy("digest").agg(F.max("page_id").alias("top"))
    joined = join_aggregate(p, top, "digest", how="left")
    return joined.select("page_id", "url", "payload", "n_bytes", F.when(~small, F.col("top")).alias("top"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``."""
    bounded_batches(pages.sparkSession)
    made = with_originals(pages, min_bytes).mapInArrow(_members, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).option("maxRecordsPerFile", 20_000).text(path)


def _header(block: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Header fields of the record at ``start`` and where its body begins; ValueError if it is no record."""
    end = block.find(b"\r\n\r\n", start) if block.startswith(VERSION, start) else -1
    if end < 0:
        raise ValueError("no version line or header end")
    fields: dict[str, str] = {}
    for line in block[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    return fields, end + 4


def _page(value: str | None) -> int | None:
    m = re.search(r":page:(-?\d+)>$", value or "")
    return int(m[1]) if m else None


def parse(block: bytes, start: int = 0) -> tuple[dict, int]:
    """The record of ``block`` at ``start``, checked, and its length in bytes."""
    fields, at = _header(block, start)
    n = int(fields["content-length"])
    body, tail = block[at : at + n], block[at + n : at + n + 4]
    if len(body) != n or tail != b"\r\n\r\n":
        raise ValueError("length does not match")
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError("payload digest does not match")
    full = fields.get("x-payload-length", str(n))
    return {
        "warc_type": kind, "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": int(full) if full.isdigit() else n,
        "payload_digest": digest or None, "refers_to": _page(fields.get("warc-refers-to")), "payload": body,
    }, at + n + 4 - start


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` holds, its size, and "" or why it ended early.

    Of a damaged member the size is 0 and the bytes are those before the damage.
    """
    z = zlib.decompressobj(31)
    # Pieces, so that no copy of the rest of a large file is made per member.
    plain, k, end = io.BytesIO(), at, len(data)
    try:
        while not z.eof and k < end:
            plain.write(z.decompress(data[k : k + 65536]))
            k += 65536
    except zlib.error as e:
        # Once more up to the failing piece, and that byte by byte.
        z = zlib.decompressobj(31)
        for i in range(at, k, 65536):
            z.decompress(data[i : i + 65536])
        with contextlib.suppress(zlib.error):
            for i in range(k, min(k + 65536, end)):
                plain.write(z.decompress(data[i : i + 1]))
        return plain.getvalue(), 0, str(e)
    if not z.eof:
        return plain.getvalue(), 0, "member is cut off"
    return plain.getvalue(), min(k, end) - len(z.unused_data) - at, ""


def _parsed(block: bytes) -> Iterator[dict | str]:
    """Records of decompressed bytes, and for each stretch that holds none why it is bad."""
    inner, bad = 0, False
    while inner < len(block):
        try:
            got, n = parse(block, inner)
        except ValueError as e:
            if not bad:
                yield str(e)
            bad = True
            inner = block.find(VERSION, inner + 1)
            if inner < 0:
                return
            continue
        bad = False
        yield got
        inner += n


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive and the gaps between them, in file order.

    A record found after a failed check must pass every check itself. The bytes from
    the first failure to that record form one gap. An uncompressed record ends where
    its length says. A member may hold several records: each that passes is kept, also
    from a member that is damaged or cut off, as far as it could be decompressed. A gap
    inside an intact member has the member's offset and no bytes of its own; one at
    the end of a damaged member goes from the member's offset to the next record.
    """
    at, bad, why, end = 0, -1, "", len(data)
    #: Where each mark stands next, so that no stretch is searched twice.
    marks = {MAGIC: -1, VERSION: -1}
    while at < end:
        found: list[dict | str] = []
        size, failed = 0, ""
        if data.startswith(MAGIC, at):
            block, size, failed = _inflated(data, at)
            found = list(_parsed(block))
        elif data.startswith(VERSION, at):
            try:
                head = data.find(b"\r\n\r\n", at)
                n = int(_header(data[at : head + 4])[0]["content-length"]) if head >= 0 else 0
                got, size = parse(data[at : head + 8 + n])
                found = [got]
            except ValueError as e:
                failed = str(e)
        else:
            failed = "neither a member nor a version line"
        whole = any(not isinstance(x, str) for x in found)
        if failed and found and isinstance(found[-1], str):
            found.pop()  # the record that the damage cut off is part of the gap of the member
        if size and not whole and found:  # nothing in the member passed
            failed, found, size = found[0], [], 0
        if bad >= 0 and (whole or size == 20):
            yield {"at": bad, "n_bytes": at - bad, "gap": why}
            bad = -1
        for got in found:
            if isinstance(got, str):
                if whole:
                    yield {"at": at, "n_bytes": 0, "gap": got}
            else:
                yield got | {"at": at, "n_bytes": size, "gap": None}
        if not failed:
            at += size
            continue
        if bad < 0:
            bad, why = at, failed
        for mark, there in marks.items():
            if there <= at:
                found_at = data.find(mark, at + 1)
                marks[mark] = found_at if found_at >= 0 else end
        at = min(marks.values())
    if bad >= 0:
        yield {"at": bad, "n_bytes": end - bad, "gap": why}


_FIELDS = ("at", "n_bytes", "warc_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload", "gap")
_ARROW = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap", pa.string()),
])


def _read(payload: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows: list[dict] = []
                held = 0
                for got in salvage(content.as_py()):
                    held += got["n_bytes"]
                    rows.append({"file": path.as_py()} | {k: got.get(k) for k in _FIELDS} | ({} if payload else {"payload": None}))
                    if len(rows) >= 1000 or held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return of


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record and one per quarantined gap (``gap`` says why; else null).

    A gap of a file is logged with its offset and length; ``where("gap is null")`` gives
    the records. ``payload=False`` checks payloads but does not return them.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read(payload), RECORDS)
