"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Each record is a gzip member of its own. The reader checks every record (member CRC, version line,
length, trailing blank lines, block digest). Where a check fails it searches on for the next version
line, inside a member too (also inside one that is cut short or fails its CRC, whose records then need
a block digest that holds), and for the next member; it recovers what follows, and logs the bytes
between as quarantined gaps.

Edge cases: null html is an empty payload; a null page_id is written as the id `null` and stands
after all others; payloads under 100 bytes are always responses; of rows that share a page_id and a
payload the one with the least url is the response (a null url is the least) and the others revisit it;
very long payloads are written whole, and an archive of up to 2 GB can be read back; a null url is left
out, and control characters in a url are percent-encoded; an empty table gives no archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import _blobs
from lamina.llm._common import released, written

VERSION = b"WARC/1.1\r\n"
ID = "urn:lamina:page:"
LEAST_REVISIT = 100
_START = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_URI_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_MEMBER = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes of a member that are inflated at once.
_STEP = 1 << 16


def _b32(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record(kind: str, record_id: str, payload: bytes, digest: str, uri: str | None = None, refers_to: str | None = None) -> bytes:
    """One record, not compressed. A revisit keeps the payload's digest and length, not the payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        head.append(("WARC-Target-URI", _URI_CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("WARC-Block-Digest", _b32(block)), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Salvaged:
    """What a damaged archive still holds: records as (offset, headers, block), gaps as (start, end, inner start, inner end).

    A record's offset is that of its member. A gap is a range of the archive's bytes; one inside a
    member that was inflated also has the range of the inflated bytes.
    """

    records: list = field(default_factory=list)
    gaps: list = field(default_factory=list)


def _parse(data: bytes, at: int = 0, need_digest: bool = False):
    """(headers, block, end) of the valid record at `at`, else None."""
    if not _START.match(data, at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or _CONTROL.search(data, at, stop):
        return None
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        head[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    start, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[start:end]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest != _b32(block) or need_digest and not digest.startswith("sha256:"):
        return None
    return head, block, end + 4


def _inflate(data: bytes, at: int, most: int | None) -> tuple[bytes, int, bool]:
    """What the gzip member at `at` inflates to, as far as it goes, its end, and whether it is whole and its CRC holds."""
    view, d, out, size, p = memoryview(data), zlib.decompressobj(31), [], 0, at
    while p < len(data) and not d.eof and (most is None or size <= most):
        part = view[p : p + _STEP]
        try:
            out.append(d.decompress(part))
        except zlib.error:
            return b"".join([*out, *_up_to_fault(view[at:p], part)]), p, False
        size += len(out[-1])
        p += len(part) - len(d.unused_data)
    return b"".join(out), p, d.eof


def _up_to_fault(before: memoryview, part: memoryview) -> Iterator[bytes]:
    """What a part still inflates to, byte by byte, until the fault in it."""
    d = zlib.decompressobj(31)
    d.decompress(before)
    try:
        for i in range(len(part)):
            yield d.decompress(part[i : i + 1])
    except zlib.error:
        return


def _records(data: bytes, at: int, end: int, need_digest: bool = False) -> tuple[list, list]:
    """[(offset, headers, block)] of the valid records in data[at:end], and the ranges between them."""
    found, gaps, bad = [], [], None
    while at < end:
        if one := _parse(data, at, need_digest):
            if bad is not None:
                gaps.append((bad, at))
                bad = None
            found.append((at, *one[:2]))
            at = one[2]
        else:
            bad = at if bad is None else bad
            m = _START.search(data, at + 1)
            at = m.start() if m else end
    if bad is not None:
        gaps.append((bad, end))
    return found, gaps


def _next_start(data: bytes, at: int) -> int:
    a = data.find(_MEMBER, at)
    m = _START.search(data, at)
    return min((x for x in (a, m.start() if m else -1) if x >= 0), default=len(data))


def salvage(data: bytes, most_inflated: int | None = None) -> Salvaged:
    """Every valid record of an archive, in order, and the byte ranges that hold none.

    most_inflated: bytes beyond which a member of a foreign archive is no longer inflated, but taken as damaged.
    """
    out, at, bad = Salvaged(), 0, None
    known, until = [], 0  # what came out of a damaged member may stand in its bytes as it is
    while at < len(data):
        found, inner, end = [], [], None
        if data.startswith(_MEMBER, at):
            inflated, stop, whole = _inflate(data, at, most_inflated)
            found, inner = _records(inflated, 0, len(inflated), not whole)
            end = stop if whole else None
            if found and not whole:
                known, until = [x[1:] for x in found], stop + _STEP
        elif one := _parse(data, at):
            end = one[2]
            if at < until and one[:2] in known:
                known.remove(one[:2])
            else:
                found = [(at, *one[:2])]
        out.records += [(at, *x[1:]) for x in found]
        if found and end is not None:
            if bad is not None:
                out.gaps.append((bad, at, None, None))
                bad = None
            out.gaps += [(at, end, a, b) for a, b in inner]
        elif bad is None:
            bad = at
        at = _next_start(data, at + 1) if end is None else end
    if bad is not None:
        out.gaps.append((bad, len(data), None, None))
    return out


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
    buf, size, first = [], 0, None
    name = lambda x: f"{ID}{'null' if x is None else x}"
    for b in batches:
        for page, url, html, digest, revisits, target in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            m = member(record("revisit" if revisits else "response", name(page), html.encode(), digest, url, name(target) if revisits else None))
            first = page if first is None else first
            buf.append(m)
            size += len(m)
            if size >= _blobs.FILE_BYTES:
                yield b"".join(buf), first or 0, len(buf)
                buf, size, first = [], 0, None
    if buf:
        yield b"".join(buf), first or 0, len(buf)


def write_archives(pages: DataFrame) -> str:
    """Writes a record for each page and returns the folder of the archives.

    Only (page_id, digest) is grouped, with partial sums before the shuffle, so a payload shared by a
    third of the pages is no hot key; html itself stays where it was read unless the pages with
    earlier copies are too many to broadcast.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = long.groupBy("page_id", "digest").agg(F.count("*").alias("times")).join(first, "digest")
    # rows that share a page_id and a payload, of which one is the response
    alike = released(copies.filter(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("times") > 1)).select("page_id", "digest"), "warc-alike")
    later = copies.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    same = lambda p, d: F.col("page_id").eqNullSafe(F.col(p)) & (F.col("digest") == F.col(d))
    out = rows.join(later, same("_p", "_d"), "left").select("page_id", "url", "html", "digest", F.col("_d").isNotNull().alias("revisits"), "first")
    if not alike.isEmpty():
        of = alike.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"))
        some = rows.join(of, same("_p", "_d"), "left_semi")
        # equal rows are counted before they travel
        urls = some.groupBy("page_id", "digest", "url").agg(F.count("*").alias("times"), F.any_value("html").alias("html"))
        least = urls.groupBy("page_id", "digest").agg(F.min(F.struct(F.col("url").isNotNull().alias("some"), "url")).alias("least"))
        urls = urls.join(least.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "least"), same("_p", "_d"))
        is_first = F.col("url").eqNullSafe(F.col("least.url"))
        nth = urls.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        again = nth.select("page_id", "url", "html", "digest", (~is_first | (F.col("_k") > 1)).alias("revisits"), F.col("page_id").alias("first"))
        out = out.join(of, same("_p", "_d"), "left_anti").unionByName(again)
    return _blobs.write_blobs(out, _archives, "warc", ".warc.gz")


_RECORD = (("page_id", "long"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"), ("url", "string"), ("archive", "string"), ("offset", "long"), ("payload", "binary"))
_GAP = (("start", "long"), ("end", "long"), ("inner_start", "long"), ("inner_end", "long"))
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def salvaged(spark, path: str, most_inflated: int | None = None) -> DataFrame:
    """A row for each record and each gap of the archives in a folder, from one reading of them.

    Of a record: page_id, record_type, payload_bytes, payload_digest, refers_to, url, archive, offset,
    payload (null for a revisit). Of a gap: archive, start, end, inner_start, inner_end.
    """
    columns = _RECORD + _GAP

    def of(x: str) -> int | None:
        x = x.strip("<>").removeprefix(ID)
        return int(x) if re.fullmatch(r"-?\d{1,19}", x) else None

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], _TYPES[t]) for k, t in columns})

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                name, got, rows, size = name.as_py(), salvage(data.as_py(), most_inflated), [], 0
                for at, head, block in got.records:
                    kind = head.get("warc-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest()
                    length = head.get("x-payload-length", "0")
                    rows.append({"page_id": of(head.get("warc-record-id", "")), "record_type": kind, "payload_bytes": (int(length) if length.isdigit() else 0) if payload is None else len(payload), "payload_digest": digest, "refers_to": of(head.get("warc-refers-to", "")), "url": head.get("warc-target-uri"), "archive": name, "offset": at, "payload": payload})
                    size += len(payload or b"")
                    if size > _blobs.FILE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                rows += [{"archive": name} | dict(zip((k for k, _ in _GAP), g, strict=True)) for g in got.gaps]
                yield batch(rows)

    return _blobs.read_blobs(spark, path, ".warc.gz").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in columns))


def read_archives(spark, path: str, most_inflated: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives in a folder, as `salvaged` has them."""
    rows = salvaged(spark, path, most_inflated)
    return rows.filter("start is null").select(*[k for k, _ in _RECORD]), rows.filter("start is not null").select("archive", *[k for k, _ in _GAP])


def round_trip(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the pages and reads the archives back, once: records without payloads, and the gap log, both from one written table."""
    spark = pages.sparkSession
    rows = written(salvaged(spark, write_archives(pages)).drop("payload"), "warc-read")
    return rows.filter("start is null").drop(*[k for k, _ in _GAP]), rows.filter("start is not null").select("archive", *[k for k, _ in _GAP])
