"""Operator 3: WARC archives, written and read back by a salvage reader.

The writer makes one gzip member a record; Spark's text sink puts the members
into files on any file system Spark knows, with an empty member as the line
separator, so that each file is a plain multi-member .warc.gz.  Payloads are
deduplicated by digest: the smallest page id of equal payloads is the response,
others are revisit records that hold no payload.

The reader takes members (or bare records) one after another.  Where a check
fails - the member's CRC, the version line, the length, a digest - it logs the
bytes up to the next valid member or version line as a gap and goes on there.
Gaps inside a sound member have their place in the member's content (`inner`).
A member is inflated slice by slice and the next line or member is searched once,
so reading takes time in proportion to the archive.

Defined cases: a null html is an empty payload; a null url is left out; of equal
payloads, rows with the smallest id are all responses (repeated rows), null ids
are revisits of it, or all responses if no id is set; an empty table gives an
empty result; pages of any size are written, a large one closes its archive.  A
record is held whole in memory, an archive too; archives are closed at
`archive_bytes` of payload, counted page by page, and the page that reaches it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_rows, materialise, new_path, share_join, utf8

#: A whole gzip member of no bytes.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PAD = re.compile(rb"[\r\n\0]+")
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base32(hashlib.sha1(payload).digest())
    if not revisit:
        block += payload
    uri = re.sub(r"[\r\n]+", " ", url) if url else None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{digest}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>" if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + utf8(head) + b"\r\n" + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record, or a gap if `gap` says why its bytes were put aside; `inner` is the place in a member's content."""

    offset: int
    length: int
    gap: str | None
    fields: dict[str, str]
    block: bytes
    inner: int | None = None


def parse(data: bytes, at: int, end: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at a version line: its end, fields and block; or what is wrong."""
    if not VERSION.match(data, at, end):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, end)
    if stop < 0:
        return "unfinished header"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return "malformed header"
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        return "no length"
    body, close = stop + 4, stop + 4 + int(size)
    if close + 4 > end or data[close : close + 4] != b"\r\n\r\n":
        return "wrong length"
    block = data[body:close]
    if (d := fields.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != base32(hashlib.sha1(block).digest()):
        return "block digest differs"
    return close + 4, fields, block


def member(data: bytes, at: int) -> tuple[int, bytes] | str:
    """The gzip member at a place: its end and content; or what is wrong."""
    z, view, out, size = zlib.decompressobj(31), memoryview(data), [], 4096
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + size]))
            at, size = min(at + size, len(data)), min(2 * size, 1 << 20)
    except zlib.error as e:
        return f"gzip: {e}"
    return (at - len(z.unused_data), b"".join(out)) if z.eof else "gzip: unfinished member"


class Ahead:
    """The next place of a pattern: searched again only once it is passed."""

    def __init__(self, data: bytes, find):
        self.data, self.find, self.at = data, find, -1

    def after(self, at: int) -> int:
        if self.at <= at:
            self.at = self.find(self.data, at + 1)
            self.at = len(self.data) if self.at < 0 else self.at
        return self.at


def _version_line(data: bytes, at: int) -> int:
    m = VERSION.search(data, at)
    return m.start() if m else -1


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order; every byte lies in one of them or in padding."""
    at, n, bad, why = 0, len(data), None, None
    line, magic = Ahead(data, _version_line), Ahead(data, lambda d, k: d.find(MAGIC, k))
    while at < n:
        found: list[Found] = []
        if data.startswith(MAGIC, at):
            got = member(data, at)
            if not isinstance(got, str):
                end, out = got
                inner = 0
                while inner < len(out):
                    one = parse(out, inner, len(out))
                    if isinstance(one, str):
                        # Inside a sound member only version lines can follow.
                        nxt = _version_line(out, inner + 1)
                        stop = nxt if nxt >= 0 else len(out)
                        if found and found[-1].gap:
                            found[-1] = found[-1]._replace(length=stop - found[-1].inner)
                        else:
                            found.append(Found(at, stop - inner, one, {}, b"", inner))
                        inner = stop
                    else:
                        found.append(Found(at, end - at, None, one[1], one[2], inner))
                        inner = one[0]
                got = end
        elif VERSION.match(data, at):
            got = parse(data, at, n)
            if not isinstance(got, str):
                found.append(Found(at, got[0] - at, None, got[1], got[2]))
                got = got[0]
        elif bad is None and (pad := PAD.match(data, at)):
            at = pad.end()
            continue
        else:
            got = "no member or version line"
        if isinstance(got, str):
            if bad is None:
                bad, why = at, got
            at = min(line.after(at), magic.after(at))
            continue
        if bad is not None:
            yield Found(bad, at - bad, why, {}, b"")
            bad = None
        yield from found
        at = got
    if bad is not None:
        yield Found(bad, n - bad, why, {}, b"")


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP block, and the length its header names."""
    head, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
    return body, int(m[1]) if m else len(body)


def with_duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds `first`: the smallest page id of rows with this payload, if others have it too."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("_digest", F.sha1(html))
    groups = rows.where(F.octet_length(html) >= min_bytes).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    return share_join(rows, groups, ["_digest"], rows.count(), "left").drop("_digest")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = 0) -> None:
    """Write pages as .warc.gz archives below a path; a task's first archive is in archive=0, its next in archive=1, ..."""
    spark = pages.sparkSession
    df = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def rows(batches):
        archive = filled = 0
        for b in batches:
            made, places = [], []
            for i, u, h, f in zip(b["page_id"], b["url"], b["html"], b["first"]):
                made.append(gzip.compress(record(i, u, utf8(h), f, f is not None and f != i), 1, mtime=0))
                places.append(archive)
                filled += len(made[-1])
                if filled >= archive_bytes:
                    archive, filled = archive + 1, 0
            yield made, places

    records = map_rows(with_duplicates(df, min_bytes), "record binary, archive int", rows, 128)
    sink = records.select(F.col("record").cast("string"), "archive").write.partitionBy("archive")
    # A task has one archive open at a time, so its rows need no sort.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        sink.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    finally:
        spark.conf.set(key, before)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives below a path; payload=False leaves the payloads out."""
    # A partition holds few archives at a time, as each is a file.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")

    def rows(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                out, held = [], 0
                for f in salvage(bytes(data)):
                    body, size = payload_of(f.block)
                    digest, sound = f.fields.get("warc-payload-digest", "")[5:], f.gap
                    if sound is None and f.fields.get("warc-type") == "response" and digest != base32(hashlib.sha1(body).digest()):
                        sound = "payload digest differs"
                    body = body if payload and sound is None else None
                    out.append((name, f.offset, f.length, f.inner, sound, f.fields.get("warc-type"), f.fields.get("warc-record-id"), f.fields.get("warc-target-uri"), size if sound is None else None, digest or None, f.fields.get("warc-refers-to"), body))
                    held += len(body or b"")
                    if len(out) >= 512 or held > 16 << 20:
                        yield list(zip(*out))
                        out, held = [], 0
                if out:
                    yield list(zip(*out))

    return map_rows(files, "archive string, offset long, length long, inner long, gap string, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary", rows, 1)


def quarantine(found: DataFrame) -> DataFrame:
    """The log of what was put aside: (archive, offset, length, inner, gap)."""
    return found.where("gap IS NOT NULL").select("archive", "offset", "length", "inner", "gap")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back; a row for each page, and an error naming the first gaps if one is lost."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    back = materialise(read(spark, path, payload=False).drop("payload"), "warc-records")
    if lost := quarantine(back).limit(5).collect():
        raise RuntimeError(f"{path} has damaged records: {lost}")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    id_of = lambda c, name: F.when(number(c) != "", number(c).cast("long")).alias(name)
    return back.select(id_of("record_id", "page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to", "refers_to"))
