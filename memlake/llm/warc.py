"""WARC archives: a writer that marks repeated payloads as revisits, and a salvage reader.

The writer gives one record per page. Of records with equal payloads the one with the smallest page_id is a response, the
others revisit it. Archives are written by Spark's text writer, one record per row and the record separator between rows,
so any file system Spark knows can hold them.

The salvage reader takes the bytes of an archive, plain or of gzip members. After a failed check (version line, header,
Content-Length, separator, digest, gzip) it searches for the next valid member or version line, goes on from there, and
logs the bytes passed over as a quarantined gap. A sound member with damaged records gives its sound ones, the gaps in it
logged by its place. A broken member gives the sound records before its break, but for one that ends right at it without a digest
of its own, as no checksum vouches for that; each broken member's bytes are a gap. Time is linear in the archive's bytes, but for
digests of records that claim each other's bytes: members are inflated block by block, each mark is searched for once, and a header
that failed isn't read again from a later version line in it.

Edge cases: null html is an empty payload. A null url is written as an empty target. Very long pages: files are cut by
size classes, so an archive is at most about ARCHIVE_BYTES, or one record. Ties: repeated rows with one page_id and
one payload are one response each, as none has a smaller id. Rows with a null page_id are responses without an id and
are never revisited. An empty table writes no archive and reads back no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.shared import fresh_path, make_path, sized_stash, small, stash, table

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
#: Payloads under this size are never revisits.
MIN_REVISIT_BYTES = 0
#: Bytes of records in one archive at most, but for a single larger record; one archive is read by one task.
ARCHIVE_BYTES = 16 << 20
#: Records of up to these bytes are written to archives of their own; so files can be cut by numbers of records.
CLASSES = (4 << 10, 64 << 10, 1 << 20)
#: Bytes of a record's header at most, and of an archive inflated at once.
MAX_HEADER, BLOCK = 64 << 10, 64 << 10
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A record without the separator that ends it. A revisit carries no payload but its size and digest."""
    kind = b"response" if refers_to is None else b"revisit"
    block = payload if refers_to is None else b""
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())]
    lines += [b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or "").encode()]
    lines += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"Payload-Length: %d" % len(payload)]
    if refers_to is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + END + block


class _Next:
    """The next place of a mark, each byte looked at once."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.at = data, mark, -1

    def after(self, at: int) -> int:
        if self.at <= at:
            found = self.data.find(self.mark, at + 1)
            self.at = found if found >= 0 else len(self.data)
        return self.at


class _Heads:
    """Ends of headers, and what is known of the one looked at last: version lines below `dead` that end at `stop` fail."""

    def __init__(self, data: bytes):
        self.ends, self.stop, self.dead = _Next(data, END), -1, 0


def _plain(data: bytes, at: int, heads: _Heads) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record that begins at `at`; None if a check fails."""
    if not re.match(rb"WARC/\d\.\d\r\n", data[at : at + 10]):
        return None
    stop = heads.ends.after(at)
    if stop == len(data) or stop - at > MAX_HEADER or stop == heads.stop and at < heads.dead:
        return None
    found = _record(data, at, stop)
    if isinstance(found, int):
        heads.stop, heads.dead = stop, found
        return None
    return found


def _record(data: bytes, at: int, stop: int) -> tuple[dict, bytes, int] | int:
    """The record whose header ends at `stop`; if a check fails, the place below which no version line with this header's end can do.

    Of a name that comes twice the last value counts, so a header that begins later has the same values or fewer.
    """
    head, line_at = {}, data.index(b"\r\n", at) + 2
    while line_at < stop:
        line_end = data.find(b"\r\n", line_at, stop)
        line = data[line_at : line_end if line_end >= 0 else stop]
        name, colon, value = line.partition(b":")
        if not colon:
            return line_at
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line_at += len(line) + 2
    if not re.fullmatch(r"\d+", head.get("content-length", "")) or not head.get("warc-type") or not head.get("warc-record-id"):
        return stop
    begin, size = stop + len(END), int(head["content-length"])
    if begin + size + len(END) > len(data) or data[begin + size : begin + size + len(END)] != END:
        return stop
    block = data[begin : begin + size]
    if _vouched(head) and head["warc-payload-digest"][5:] != digest(block):
        return stop
    return head, block, begin + size + len(END)


def _vouched(head: dict) -> bool:
    """A record whose own digest covers its block."""
    return head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:")


def _number(text: str | None) -> int | None:
    return int(text) if re.fullmatch(r"\d+", text or "") else None


def _member(data: bytes, at: int) -> tuple[bytes, int, bool] | None:
    """Content, end and soundness of the gzip member that begins at `at`; None if there is none. A broken one has what came before the break."""
    if data[at : at + 3] != GZIP:
        return None
    unzip, out, view = zlib.decompressobj(31), [], memoryview(data)
    while at < len(data) and not unzip.eof:
        block = view[at : at + BLOCK]
        try:
            out.append(unzip.decompress(block))
        except zlib.error:
            # Byte by byte, as an error hides what the rest of its block gave.
            return b"".join([*out, _up_to_error(unzip, out, data, at)]), at, False
        at += len(block)
    return b"".join(out), at - len(unzip.unused_data), unzip.eof


def _up_to_error(unzip, out: list[bytes], data: bytes, at: int) -> bytes:
    """What the block at `at` gives before its error. The state after an error is lost, so the member's blocks are read again, the last bytewise."""
    del unzip
    first = at - BLOCK * len(out)
    again, got = zlib.decompressobj(31), []
    for i in range(first, at, BLOCK):
        again.decompress(data[i : i + BLOCK])
    for i in range(at, min(at + BLOCK, len(data))):
        try:
            got.append(again.decompress(data[i : i + 1]))
        except zlib.error:
            break
    return b"".join(got)


class Gap(tuple):
    """A pair of places (begin, end); `inner` holds the gaps within the content of the gzip member there, if it is sound."""

    inner: tuple = ()


def salvage(data: bytes, inside: bool = False) -> tuple[list[tuple[dict, bytes, int]], list[tuple[int, int]]]:
    """All sound records of an archive (headers, block, place), and the gaps (begin, end) of bytes that belong to none.

    `inside` tells that the bytes are a member's content, which holds no further members.
    """
    records, gaps, at, bad = [], [], 0, None
    marks, heads = [_Next(data, b"WARC/")] + ([] if inside else [_Next(data, GZIP)]), _Heads(data)

    def close(end: int) -> None:
        nonlocal bad
        if bad is not None:
            gaps.append(Gap((bad, end)))
            bad = None

    while at < len(data):
        if got := _plain(data, at, heads):
            close(at)
            records.append((got[0], got[1], at))
            at = got[2]
            continue
        if not inside and (got := _member(data, at)):
            content, end, sound = got
            inner, inner_gaps = salvage(content, True)
            if sound and inner:
                close(at)
                if inner_gaps:
                    gap = Gap((at, end))
                    gap.inner = tuple(inner_gaps)
                    gaps.append(gap)
                records += [(h, b, at) for h, b, _ in inner]
                at = end
                continue
            if not sound:
                tail = inner_gaps[-1][1] == len(content) if inner_gaps else False
                kept = inner if tail or inner and _vouched(inner[-1][0]) else inner[:-1]
                if kept:
                    close(at)
                    records += [(h, b, at) for h, b, _ in kept]
        if bad is None:
            bad = at
        at = min(m.after(at) for m in marks)
    close(len(data))
    return records, gaps


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record per row of `pages` (page_id, url, html) to archives under `path`.

    Only ids and digests are shuffled to find the smallest id of a payload; a payload that many pages share arrives
    pre-aggregated. Only payloads seen twice are joined back, by broadcast if their stored size allows.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed, _ = sized_stash(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").cast("long").alias("n")), "hashed")
    kind = sum((F.col("n") > c).cast("int") for c in CLASSES)
    largest = {r["kind"]: r["most"] for r in hashed.groupBy(kind.alias("kind")).agg(F.max("n").alias("most")).collect()}  # four rows at most
    firsts = hashed.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    twice, size = sized_stash(firsts.where("c > 1").select("d", "first"), "twice")
    first = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    marked = rows.withColumn("d", F.sha1(F.col("html").cast("binary"))).join(small(twice, size), "d", "left").select("page_id", "url", "html", first.alias("first"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            for i in range(0, len(cols[0]), 64):
                out = [record(p, u, h.encode(), f) for p, u, h, f in zip(*(c[i : i + 64] for c in cols), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    of_row = sum((F.octet_length("html") > c).cast("int") for c in CLASSES)
    make_path(pages.sparkSession, path)
    for k, most in largest.items():
        part = marked if len(largest) == 1 else marked.where(of_row == k)
        text = part.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
        text.write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (most + 1000))).text(f"{path}/size{k}")


def read(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, archive, place, gap_end) of all archives under
    `path`. A quarantined gap is a row of record_type `gap` with its place and gap_end only; payload_bytes of a gap within a sound
    gzip member are the bytes of content passed over."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long, gap_end long"

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                records, gaps = salvage(data.as_py())
                out = []
                for h, block, at in records:
                    full = h["warc-type"] != "revisit"
                    out.append((number(h.get("warc-record-id")), len(block) if full else _number(h.get("payload-length")), h.get("warc-payload-digest", "sha1:" + digest(block)).removeprefix("sha1:"), h["warc-type"], None if full else number(h.get("warc-refers-to")), name, at, None))
                out += [(None, sum(e - b for b, e in g.inner) or None, None, "gap", None, name, *g) for g in gaps]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(rows, schema)


def log_gaps(found: DataFrame, path: str) -> DataFrame:
    """The rows of read() that are records; those that are gaps are written as a Parquet table at `path`."""
    found.where("record_type = 'gap'").select("archive", "place", "gap_end", F.col("payload_bytes").alias("inner_bytes")).write.parquet(path)
    return found.where("record_type <> 'gap'")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    found = stash(read(spark, path, "part-*"), "records")
    return log_gaps(found, f"{path}-gaps").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST((5 * i) // 4 + 1 AS BIGINT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
