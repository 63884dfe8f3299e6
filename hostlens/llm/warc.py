"""WARC archives, written by Spark tasks and read back by a reader that salvages damaged ones.

Writing: payloads are compared by their SHA-1; of equal payloads the smallest page_id's record is a response and the
others are revisits that name it. A task packs its records into archives of about `ARCHIVE_BYTES`, one gzip member per
record, under a name that no other attempt uses, and returns a manifest row for each archive it has closed. Only
archives in the manifest are read, so files of attempts that were lost or repeated do no harm.

Reading: a task reads an archive through a window. A record is checked: its member inflates and passes its CRC, its
version line and headers parse, its block has Content-Length bytes, its payload has the digest it names. After a
failed check the reader searches for the next valid gzip member, or in a plain archive for the next version line,
recovers what follows, and reports the bytes between as a quarantined gap. Headers and blocks may have any length; a
task holds the window and one record, and a damaged length makes it read nothing more. `quarantined` writes the gaps
of a reading to a table of their own.

Defined results: a null html counts as an empty payload; rows without a page_id take part with the id null, which is
not smaller than any other; rows that repeat the response's page_id and payload are responses themselves; an empty
table gives no archive and no record. Archives lie in the shared folder and are reached through pyarrow's file systems
(local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import shared_dir, table, written

VERSION = b"WARC/1.1"
VERSIONS = (VERSION, b"WARC/1.0")
END = b"\r\n\r\n"
ARCHIVE_BYTES = 64 << 20
LEAST_PAYLOAD = 0
GZIP = b"\x1f\x8b\x08"
READ = 1 << 20
#: No row of Spark could carry a larger record, so a member that inflates beyond it is a gap.
MOST_RECORD = 1 << 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, kind string, start long, end long, page_id long, record_type string, uri string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records --------------------------------------------------------------------------------------------------


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit with the HTTP headers only; both name the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>")]
    clean = "".join(c for c in uri or "" if c not in "\r\n")
    head += [("WARC-Target-URI", clean), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(ValueError):
    """A record that fails a check."""


@dataclass
class Found:
    """A record, or with `problem` a gap of quarantined bytes."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    problem: str | None = None

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def headers_of(head: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record, from its version line up to the empty line, and the Content-Length they state."""
    lines = head.split(b"\r\n")
    if lines[0] not in VERSIONS:
        raise Bad("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise Bad("a header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Bad("no Content-Length")
    return headers, int(size)


def checked(headers: dict[str, str], block: bytes) -> Found:
    found = Found(0, 0, headers, block)
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != sha1_base32(found.payload):
        raise Bad("the payload does not have its digest")
    return found


# -- reader ---------------------------------------------------------------------------------------------------


class Source:
    """Random access to an archive through a window of it, so that looking for something keeps nothing."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""
        self.size = file.seek(0, 2)
        self.seen: dict[bytes, tuple[int, int]] = {}

    def window(self, start: int, n: int) -> int:
        """Have n bytes from start on in the window, or all there are; the place of start in it."""
        n = min(n, self.size - start)
        if not self.at <= start or start + n > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(n, READ))
        return start - self.at

    def read(self, start: int, n: int) -> bytes:
        k = self.window(start, n)
        return self.data[k : k + n]

    def find(self, mark: bytes, start: int) -> int:
        """Where mark is from start on; the archive's size if nowhere. An answer is kept for later starts before it."""
        low, found = self.seen.get(mark, (0, -1))
        if low <= start <= found:
            return found
        at = start
        while at < self.size:
            k = self.window(at, len(mark))
            k = self.data.find(mark, k)
            if k >= 0:
                break
            at = max(at + 1, self.at + len(self.data) - len(mark) + 1)
        found = self.at + k if at < self.size else self.size
        self.seen[mark] = (start, found)
        return found


def _one_member(src: Source, start: int) -> tuple[Found, int]:
    """The record in the gzip member at start, and where the member ends.

    It is inflated in pieces: what cannot be a record, or holds more than its own length says, is given up at once.
    """
    z, out, used, step, most, checked_to = zlib.decompressobj(31), bytearray(), start, 4096, None, 0
    try:
        while not z.eof:
            part = z.unconsumed_tail or src.read(used, step)
            if not part:
                raise Bad("the member is cut short")
            if not z.unconsumed_tail:
                used, step = used + len(part), min(step * 2, READ)
            out += z.decompress(part, READ)
            if most is None:
                if not b"WARC/".startswith(out[:5]) and not out.startswith(b"WARC/"):
                    raise Bad("the member holds no record")
                end = out.find(END, max(0, checked_to - 3))
                checked_to = len(out)
                if end >= 0:
                    headers, size = headers_of(bytes(out[:end]))
                    most = end + 8 + size
            if len(out) > (MOST_RECORD if most is None else most):
                raise Bad("the member holds more than a record")
    except zlib.error as e:
        raise Bad(f"the member does not inflate: {e}") from None
    if most is None or len(out) != most or out[-4:] != END:
        raise Bad("the block does not end where Content-Length says")
    return checked(headers, bytes(out[end + 4 : -4])), used - len(z.unused_data)


def _one_plain(src: Source, start: int) -> tuple[Found, int]:
    """The record at start of an archive that is not compressed, and where it ends. A block that does not end as stated
    is never read."""
    if src.read(start, len(VERSION) + 2)[:-2] not in VERSIONS:
        raise Bad("no version line")
    end = src.find(END, start)
    if end >= src.size or src.find(b"\r\nWARC/1.", start) < end:
        raise Bad("no end of headers")
    headers, size = headers_of(src.read(start, end - start))
    stop = end + 4 + size
    if stop + 4 > src.size or src.read(stop, 4) != END:
        raise Bad("the block does not end where Content-Length says")
    return checked(headers, src.read(end + 4, size)), stop + 4


def salvage(file) -> Iterator[Found]:
    """All valid records of an archive, compressed by member or plain, and the gaps between them, in order."""
    src = Source(file)
    gap, problem, at = None, "", 0  # gap: where the bytes began that no record owns
    while at < src.size:
        mark = src.read(at, 5)
        try:
            if mark != b"WARC/" and not mark.startswith(GZIP):
                raise Bad("neither a member nor a version line")
            found, end = (_one_plain if mark == b"WARC/" else _one_member)(src, at)
        except Bad as e:
            if gap is None:
                gap, problem = at, str(e)
            at = min(src.find(GZIP, at + 1), src.find(b"WARC/1.", at + 1))
            continue
        if gap is not None:
            yield Found(gap, at, problem=problem)
            gap = None
        yield Found(at, end, found.headers, found.block)
        at = end
    if gap is not None:
        yield Found(gap, src.size, problem=problem)


# -- Spark ----------------------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, uri, html (bytes) and refers_to: the response of equal payloads, null for responses themselves."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    keyed = pages.select("page_id", F.col("url").alias("uri"), payload.alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    # The smallest id of each payload, aggregated before the shuffle; nulls do not count.
    # Written, so that the join's sides come from plain scans and Spark can split a hot payload's rows.
    first = written(pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first")), "payloads")
    out = keyed.join(first, "digest")
    again = (F.octet_length("html") >= least) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))) & F.col("first").isNotNull()
    return out.select("page_id", "uri", "html", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) and return the manifest; the archives are written when it is computed."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for b in batches:
            for page_id, uri, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "uri", "html", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, uri, html, refers_to, refers_to is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return with_revisits(pages, least).mapInArrow(write, MANIFEST)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """RECORDS of the archives in manifest: kind record, or kind gap with its problem. payloads: with the payload."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for archive in b.column("archive").to_pylist():
                store, path = _open(archive)
                with store.open_input_file(path) as file:
                    for f in salvage(file):
                        if f.problem is not None:
                            rows.append((archive, "gap", f.start, f.end, *[None] * 7, f.problem))
                            continue
                        h = f.headers
                        http = f.block.partition(b"\r\n\r\n")[0].lower()
                        size = [int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"content-length:") and x[15:].strip().isdigit()]
                        own = f.payload if payloads else None
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((archive, "record", f.start, f.end, _page(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), _page(h.get("warc-refers-to")), size[0] if size else len(f.payload), digest, own, None))
                        held += len(own or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch()
                            rows.clear()
                            held = 0
        yield batch()

    return manifest.select("archive").mapInArrow(read, RECORDS)


def quarantined(found: DataFrame, path: str) -> int:
    """Log the gaps among RECORDS as a table at path (archive, start, end, problem) and return their number."""
    gaps = found.filter("kind = 'gap'").select("archive", "start", "end", "problem")
    n = gaps.count()
    if n:
        gaps.write.parquet(path)
    return n


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # The manifest is written, so the archives are complete before any is read; a row for each archive.
    manifest = written(write_archives(pages, shared_dir(spark, "warc")), "manifest")
    n = max(1, manifest.count())
    found = written(read_archives(manifest.repartition(n, "archive")), "records")  # narrow rows; the gaps are kept with them
    lost = quarantined(found, shared_dir(spark, "warc-gaps"))
    if lost:
        raise RuntimeError(f"{lost} byte ranges of archives that were just written cannot be read; they are listed in the folder warc-gaps")
    found = found.filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
