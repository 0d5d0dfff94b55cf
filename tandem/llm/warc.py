r"""WARC archives: a writer with revisit records and a salvage reader.

Writer: a gzip member per record. Of pages with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is the response and
the others are revisits that refer to it. Which these are is found on digests alone; the payloads travel once, by page_id, to meet the answer.
Archives go to the shared folder under names of their own attempt, and only those that a finished task has reported are read.

Reader: each archive is streamed, a member or record in memory at a time, of at most `most` bytes (MOST by default, also inflated): a longer one, or
one whose damaged length or stream claims to be, is a gap with the reason "too long", after the records that lie whole within that. A record is valid
if its member inflates, its header parses and has the digest it ends with (X-Header-Digest, which the writer adds and records with a field of the writer's must have; other archives lack it), its block
has the stated length, is followed by CRLF CRLF and has the stated digest. No damage raises: numbers count only as up to 18 ASCII digits. After a failed check the reader searches for the next place, member or
version line, at which a valid record starts, recovers from there on, and logs the bytes in between as a quarantined gap with the reason. A member
with a failed check is inflated as far as it goes and searched in the same way: its valid records count, and its bytes are a gap besides. Where
inflation failed, the bytes before may be wrong too, so there a record needs a digest to be valid.

Edge cases: a null payload is empty; a null page_id is written as a response, whatever its payload; rows that repeat the smallest page_id of their
payload are responses all; an empty table gives no archive; a truncated archive gives the records before the cut and one gap, and a
record whose own member is cut, even in the member's last bytes, isn't before it; an archive without any valid record is one gap; zero bytes or line ends between records are no gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import scratch, table

MIN_REVISIT = 100
MOST = 256 << 20
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Compressed bytes to inflate at a time: at most about 1,000 times as many come out.
STEP = 1 << 13
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_DIGEST = b"X-Header-Digest: sha256:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The bytes of a response record, or of a revisit record if refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    head = "\r\n".join(lines).encode() + b"\r\n"
    return head + HEADER_DIGEST + hashlib.sha256(head).hexdigest().encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(Exception):
    """A check failed; the text says which."""


@dataclass
class Record:
    offset: int
    length: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str


#: Fields of the writer's own: a record that has one must end its header with the digest.
OWN = ("x-header-digest", "x-page-id", "x-refers-to-page-id", "x-payload-length")
NUMBER = re.compile("[0-9]{1,18}")


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record that starts in data: its fields in lower case, its block, and where it ends. Raises Bad."""
    head = data.find(b"\r\n\r\n", start)
    if not data.startswith(VERSION, start) or head < 0:
        raise Bad("header")
    fields = {}
    for line in data[start:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not NUMBER.fullmatch(fields.get("content-length", "")) or "warc-type" not in fields:
        raise Bad("header")
    last = data.rfind(b"\r\n", start, head) + 2
    if data.startswith(HEADER_DIGEST, last):
        if hashlib.sha256(data[start:last]).hexdigest().encode() != data[last + len(HEADER_DIGEST) : head]:
            raise Bad("header digest")
    elif any(k in fields for k in OWN):
        raise Bad("header digest")
    end = head + 4 + int(fields["content-length"])
    if end + 4 > len(data):
        raise Bad("truncated")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("length")
    block = data[head + 4 : end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise Bad("digest")
    return fields, block, end + 4


class _Stream:
    """A window on a file: bytes from self.at on, read as needed and dropped when passed."""

    def __init__(self, file):
        self.file, self.at, self.data, self.ended = file, 0, bytearray(), False

    def more(self) -> bool:
        chunk = b"" if self.ended else self.file.read(CHUNK)
        self.ended = not chunk
        self.data += chunk
        return bool(chunk)

    def have(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _take(s: _Stream, skip: int, most: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The records that start skip bytes into the window and their length in the file. Raises Bad."""
    s.have(skip + 7)
    if s.data.startswith(MEMBER, skip):
        z, out, at, size = zlib.decompressobj(31), [], skip, 0
        while not z.eof:
            if at >= len(s.data) and not s.more():
                raise Bad("truncated member")
            if size > most or at - skip > most:
                raise Bad("too long")
            try:
                out.append(z.decompress(bytes(s.data[at : at + STEP])))
            except zlib.error as e:
                raise Bad("member") from e
            at, size = min(len(s.data), at + STEP), size + len(out[-1])
        data, end, found = b"".join(out), 0, []
        while end < len(data):
            fields, block, end = parse(data, end)
            found.append((fields, block))
        if not found:
            raise Bad("empty member")
        return found, at - len(z.unused_data) - skip
    if s.data.startswith(VERSION, skip):
        size = 1 << 16
        while True:
            s.have(skip + size)
            try:
                fields, block, end = parse(bytes(s.data[skip : skip + size]))
                return [(fields, block)], end
            except Bad as e:
                head = s.data.find(b"\r\n\r\n", skip)
                stated = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})", s.data[skip : head + 2]) if head >= 0 else None
                need = head - skip + 8 + int(stated[1]) if stated else 0
                if need > most:
                    raise Bad("too long") from e
                if e.args[0] != "truncated" or need <= size or s.have(skip + need) is False:
                    raise
                size = need
    raise Bad("no record")


_PLACES = re.compile(re.escape(MEMBER) + b"|" + re.escape(VERSION))


def _rescue(s: _Stream, most: int) -> tuple[list[tuple[dict[str, str], bytes]], int, bool]:
    """What a member with a failed check at the window's start still gives: its valid records, how many bytes of it inflate, and whether these are all."""
    z, out, at, size, failed = zlib.decompressobj(31), [], 0, 0, False
    while s.data.startswith(MEMBER) and not (z.eof or failed):
        if at >= len(s.data) and not s.more() or size > most or at > most:
            break
        step = min(STEP, len(s.data) - at)
        while step and at < len(s.data) and not z.eof and size <= most:  # after an error by halves, up to the byte that raises it
            ahead = z.copy()
            try:
                out.append(ahead.decompress(bytes(s.data[at : at + step])))
            except zlib.error:
                step, failed = step // 2, True
                continue
            z, at, size = ahead, min(len(s.data), at + step), size + len(out[-1])
    data, end, last, found = b"".join(out), 0, 0, []
    while (end := data.find(VERSION, end)) >= 0:
        try:
            fields, block, after = parse(data, end)
        except Bad:
            end += 1
            continue
        if z.eof or not failed or fields.get("warc-block-digest", "").lower().startswith("sha256:"):
            found.append((fields, block))
        end = last = after
    if len(found) == 1 and last == len(data) and not (z.eof or failed):
        found = []  # cut within the last bytes of its only record's member: the record isn't before the cut
    return found, at - len(z.unused_data), z.eof


def salvage(file, most: int = MOST) -> Iterator[Record | Gap]:
    """All valid records of an open binary file, and the gaps between them. Holds about `most` bytes, inflated and not, besides a chunk."""
    s = _Stream(file)
    while s.have(1):
        blank = len(s.data) - len(bytes(s.data).lstrip(b"\r\n\0")) if s.data[:1] in (b"\r", b"\n", b"\0") else 0
        if blank:
            s.drop(blank)
            continue
        start, reason = s.at, None
        while True:
            try:
                found, length = _take(s, 0, most)
                break
            except Bad as e:
                reason = reason or e.args[0]
                some, inflated, whole = _rescue(s, most)
                if some:
                    if s.at > start:
                        yield Gap(start, s.at, reason)
                    for fields, block in some:
                        yield Record(s.at, inflated, fields, block)
                    start, reason = s.at, e.args[0]
                    if whole:
                        found, length = [], inflated
                        s.drop(length)
                        break
            s.drop(1)
            while (place := _PLACES.search(s.data)) is None:
                s.drop(max(0, len(s.data) - 6))
                if not s.more():
                    s.drop(len(s.data))
                    yield Gap(start, s.at, reason)
                    return
            s.drop(place.start())
        if s.at > start:
            yield Gap(start, s.at, reason)
        for fields, block in found:
            yield Record(s.at, length, fields, block)
        if found:
            s.drop(length)


ROWS = "kind string, archive string, offset long, length long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"


def read_archives(archives: DataFrame, payloads: bool = True, path: str = "path", most: int = MOST) -> DataFrame:
    """A row per record or gap (ROWS) of the archives whose URIs are in the column path. A record's digest and size are those of its full
    payload: computed for a response, as stated for a revisit. payloads=False leaves the payload null."""
    n = min(10_000, max(1, archives.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        rows, held = [], 0
        whole = lambda x: int(x) if x is not None and re.fullmatch(r"-?[0-9]{1,18}", x) else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, name = _open(uri)
                with system.open_input_stream(name, compression=None) as file:
                    for x in salvage(file, most):
                        if isinstance(x, Gap):
                            rows.append(("gap", uri, x.start, x.end - x.start, *[None] * 7, x.reason))
                            continue
                        f, body = x.fields, x.payload
                        again = f["warc-type"] == "revisit"
                        size = whole(f.get("x-payload-length")) if again else len(body)
                        digest = f.get("warc-payload-digest", "").partition(":")[2] if again else hashlib.sha256(body).hexdigest()
                        rows.append(("record", uri, x.offset, x.length, f["warc-type"], whole(f.get("x-page-id")), f.get("warc-target-uri"), size, digest, whole(f.get("x-refers-to-page-id")), body if payloads and not again else None, None))
                        held += len(body) * payloads
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    return archives.select(F.col(path).alias("path")).repartition(n).mapInArrow(run, ROWS)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id and refers_to of the pages to write as revisits."""
    narrow = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b")).where(F.col("page_id").isNotNull() & (F.octet_length("b") >= MIN_REVISIT))
    narrow = table(narrow.select("page_id", F.unhex(F.sha2("b", 256)).alias("digest")), "payload-digests")
    # Combined before its exchange, so a payload that many pages share is a row per task; then joined by a plain equi-join that Spark splits.
    shared = table(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to"), "shared-payloads")
    return narrow.join(shared, "digest").where("page_id > refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to archives in folder; a row per archive: path, records, bytes. Not lazy."""
    answers = table(revisits(pages), "revisits").withColumnRenamed("page_id", "_id")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # Always by an exchange: whether the answers would fit a broadcast depends on the data.
    rows = rows.join(answers.hint("shuffle_hash"), F.col("page_id") == F.col("_id"), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        done, file, size, count, name = [], None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # a retried or doubled task writes files of its own
                    file, size, count = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(page_id, url, html.encode(), refers_to))
                file.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    file.close()
                    done.append((name, count, size))
                    file = None
        if file is not None:
            file.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()), pa.array([c for _, c, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], names=["path", "records", "bytes"])

    return table(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The op1 result: the pages are written to archives and read back; page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_archives(pages, scratch(spark, "warc"))
    return read_archives(archives, payloads=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to FROM m
"""
