"""WARC archives: a writer that marks repeated payloads, and a reader that salvages damaged files.

Writing: of the rows with equal payloads, the one with the smallest page_id becomes a ``response`` record, the others become
``revisit`` records without payload. Each record is one gzip member; each task writes one file under a name of its own attempt, and
only files that the finished job lists count.

Reading: a record is accepted after its gzip checksum, version line, block length and payload digest have been checked. After a
failed check the reader searches for the next valid gzip member (or version line, in a file that is not compressed), goes on
there, and logs the bytes between as a quarantined gap. A file is read in pieces; one record is held at a time.

Cases: a null html is an empty payload, a null url an empty target; a null page_id is larger than all others; rows that agree in
payload and page_id are all responses; a payload below ``least_bytes`` is always a response; an empty table writes no file
and reads as no record; an empty file has neither records nor gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches, whole_text
from tidepool.session import stage_table

PIECE = 1 << 17
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
START = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+\r\n")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_type: str, page: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record, not compressed. ``size`` is that of the full payload, which a revisit does not hold."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload if record_type == "response" else head
    lines = [
        f"WARC-Type: {record_type}", f"WARC-Record-ID: <{ID}{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(body: bytes) -> bytes:
    """A gzip member without time stamp, so that equal rows give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def _open(path: str):
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def roles(pages: DataFrame, page: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that are revisits; null refers_to: a response without page_id."""
    payload = whole_text(html).cast("binary")
    keys = pages.select(F.col(page).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("size"))
    keys = stage_table(keys.where(F.col("size") >= least_bytes), "payload-keys").select("page_id", "digest").distinct()
    least = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where(F.col("n") > 1)
    found = keys.join(least.select("digest", "refers_to"), "digest")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages``; returns (path, records, bytes) of the files of the finished job.

    Page ids spread the join, so a payload that many rows share meets no single task.
    """
    small_batches(pages.sparkSession)
    again = roles(pages, page, html, least_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    payload = whole_text(html)
    rows = pages.select(F.col(page).cast("long").alias("page_id"), whole_text(url).alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    joined = rows.join(stage_table(again, "revisits"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    joined = joined.select("page_id", "url", "html", "refers_to", F.col("d").isNotNull().alias("again"))

    def write(batches):
        sink, path, count, size = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for values in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if sink is None:
                    system, inner = _open(path)
                    sink = system.open_output_stream(inner, compression=None)
                page_id, target, text, refers_to, revisit = values
                data = text.encode("utf-8", "surrogatepass")
                target = " ".join(target.split())  # a line break would end the header line
                name = "null" if page_id is None else str(page_id)
                kind = ("revisit", name, target, b"", payload_digest(data), len(data), str(refers_to)) if revisit else (
                    "response", name, target, data, payload_digest(data), len(data))
                packed = member(record(*kind))
                sink.write(packed)
                count, size = count + 1, size + len(packed)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return stage_table(joined.mapInArrow(write, "path string, records long, bytes long"), "archives")


class Reader:
    """Records and gaps of one archive, from any object with read(); holds one record and one piece."""

    def __init__(self, source):
        self.source, self.base, self.held, self.ended = source, 0, b"", False
        self.blank = -1  # offset in the file of the last header end found

    def _fill(self, size: int) -> bool:
        """Hold at least ``size`` bytes, if the file has them."""
        parts = [self.held]
        have = len(self.held)
        while have < size and not self.ended:
            piece = self.source.read(PIECE)
            self.ended = not piece
            parts.append(piece)
            have += len(piece)
        self.held = b"".join(parts)
        return have >= size

    def _drop(self, size: int) -> None:
        self.held, self.base = self.held[size:], self.base + size

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """The content of the gzip member at ``at`` and its end, if its checksum holds."""
        unpacker, parts, end = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                if end >= len(self.held) and not self._fill(end + 1):
                    return None
                piece = self.held[end : end + PIECE]
                parts.append(unpacker.decompress(piece))
                end += len(piece)
                if len(parts) == 1 and not parts[0][:7] == START[: len(parts[0][:7])]:
                    return None
        except zlib.error:
            return None
        return b"".join(parts), end - len(unpacker.unused_data)

    def _header_end(self, at: int) -> int:
        """Where the next header end after ``at`` is, however far; -1 if the file has none. No byte is searched twice."""
        if self.blank < self.base + at:
            begin = at
            while True:
                stop = self.held.find(b"\r\n\r\n", begin)
                if stop >= 0:
                    self.blank = self.base + stop
                    break
                begin = max(at, len(self.held) - 3)
                if not self._fill(len(self.held) + max(PIECE, len(self.held) - at)) and len(self.held) <= begin + 3:
                    self.blank = 1 << 62
                    break
        return self.blank - self.base if self.blank < 1 << 62 else -1

    def _plain(self, at: int) -> tuple[bytes, int] | None:
        """The bytes of the record without compression at ``at`` and its end, by its stated length."""
        if not self._fill(at + len(VERSION)) or not VERSION_LINE.match(self.held, at):
            return None
        stop = self._header_end(at)
        if stop < 0:
            return None
        size = headers(self.held[at:stop]).get("content-length", "")
        if not size.isdigit():
            return None
        end = stop + 4 + int(size) + 4
        return (self.held[at:end], end) if self._fill(end) else None

    def _valid(self, at: int):
        """(record, end) if what starts at ``at`` passes all checks, else the reason why not."""
        if not self._fill(at + 3):
            return "truncated"
        if self.held.startswith(MAGIC, at):
            found = self._member(at)
        elif self._fill(at + 7) and self.held.startswith(START, at):
            found = self._plain(at)
        else:
            return "no record starts here"
        if found is None:
            return "broken member or header"
        parsed = parse(found[0])
        return (parsed, found[1]) if isinstance(parsed, dict) else parsed

    def _seek(self) -> bool:
        """Drop what is held up to the next place where a member or version line may start; false at the end of the file."""
        self._drop(1)
        while True:
            places = [p for p in (self.held.find(MAGIC), self.held.find(START)) if p >= 0]
            if places:
                self._drop(min(places))
                return True
            self._drop(max(0, len(self.held) - len(START) + 1))
            if not self._fill(len(self.held) + 1):
                self._drop(len(self.held))
                return False

    def __iter__(self):
        """Yields ("record", offset, fields) and ("gap", offset, size and reason)."""
        while self._fill(1):
            got = self._valid(0)
            if isinstance(got, tuple):
                yield "record", self.base, got[0]
                self._drop(got[1])
                continue
            begin, reason = self.base, got
            while self._seek() and not isinstance(self._valid(0), tuple):
                pass
            yield "gap", begin, {"size": self.base - begin, "reason": reason}


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def parse(body: bytes) -> dict | str:
    """The fields of a record, or the check that it fails."""
    stop = body.find(b"\r\n\r\n")
    if not VERSION_LINE.match(body) or stop < 0:
        return "no version line or header end"
    fields = headers(body[:stop])
    block = body[stop + 4 : -4]
    if not body.endswith(b"\r\n\r\n") or fields.get("content-length") != str(len(block)):
        return "block length"
    stated = fields.get("warc-block-digest")
    if stated and stated != f"sha1:{payload_digest(block)}":
        return "block digest"
    http = block.find(b"\r\n\r\n")
    payload = block[http + 4 :] if block.startswith(b"HTTP/") and http >= 0 else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and digest and digest != payload_digest(payload):
        return "payload digest"
    size = fields.get("x-payload-length", "")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type", ""),
        "url": fields.get("warc-target-uri", ""), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest or payload_digest(payload), "payload": b"" if revisit else payload,
        "payload_bytes": int(size) if revisit and size.isdigit() else len(payload),
    }


READ = (
    "path string, kind string, position long, record_id string, record_type string, url string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, gap_bytes long, reason string"
)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``kind`` record or gap) of the archives that the column ``path`` names; a file is one task's work."""
    spark = paths.sparkSession
    small_batches(spark)
    names = [f.split()[0] for f in READ.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(names, READ.split(", "), strict=True)])

    def rows_of(path):
        system, inner = _open(path)
        with system.open_input_stream(inner, compression=None) as source:
            for kind, position, found in Reader(source):
                row = {"path": path, "kind": kind, "position": position}
                if kind == "record":
                    row |= found if with_payload else found | {"payload": None}
                else:
                    row |= {"gap_bytes": found["size"], "reason": found["reason"]}
                yield row

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(path):
                    held.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 32 * PIECE:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    spread = paths.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(read, READ)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: (path, position, gap_bytes, reason)."""
    return found.where(F.col("kind") == "gap").select("path", "position", "gap_bytes", "reason")


def page_of(column: Column) -> Column:
    """The page_id that a record id stands for; null for other ids."""
    return F.regexp_extract(column, f"^{ID}(-?[0-9]+)$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and return what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = write_archives(pages, folder, least_bytes=least_bytes)
    found = read_archives(files, with_payload=False).where(F.col("kind") == "record")
    return found.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"),
    )
