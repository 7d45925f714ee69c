"""WARC archives of pages: one gzip member per record, equal payloads as revisits, and a sequential reader.

Archives are real ``.warc.gz`` bytes, one per file. They are written through Spark's own file commit, so that a
lost executor leaves no half archive and any file system Spark reaches will do; each file ends in one zero byte,
which gzip readers skip as padding.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from studyspark.llm.batches import sliced

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes handed to the decompressor at once.
READ_BYTES = 1 << 16
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_revisits(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers_to): of equal payloads of at least ``least_bytes`` bytes, rows with the smallest id are
    responses (refers_to null), the others refer to it. A null payload is empty; a null id never is the smallest, unless
    all ids of a payload are null: then its rows are all responses."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(key: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record as a gzip member."""
    name = "" if key is None else quote(str(key), safe="")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{name}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{quote(str(refers_to), safe='')}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + press.flush()


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of ``with_revisits`` as archives into ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in sliced(batches, "payload"):
            for key, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                members.append(record(key, url, payload, first, date))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])

    archives = records.select("id", "url", "payload", "refers_to").mapInArrow(run, StructType([StructField("archive", BinaryType())]))
    # The text writer copies the bytes of a string as they are; it ends each file with the separator.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


class Member:
    """One gzip member, inflated a little at a time."""

    def __init__(self, archive: bytes, at: int) -> None:
        self.archive, self.at = archive, at
        self.unpress = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        if self.unpress.eof:
            return False
        tail = self.unpress.unconsumed_tail
        if not tail:
            tail = self.archive[self.at:self.at + READ_BYTES]
            self.at += len(tail)
            if not tail:
                raise ValueError("the archive ends inside a record")
        self.held += self.unpress.decompress(tail, 16 * READ_BYTES)
        if self.unpress.eof:
            self.at -= len(self.unpress.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to ``mark``, which is passed over."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                raise ValueError("a record without the end of its header")
        out = bytes(self.held[:found])
        del self.held[:found + len(mark)]
        return out

    def read(self, count: int) -> bytes:
        while len(self.held) < count:
            if not self._more():
                raise ValueError("a record shorter than its Content-Length")
        out = bytes(self.held[:count])
        del self.held[:count]
        return out

    def end(self) -> int:
        """Check what follows the block; where the next member begins."""
        while self._more():
            pass
        if bytes(self.held) != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        return self.at


def fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {p[0].strip().lower(): p[1].strip() for p in pairs if len(p) == 2}


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, in order. Zero bytes between members are padding. Raises ValueError for
    a truncated or badly framed archive."""
    at = 0
    while at < len(archive):
        if archive[at] == 0:
            at += 1
            continue
        member = Member(archive, at)
        head = fields(member.until(b"\r\n\r\n"))
        block = member.read(int(head.get("content-length", 0)))
        at = member.end()
        yield head, block


def _name(field: str | None) -> str | None:
    name = unquote((field or "").strip("<>").removeprefix(_ID))
    return name or None


def _row(head: dict[str, str], block: bytes) -> tuple:
    kind = head.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    sound = head.get("warc-block-digest") in (None, f"sha1:{base32_sha1(block)}")
    if kind == "response":
        length, sound = len(payload), sound and digest in (None, base32_sha1(payload))
        digest = base32_sha1(payload)
    else:
        payload, stated = None, fields(http).get("content-length", "")
        length = int(stated) if stated.isdigit() else None
    return (_name(head.get("warc-record-id")), head.get("warc-target-uri"), kind, payload, length, digest, _name(head.get("warc-refers-to")), sound)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(record, target_uri, record_type, payload, payload_bytes, payload_digest, refers_to, sound) per record of every
    archive in ``folder``. A response's digest and length are those of the payload read; a revisit has no payload and
    states both. ``sound`` is false where a stated digest differs from the bytes read. An empty folder gives no row."""
    schema = StructType([StructField("record", StringType()), StructField("target_uri", StringType()), StructField("record_type", StringType()),
                         StructField("payload", BinaryType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()),
                         StructField("refers_to", StringType()), StructField("sound", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for head, block in read_records(archive.as_py()):
                    rows.append(_row(head, block))
                    size += len(block)
                    if size > READ_BYTES << 6:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)
