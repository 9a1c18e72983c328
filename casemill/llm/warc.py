"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 1 << 16
_MANIFEST = "path string, records long, bytes long"
_RECORD = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_DATE = "1970-01-01T00:00:00Z"
_ID = "urn:page:"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value: control characters would break the framing and are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit keeps the HTTP header, and so the length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_ID}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _write(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out, path, rows, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, rows, size))
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(c)[i] for c in ("page_id", "url", "payload", "digest", "refers_to"))
                payload = (html.as_py() or "").encode()
                if out is None:
                    # A name of its own for each attempt: only those of tasks that end well are listed.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, rows, size = f"{folder}/{name}", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                packed = _member(record_bytes(page.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers.as_py()), level)
                out.write(packed)
                rows, size = rows + 1, size + len(packed)
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return run


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_revisit: int = 0, archive_bytes: int = 64 << 20, level: int = 4, salts: int = 16,
) -> DataFrame:
    """Write every page as a record under ``folder``, a path all executors share; the list of archives.

    The payload is the html in UTF-8, empty for null.  Of pages with equal payloads of at
    least ``min_revisit`` bytes the smallest id becomes a response and the others revisits of
    it; rows that repeat that id are responses too.  Pages without an id never are referred to.
    A null url has no target header; control characters in urls are percent-encoded.  An
    empty table writes no archive.  Other columns are not looked at.

    Digests are grouped first, so a payload shared by a third of all pages meets as partial
    minima.  Only payloads that occur again are joined back, spread over ``salts`` keys each.
    """
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("payload")
    ).withColumn("digest", F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    big = F.coalesce(F.octet_length("payload"), F.lit(0)) >= min_revisit
    firsts = rows.filter(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = rows.join(firsts.hint("shuffle_hash"), ["digest", "salt"], "left")
    revisit = F.when(F.col("first") != F.coalesce("page_id", F.lit((1 << 63) - 1)), F.col("first"))
    ready = joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))
    ready.mapInArrow(_write(folder, archive_bytes, level), _MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


class _Members:
    """The records of an archive, one after the other; never more than a chunk ahead."""

    def __init__(self, stream):
        self.stream, self.rest, self.buffer, self.unzip = stream, b"", bytearray(), None

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(_CHUNK)
        if not self.rest:
            return False
        self.unzip, self.buffer = zlib.decompressobj(31), bytearray()
        return True

    def _more(self) -> bool:
        """Unzip one chunk more of this member."""
        while not self.unzip.eof:
            data = self.rest or self.stream.read(_CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            got = self.unzip.decompress(data, _CHUNK)
            self.rest = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record has no end of header")
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def chunks(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            out = bytes(self.buffer[:size])
            del self.buffer[: len(out)]
            size -= len(out)
            yield out

    def finish(self) -> None:
        if b"".join(self.chunks(4)) != b"\r\n\r\n" or self.buffer or self._more():
            raise ValueError("a record is longer than its Content-Length")


def _fields(header: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in header.decode().split("\r\n")[1:] if x)}


def read_records(stream, payloads: bool = True) -> Iterator[tuple]:
    """Records of one archive as tuples; framing and payload digests are verified.

    A revisit has no payload; its digest and length are those of the record it refers to.
    """
    members = _Members(stream)
    while members.next_member():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        warc = _fields(head)
        left = int(warc["content-length"])
        http = members.until(b"\r\n\r\n")
        left -= len(http)
        if left < 0:
            raise ValueError("a record's block is shorter than its HTTP header")
        size, digest, kept = int(_fields(http)["content-length"]), hashlib.sha1(), []
        revisit = warc["warc-type"] == "revisit"
        if left != (0 if revisit else size):
            raise ValueError("Content-Length of record and payload do not agree")
        for chunk in members.chunks(left):
            digest.update(chunk)
            if payloads:
                kept.append(chunk)
        members.finish()
        said = warc["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and base64.b32encode(digest.digest()).decode() != said:
            raise ValueError(f"the payload of {warc['warc-record-id']} does not have its digest")
        yield (
            warc["warc-record-id"].strip("<>"), warc["warc-type"], warc.get("warc-target-uri"),
            warc["warc-refers-to"].strip("<>") if revisit else None, said, size,
            b"".join(kept) if payloads and not revisit else None,
        )


def _read(payloads: bool, batch_bytes: int):
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column("path").to_pylist():
                system, name = _open(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for row in read_records(stream, payloads):
                        rows.append(row)
                        held += 300 + len(row[-1] or b"")
                        if held >= batch_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(archives: DataFrame, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the listed archives (column ``path``); each archive is read by one task."""
    spark: SparkSession = archives.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(parts, "path").mapInArrow(_read(payloads, batch_bytes), _RECORD)


def page_number(record_id: str) -> Column:
    """The page id in a record id; null for pages without one."""
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) AS BIGINT)")
