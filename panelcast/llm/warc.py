"""WARC archives: one gzip member per record, written with revisits, read sequentially."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass, materialise, task_number

# Format names of the archive standard: fixed values.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_SHARED_BYTES = 1000
PART_BYTES = 1 << 20
SALTS = 16
RECORD = "urn:x-page:"


def record_types(
    pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES, *, id_col="page_id", url_col="url", html_col="html"
) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the response. Payloads
    are grouped by digest and size alone; the texts are shuffled once, on the digest with a
    salt of the id, so a payload on a third of the pages is spread over tasks.
    """
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    data = F.col("html").cast("binary")
    keyed = pages.withColumns(
        {"_digest": F.unhex(F.sha2(data, 256)), "_size": F.octet_length(data)}
    )
    shared = (
        keyed.where(F.col("_size") >= min_bytes)
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisits = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return salted.join(shared, ["_digest", "_salt"], "left").select(
        "page_id", "url", "html", F.when(revisits, F.col("_largest")).alias("refers_to")
    )


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member. A revisit carries the response's headers, no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block = http % len(payload) + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _header_safe(url or "")),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(archive, content): each row is a whole small archive of about ``part_bytes``.

    Kept as a table in the shared folder, so that any store Spark can write will do and a
    lost task is written again under the same name. Record-sized memory per task.
    """

    def work(batches):
        task, n, members, size = task_number(), 0, [], 0

        def row():
            name = f"pages-{task:06d}-{n:06d}.warc.gz"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([b"".join(members)], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                members.append(record_bytes(page_id, url, html.encode(), refers_to))
                size += len(members[-1])
                if size >= part_bytes:
                    yield row()
                    n, members, size = n + 1, [], 0
        if members:
            yield row()

    return materialise(arrow_pass(records, work, "archive string, content binary"))


def _inflated(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Decompressed data with a flag after each gzip member's end."""
    member, limit = None, 1 << 16
    for chunk in chunks:
        more = False
        while chunk or more:
            if member is None:
                member = zlib.decompressobj(31)
            data = member.decompress(chunk, limit)
            if data:
                yield data, False
            if member.eof:
                chunk, more, member = member.unused_data, False, None
                yield b"", True
            else:
                chunk, more = member.unconsumed_tail, len(data) == limit
    if member is not None:
        raise ValueError("archive ends inside a gzip member")


def read_records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Records of one archive, in order, holding one buffer of the stream at a time.

    A record is framed by its Content-Length inside its own gzip member; payload and block
    digests are computed as the block goes by, and a mismatch raises.
    """
    buffer, record = bytearray(), None
    for data, ended in _inflated(chunks):
        buffer += data
        if record is None:
            at = buffer.find(b"\r\n\r\n")
            if at >= 0:
                record = _Record(bytes(buffer[:at]))
                del buffer[: at + 4]
        if record is not None:
            del buffer[: record.feed(buffer)]
        if ended:
            if record is None or bytes(buffer) != b"\r\n\r\n":
                raise ValueError("a record does not fill its gzip member")
            yield record.close()
            buffer.clear()
            record = None


class _Record:
    def __init__(self, head: bytes):
        version, *lines = head.decode("utf-8").split("\r\n")
        if version.encode() != VERSION:
            raise ValueError(f"not a record: {version[:40]!r}")
        self.fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        self.left = int(self.fields["content-length"])
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.http, self.in_payload, self.payload_bytes = bytearray(), False, 0

    def feed(self, buffer: bytearray) -> int:
        data = bytes(buffer[: self.left])
        self.left -= len(data)
        self.block.update(data)
        if not self.in_payload:
            self.http += data
            at = self.http.find(b"\r\n\r\n")
            if at < 0:
                return len(data)
            body, self.in_payload = bytes(self.http[at + 4 :]), True
            del self.http[at + 4 :]
        else:
            body = data
        self.payload.update(body)
        self.payload_bytes += len(body)
        return len(data)

    def close(self) -> dict:
        if self.left:
            raise ValueError(f"record is {self.left} bytes short")

        def digest(value: str) -> str:
            return base64.b32decode(value.removeprefix("sha1:")).hex()

        kind, stated = self.fields["warc-type"], digest(self.fields["warc-payload-digest"])
        if self.block.hexdigest() != digest(self.fields["warc-block-digest"]):
            raise ValueError("block digest differs")
        lines = bytes(self.http).decode("latin-1").split("\r\n")
        size = next(int(x[16:]) for x in lines if x.lower().startswith("content-length: "))
        if kind == "response" and (self.payload.hexdigest() != stated or self.payload_bytes != size):
            raise ValueError("payload differs from its digest or size")

        def page(name: str) -> int | None:
            text = self.fields.get(name, "").strip("<>").removeprefix(RECORD)
            return int(text) if text else None

        return {
            "page_id": page("warc-record-id"),
            "url": self.fields["warc-target-uri"],
            "payload_bytes": size,
            "payload_digest": stated,
            "record_type": kind,
            "refers_to": page("warc-refers-to"),
        }


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per record of every archive row (also of Spark's ``binaryFile`` source).

    A damaged archive, a wrong length or a wrong digest fails the job.
    """

    def work(batches):
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            for value in batch.column(0):
                data = memoryview(value.as_buffer())
                chunks = (bytes(data[i : i + 65536]) for i in range(0, len(data), 65536))
                rows = list(read_records(chunks))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow).select(names)

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long"
    )
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))])
    return arrow_pass(archives.select(content_col), work, schema)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES, **columns) -> DataFrame:
    """Write every page to archives and read them back; one row per page, repeated rows too.

    A null html is an empty payload, a null url an empty target, a null page_id a record
    without number (never the response of a group that has numbered pages). Rows that
    repeat the largest page_id of a group are all responses.
    """
    return read_archives(write_archives(record_types(pages, min_bytes, **columns)))
