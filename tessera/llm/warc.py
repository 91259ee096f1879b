"""WARC archives: a writer with one gzip member for each record, and a sequential reader that checks what it reads."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, scratch

#: Smaller payloads are always written in full.
REVISIT_FROM = 1000
#: Records of an archive at most, and payload bytes; an archive is read as one value, which must stay under 2 GB.
RECORDS_PER_FILE = 1000
BYTES_PER_FILE = 512_000_000
CHUNK = 65536
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) for each row of pages(page_id, url, html).

    A null html is an empty payload. Of rows with equal payloads of REVISIT_FROM bytes or more the one with the
    largest page_id is a response and the others revisit it; a null page_id is never the largest, and without any id
    all are responses. Repeated rows with the largest id are each a response. Payloads meet by SHA-1 and length; the
    largest id of each comes from a map-side aggregate.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    top = rows.where(F.col("n") >= REVISIT_FROM).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1 and top is not null").drop("m")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(top, ["digest", "n"], "left").select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header alone, with the length of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    else:
        block += payload
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, block)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record, its last byte left off: it is 0, and the text writer's line end puts it back."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            out = []
            for r in b.slice(i, 64).to_pylist():
                data = record(r["page_id"], r["url"], r["payload"], r["record_type"], r["refers_to"])
                if data[-1]:  # the size field ends so only from 16 MiB on; a short record follows then
                    data += _member([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:filler>"), ("WARC-Date", DATE)], b"")
                out.append(data[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(records: DataFrame, path: str, largest: int | None = None) -> None:
    """Archives under path, RECORDS_PER_FILE records each at most; records as from planned().

    largest is the size of the largest payload; archives hold fewer records where as many of it would pass
    BYTES_PER_FILE. It is looked up if it isn't given.

    Spark's text writer puts the bytes down as they are, so any file system that Spark writes to will do, and a task
    that is run again replaces its file.
    """
    if largest is None:
        largest = records.agg(F.max(F.octet_length("payload"))).first()[0]
    most = max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE // max(1, largest or 0)))
    members = records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


class BadRecord(ValueError):
    """An archive that breaks the format, or content that doesn't fit its digest."""


class Reader:
    """The records of an archive one after the other, from a stream of chunks; only one chunk and one record are held."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.left, self.offset = chunks, b"", 0

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, header fields in lower case, block) of each record."""
        while self.left or self._fill():
            yield self._record()

    def _fill(self) -> bool:
        self.left = next(self.chunks, b"")
        return bool(self.left)

    def _record(self) -> tuple[int, dict[str, str], bytes]:
        z, start, text, block, need = zlib.decompressobj(31), self.offset, bytearray(), bytearray(), None
        fields: dict[str, str] = {}
        while not z.eof:
            if not self.left and not self._fill():
                raise BadRecord(f"the archive ends within the record at {start}")
            given = self.left
            got = z.decompress(given, CHUNK)
            self.left = z.unused_data if z.eof else z.unconsumed_tail
            self.offset += len(given) - len(self.left)
            if need is not None:
                block += got
                continue
            text += got
            end = text.find(b"\r\n\r\n")
            if end >= 0:
                fields = self._fields(bytes(text[:end]), start)
                need, block = int(fields["content-length"]), text[end + 4 :]
        if need is None:
            raise BadRecord(f"no header in the record at {start}")
        if len(block) != need + 4 or block[need:] != b"\r\n\r\n":
            raise BadRecord(f"the record at {start} holds {len(block) - 4} bytes, not {need}")
        return start, fields, bytes(block[:need])

    @staticmethod
    def _fields(head: bytes, start: int) -> dict[str, str]:
        first, *rest = head.decode("utf-8").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise BadRecord(f"not a record at {start}")
        return fields


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, offset long"


def parsed(fields: dict[str, str], block: bytes) -> dict | None:
    """A response or revisit as a row, its digests verified; None for other kinds."""
    if fields.get("warc-type") not in ("response", "revisit"):
        return None
    if "warc-block-digest" in fields and _sha1(block) != fields["warc-block-digest"]:
        raise BadRecord(f"block digest of {fields['warc-record-id']}")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
    if fields["warc-type"] == "response" and (len(payload) != size or _sha1(payload) != fields["warc-payload-digest"]):
        raise BadRecord(f"payload of {fields['warc-record-id']}")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
        "url": fields.get("warc-target-uri"),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def _read(columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                view, name, rows = memoryview(content.as_buffer()), path.as_py(), []
                for offset, fields, block in Reader(bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK)):
                    if row := parsed(fields, block):
                        rows.append({k: v for k, v in (row | {"archive": name, "offset": offset}).items() if k in columns})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def load(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The responses and revisits of all archives under path; a record that fails a check stops the job."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    every = [tuple(x.split()) for x in _OUT.split(", ")]
    picked = [(n, t) for n, t in every if columns is None or n in columns]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(_read([n for n, _ in picked], pa.schema([(n, types[t]) for n, t in picked])), ", ".join(f"{n} {t}" for n, t in picked))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN t.top IS NOT NULL AND p.page_id IS DISTINCT FROM t.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM t.top THEN t.top END AS refers_to
FROM p LEFT JOIN t ON p.h = t.h
"""


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path, pages = scratch(spark, "warc"), read(spark, sf_dir, "pages")
    write(planned(pages), path, pages.agg(F.max(F.octet_length("html"))).first()[0])
    return load(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
