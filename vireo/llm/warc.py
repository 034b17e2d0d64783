"""WARC archives: whole-file gzip in, one gzip member per record and a sidecar offset index out.

``normalise`` inflates each archive once, as a stream, and rewrites every record as a member of its own, so that a
record can be read by offset. ``write_archives`` makes whole-file archives from a table; ``read_archives`` reads
records back through the index. Archives roll over at a size, so no file and no task grows with the input; a task
holds one record.
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

from .common import scratch, settled, table
from .files import fresh, reader, writer

GZIP, CHUNK = 31, 1 << 20
ID = "urn:page:"
#: ASCII that stands in a header as it is; blanks, controls, the per cent sign and all else are written as %XX.
URI = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")
MANIFEST = "path string, records long"
INDEXED = "path string, index_path string, records long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``refers_to``: the smallest page_id of an equal payload, if it is another.

    Only ids and digests are grouped, combined before the shuffle; payloads then meet their reference by page, so a
    payload that a third of the pages share makes no hot task.
    """
    at = pages.withColumn("digest", F.sha1("payload"))
    keys = at.where(F.octet_length("payload") >= min_payload).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).where(F.col("first").isNotNull())
    later = later.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return at.join(later, same, "left").select("page_id", "url", "payload", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit that keeps the HTTP header (so the payload's length) and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=URI)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Whole-file gzip archives of ``pages`` (page_id, url, payload, refers_to); one row per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pack, path, size, n = None, None, "", 0, 0

        def closed():
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    path = fresh(folder, "whole", ".warc.gz")
                    out, pack, size, n = writer(path), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                data = record(page_id, url, payload, refers_to)
                out.write(pack.compress(data))
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST)


class _Stream:
    """Inflates a file a bounded piece at a time, across members if there are several; ``at`` is how much of ``held`` is read."""

    def __init__(self, file) -> None:
        self.file, self.inflate, self.raw, self.held, self.at = file, zlib.decompressobj(GZIP), b"", b"", 0

    def _more(self) -> bool:
        """At most another ``CHUNK`` inflated bytes behind those not read yet."""
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data or self.raw, zlib.decompressobj(GZIP)
        self.raw = self.raw or self.file.read(CHUNK)
        new = self.inflate.decompress(self.raw, CHUNK)
        ended = not self.raw and not new
        self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
        if ended:
            return False
        self.held, self.at = self.held[self.at :] + new, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        seen = self.at
        while (end := self.held.find(mark, max(self.at, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends within a record header")
                return None
        got, self.at = self.held[self.at : end + len(mark)], end + len(mark)
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends within a record")
            got = self.held[self.at : self.at + n]
            self.at += len(got)
            n -= len(got)
            if got:
                yield got


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def normalise(manifest: DataFrame, folder: str, level: int = 2) -> DataFrame:
    """Each archive of ``manifest`` rewritten with a member per record, and its index: a line ``offset length id`` per record."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                to = fresh(folder, "records", ".warc.gz")
                offset, lines = 0, []
                with reader(path) as source, writer(to) as out:
                    stream = _Stream(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        head = head.lstrip(b"\r\n")
                        fields, pack = headers(head), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        made = out.write(pack.compress(head))
                        for part in stream.exactly(int(fields["content-length"]) + 4):
                            made += out.write(pack.compress(part))
                        made += out.write(pack.flush())
                        lines.append(f"{offset} {made} {fields['warc-record-id']}\n")
                        offset += made
                with writer(to + ".idx") as side:
                    side.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"path": [to], "index_path": [to + ".idx"], "records": [len(lines)]})

    return manifest.select("path").mapInArrow(rewrite, INDEXED)


def parsed(data: bytes) -> tuple:
    """The row of one record; a response's payload must have the digest that its header claims."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = headers(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(ID)) else None
    size = int(headers(http)["content-length"])
    refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
    return number(fields["warc-record-id"]), size, digest, kind, refers, unquote(fields["warc-target-uri"]), payload if kind == "response" else None


def read_archives(indexed: DataFrame, with_payload: bool = True, rows: int = 256) -> DataFrame:
    """Every record of the archives, found through the index; without payloads if they aren't wanted."""
    schema = ROWS if with_payload else ROWS.rpartition(", ")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))[: len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                with reader(index) as side:
                    spans = [tuple(map(int, line.split(b" ", 2)[:2])) for line in side.read().splitlines()]
                found = []
                with reader(path) as source:
                    for offset, length in spans:
                        source.seek(offset)
                        found.append(parsed(zlib.decompress(source.read(length), GZIP)))
                        if len(found) >= rows:
                            yield batch_of(found)
                            found = []
                if found:
                    yield batch_of(found)

    return indexed.select("path", "index_path").mapInArrow(read, schema)


def _dealt(files: DataFrame) -> DataFrame:
    """A row per file, dealt in turn: one task for a few archives."""
    return files.repartition(max(2, files.count() // 2))


def archive_pages(pages: DataFrame, folder: str, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` written to ``folder`` as normalised archives; one row (path, index_path, records) per archive.

    Null html is an empty payload, a null url an empty one, a null page_id no number. Of equal payloads of at least
    ``min_payload`` bytes the smallest page_id is the response; rows that repeat that id are responses too. If all ids of
    a payload are null, all are responses. An empty table gives no archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    whole = settled(write_archives(revisits(p, min_payload), f"{folder}/whole"), "warc-whole")
    return settled(normalise(_dealt(whole), f"{folder}/records"), "warc-records")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, as ``read_archives`` finds it in the archives of all pages."""
    archives = archive_pages(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    back = read_archives(_dealt(archives), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 in hexadecimal: five digits are four characters.
_FOUR = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * g + 1, 5))::INTEGER >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d
"""
