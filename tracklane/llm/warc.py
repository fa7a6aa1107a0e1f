"""WARC archives with repeated payloads resolved to revisit records.

Headers alone (page and payload digest) are shuffled by digest and reduced to the
least page of each; those of the other pages are revisits.  They are joined back to
the pages, whose payloads stay where they were read as long as the revisits are few
enough to be sent there, and every page is written as a record with fresh headers:
the first of equal payloads as a response, the others as revisits that refer to it.
Archives hold one gzip member a record, so that they are read record by record and
any record can be read by itself; see ``files`` for how they are committed.

Input: columns page_id (integer), url and html; others are ignored.  A null html
is an empty payload, a null url an empty target.  A page with a null page_id is
always a response.  Repeated rows of a page_id are written each, and each by its
own payload.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch, spread_join
from .files import ManifestWriter, Written, filesystem, manifest

#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes after which a task begins another archive.
FILE_BYTES = 1 << 28
#: Revisits that are sent to all tasks at most (some 70 MB).
SENT = 500_000


def _digest(hexadecimal: str) -> F.Column:
    """Base32 of a SHA-1 in hexadecimal, five digits (four letters) at a time."""
    return F.expr(
        f"array_join(transform(sequence(0, 31), i -> substr('{BASE32}', (shiftright(cast(conv(substr({hexadecimal}, 5 * (i div 4) + 1, 5), 16, 10) AS int), 15 - 5 * (i % 4)) & 31) + 1, 1)), '')"
    )


def _urn(page: str) -> F.Column:
    """A record's id, by its page and payload."""
    name = F.md5(F.concat_ws(":", F.lit("page"), F.col(page).cast("string"), "sha1"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Write the archives; payloads of fewer than ``least`` bytes are never revisits."""
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    scratch = Scratch(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1("html"))
    headers = scratch.put(rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", "sha1"), "headers")
    firsts = scratch.put(headers.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    revisits = spread_join(headers, firsts.drop("n"), "sha1", "page_id", headers.count(), firsts.select("sha1", "n")).where("page_id <> first").distinct()
    revisits = scratch.put(revisits, "revisits")
    rows = rows.join(F.broadcast(revisits) if revisits.count() <= SENT else revisits, ["page_id", "sha1"], "left").withColumn("revisit", F.col("first").isNotNull())
    block = F.concat(F.lit(HTTP), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        line("WARC-Record-ID", _urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _digest("sha1"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _urn("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )
    rows.select(record.alias("record")).write.format("warc").mode("append").save(path)
    for name in ("headers", "firsts", "revisits"):
        scratch.drop(name)


_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {k.decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data, at, end)}
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def members(file, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    unzip, parts = zlib.decompressobj(31), []
    while data := file.read(step):
        while data:
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


NAMES = ("record_id", "page_id", "record_type", "target", "payload_digest", "refers_to", "payload")
KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
RECORDS = "record_id string, page_id long, record_type string, target string, payload_digest string, refers_to string, payload binary"


def records(file) -> Iterator[pa.RecordBatch]:
    """The records of an archive, some thousand or some megabytes at once."""
    rows: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    for head, block in (record for member in members(file) for record in parse(member)):
        revisit = head["WARC-Type"] == "revisit"
        payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
        page = head.get("X-Page-ID")
        rows.append((head["WARC-Record-ID"], page and int(page), head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To"), payload))
        size += len(block)
        if len(rows) == 2000 or size > 1 << 23:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


class _WarcWriter(ManifestWriter):
    suffix = ".warc.gz"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, at, n = [], None, 0, 0
        for batch in iterator:
            for record in batch["record"]:
                if out is None:
                    name, out = self.create()
                    at = n = 0
                zipped = zlib.compress(record.as_buffer(), 6, wbits=31)
                out.write(zipped)
                at, n = at + len(zipped), n + 1
                if at >= FILE_BYTES:
                    out.close()
                    files.append((name, n))
                    out = None
        if out is not None:
            out.close()
            files.append((name, n))
        return self.written(files)


class _WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name, _ in manifest(self.path)] or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if part.value:
            fs, root = filesystem(self.path)
            with fs.open_input_file(f"{root}/{part.value}") as file:
                yield from records(file)


class Warc(DataSource):
    """``format("warc")``: writes a column ``record`` of whole records, reads their fields; option: path."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite: bool) -> _WarcWriter:
        return _WarcWriter(self.options)

    def reader(self, schema) -> _WarcReader:
        return _WarcReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the committed archives under ``path``; a revisit has no payload of its own."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").load(path)


def resolve_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back and resolve each revisit: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "revisits")
    path = scratch.path("archives")
    write_archives(pages, path, least=least)
    small = read_archives(pages.sparkSession, path).select("record_id", "page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"))
    small = scratch.put(small, "records")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = small.where("record_type = 'response'")
    originals = responses.where("page_id IS NOT NULL").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("full")).distinct()
    revisits = small.where("record_type = 'revisit'")
    resolved = spread_join(revisits, originals, "refers_to", "page_id", revisits.count()).withColumns({"payload_bytes": F.col("full"), "refers_to": F.col("original")})
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(resolved.select(*columns))
