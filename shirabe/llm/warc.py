"""WARC archives with revisit records.

Pages are written as WARC 1.1 records whose payload is the page's HTML in UTF-8. Headers (page and payload digest, no
payload) are shuffled by digest; of equal payloads the page with the smallest id is the response and the others become
revisit records, with fresh headers that refer to it. Only digests that occur more than once take part in the join, by
broadcast while their number is bounded. Spark's own writer puts the records into gzip archives, the end of a record
being the line separator, so that writing is distributed, committed and safe from lost executors.

Reading streams an archive line by line through a parser that counts bytes by Content-Length, whatever the payload holds;
a task's memory is bound by one record. Revisit records are then resolved: their headers are shuffled by payload digest
and joined to the original responses, hot digests by broadcast.

Defined results: a null payload is the empty one; payloads of less than `min_bytes` bytes are never revisited; rows
without page id never become the response while a row with an id has the same payload (if none has, each is a response); rows
that repeat the smallest page id of a payload are all responses; a null url has no target header; line ends in urls are
percent-encoded; a revisit record whose original is in no archive has no payload size; an empty table gives empty
archives and no rows; other columns are ignored. A record that is cut short or malformed raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, folder, join_counted, scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Digests that go by broadcast (some 100 bytes each); more go by a shuffle, hot ones still by broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of records that the parser hands on at once.
BATCH_BYTES = 4 << 20
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 20 bits, or 4 letters, of every five hexadecimal digits."""
    hexed = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0"), _HEX32, _BASE32) for i in range(1, 41, 5)))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end; headers of null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{name}: "), value) for name, value in headers), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"))))
    return F.concat(F.lit("<urn:uuid:"), *(F.concat(F.substring(h, a, n), F.lit("-" if a < 21 else "")) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """A record a row of pages(page_id, url, html) in gzip archives below path, equal payloads once."""
    with scratch():
        html = F.coalesce("html", F.lit(""))
        url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        rows = pages.select("page_id", url.alias("url"), html.alias("html")).withColumn("digest", payload_digest(F.col("html")))
        headers = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "digest")
        first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
        groups = headers.groupBy("digest").agg(F.count("*").alias("copies"), first.alias("o")).where("copies > 1 and o.page_id is not null")
        originals = cut(groups.select("digest", "copies", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")))
        if originals.count() <= BROADCAST_ROWS:
            whole = rows.join(F.broadcast(originals), "digest", "left")
        else:
            alone = rows.join(originals, "digest", "left_anti")
            whole = join_counted(rows, originals, ["digest"], "copies").unionByName(alone, allowMissingColumns=True)
        long_enough = F.octet_length("html") >= min_bytes
        revisits = F.coalesce(long_enough & F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("original"))), F.lit(False))
        whole = whole.withColumn("revisits", revisits)
        only = lambda c: F.when(F.col("revisits"), c)
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
        record = _record(
            F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response")),
            [
                ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
                ("WARC-Date", F.lit(date)),
                ("WARC-Target-URI", F.col("url")),
                ("Page-Id", F.col("page_id").cast("string")),
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Profile", only(F.lit(PROFILE))),
                ("WARC-Refers-To", only(_record_id(F.col("original"), F.col("original_url"), F.col("digest")))),
                ("WARC-Refers-To-Target-URI", only(F.col("original_url"))),
                ("WARC-Refers-To-Date", only(F.lit(date))),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.when(F.col("revisits"), http).otherwise(F.concat(http, F.col("html"))),
        )
        whole.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


@dataclass
class Parser:
    """Records of one archive, from its lines without their line feeds; counts bytes, so that payloads may hold anything."""

    source: str
    headers: list[bytes] = field(default_factory=list)
    block: list[bytes] = field(default_factory=list)
    left: int | None = None  # bytes of the block and its end that are still to come; None within headers

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """The record that ends with this line."""
        if self.left is None:
            if line != b"\r":
                self.headers.append(line)
                return None
            if not self.headers or not self.headers[0].startswith(b"WARC/"):
                raise ValueError(f"{self.source}: no WARC record where one should begin")
            self.left = int(self._named().get("content-length", "-1")) + len(END)
            if self.left < len(END):
                raise ValueError(f"{self.source}: a record without Content-Length")
            return None
        self.block.append(line)
        self.left -= len(line) + 1
        if self.left > 0:
            return None
        whole = b"\n".join(self.block) + b"\n"
        if self.left < 0 or not whole.endswith(END.encode()):
            raise ValueError(f"{self.source}: a record does not end where its Content-Length says")
        out = self._named(), whole[: -len(END)]
        self.headers, self.block, self.left = [], [], None
        return out

    def _named(self) -> dict[str, str]:
        pairs = (h.decode().rstrip("\r").partition(":") for h in self.headers[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    def close(self) -> None:
        if self.headers or self.left is not None:
            raise ValueError(f"{self.source}: the last record is cut short")


def base32_sha1(payload: bytes) -> str:
    from base64 import b32encode

    return b32encode(sha1(payload).digest()).decode()


RECORD = "record_id string, record_type string, page_id long, url string, date string, declared_digest string, payload_digest string, payload_bytes long, refers_to_id string, payload string"


def _row(named: dict[str, str], block: bytes, payload: bool) -> tuple:
    body = block.partition(END.encode())[2] if named.get("content-type", "").startswith("application/http") else block
    kind = named.get("warc-type")
    full = kind != "revisit"
    declared = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page = named.get("page-id")
    return (named.get("warc-record-id"), kind, int(page) if page else None, named.get("warc-target-uri"), named.get("warc-date"), declared, base32_sha1(body) if full else None, len(body) if full else None, named.get("warc-refers-to"), body.decode() if payload and full else None)


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every record of the gzip archives below path; size and digest of the payloads that are there are the read bytes'."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        parser, rows, size = None, [], 0
        for batch in batches:  # an archive is one split, its lines are in order
            files = batch.column("file").dictionary_encode()
            for line, k in zip(batch.column("value").cast(pa.binary()).to_pylist(), files.indices.to_pylist(), strict=True):
                source = files.dictionary[k].as_py() if parser is None or k != last else parser.source
                last = k
                if parser is None or parser.source != source:
                    if parser is not None:
                        parser.close()
                    parser = Parser(source)
                done = parser.feed(line)
                if done:
                    rows.append(_row(*done, payload))
                    size += 500 + len(done[1]) * payload
                    if size > BATCH_BYTES:
                        yield give(rows)
                        rows, size = [], 0
            last = None  # of the next batch's own dictionary
        if parser is not None:
            parser.close()
        if rows:
            yield give(rows)

    return lines.mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records, a written table, with size and digest of the full payload and, for revisits, the page referred to."""
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    asked = revisits.groupBy("declared_digest").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "payload_bytes"))
    found = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("declared_digest")).agg(first.alias("o"))
    found = cut(asked.join(found, "declared_digest", "left").select("declared_digest", "copies", F.col("o.payload_bytes").alias("payload_bytes"), F.col("o.page_id").alias("refers_to")))
    full = join_counted(revisits, found, ["declared_digest"], "copies").withColumn("payload_digest", F.col("declared_digest")).drop("copies")
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(full)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from archives of them."""
    spark = pages.sparkSession
    with scratch() as keep:
        path = folder(spark)
        write_archives(pages, path, min_bytes)
        records = cut(read_records(spark, path).drop("payload"))
        delete(spark, path)
        return keep(resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
