"""WARC archives with revisit records.

Payload digests are taken where the pages are read; headers alone (digest, id, URL) are shuffled, and a digest that occurs
more than once names its response: the record with the largest id. The records of the others become revisits, which carry
headers only and refer to the response. Archives are written by Spark's own writer into any file system that Spark knows:
WARC/1.1 records end in two line breaks, so a text file with that separator is an archive (gzipped as a whole). Reading
inflates archives piece by piece, so a task holds a compressed archive and one record; it checks lengths and digests, and joins
each revisit to its response by digest. One digest (of empty pages, say) may hold much of the table: rows are told apart by digest
and id before the joins on a digest, which adaptive execution can therefore split.

A null payload is an empty one, a null URL an empty one; line breaks and spaces in URLs are percent-encoded. Payloads of any
length are kept whole. Payloads shorter than `min_bytes` are always written as responses. Rows that repeat both id and
payload are each written, with the type and reference that the row would have alone. Rows without an id are responses, and
nothing refers to them. An empty table gives an empty archive and an empty result. Columns other than id, URL and payload are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHAPE = "record_id string, record_type string, id {kind}, url string, digest string, refers_to_record string, content_length long, payload_bytes long"


def base32_of(hex40: F.Column) -> F.Column:
    """The upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits are four of base32."""
    out = []
    for at in range(1, 41, 5):
        v = F.conv(F.substring(hex40, at, 5), 16, 10).cast("int")
        out += [F.lit(BASE32).substr(F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def urn(id_: F.Column, digest: F.Column) -> F.Column:
    """A record's id: a UUID (in form) of its row id and payload digest."""
    h = F.md5(F.concat_ws("/", id_.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload, digest, bytes, and of revisits the response's id and url (target_id, target_url)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    for c in ("\r", "\n", "\t", " "):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    heads = written(rows.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest", "id").agg(F.max("url").alias("url")), "warc-heads")
    shared = heads.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("target"), F.min("id").alias("least")).where("least < target.id")
    shared = written(shared.select("digest", F.col("target.id").alias("target_id"), F.col("target.url").alias("target_url")), "warc-shared")
    revisits = written(heads.select("digest", "id").join(shared, "digest").where("id != target_id"), "warc-revisits")
    return rows.join(revisits, ["digest", "id"], "left")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_a_file: int = 5000) -> None:
    rows = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    revisit = F.col("target_id").isNotNull()
    digest = base32_of(F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(BREAK * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def line(name: str, *value: F.Column | str) -> F.Column:
        return F.concat(F.lit(f"{name}: "), *(v if isinstance(v, F.Column) else F.lit(v) for v in value), F.lit(BREAK))

    record = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"), F.col("digest"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Row-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", "sha1:", digest),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", urn(F.col("target_id"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.col("target_url")), line("WARC-Refers-To-Date", date))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", length.cast("string")),
        F.lit(BREAK),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's contents, some `size` bytes at a time; of several members, one after the other."""
    at = 0
    while at < len(data):
        z, fed = zlib.decompressobj(31), memoryview(data)[at:]
        while not z.eof:
            out = z.decompress(fed, size)
            if not out and not z.unconsumed_tail and not z.eof:
                raise ValueError("an archive is cut short")
            yield out
            fed = z.unconsumed_tail
        at = len(data) - len(z.unused_data)
        if not z.unused_data:
            break


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive that comes in parts."""
    held, parts = bytearray(), iter(parts)

    def need(n: int) -> bool:
        """Whether n bytes are held, after taking what that needs."""
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while need(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            before = len(held)
            if not need(before + 1):
                raise ValueError("a record's headers are cut short")
            end = held.find(b"\r\n\r\n", max(0, before - 3))
        first, *lines = bytes(held[:end]).decode().split(BREAK)
        if not re.fullmatch(r"WARC/1\.\d", first):
            raise ValueError("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        if not need(end + 8 + size) or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield head, block


def read_archives(spark: SparkSession, path: str, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """One row a record (and its payload, if payloads); payload_bytes is that of the payload in the record."""
    integer = id_type in ("int", "bigint", "long", "smallint", "tinyint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("id", pa.int64() if integer else pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to_record", pa.string()), ("content_length", pa.int64()), ("payload_bytes", pa.int64()), *([("payload", pa.binary())] if payloads else [])])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        for b in batches:
            for (content,) in zip(b.column(0), strict=True):
                rows, held = [], 0
                for head, block in parse(inflated(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {head['warc-record-id']}: its payload does not have its digest")
                    own = head["warc-row-id"]
                    rows.append((head["warc-record-id"], head["warc-type"], (int(own) if integer else own) if own else None, head["warc-target-uri"], digest, head.get("warc-refers-to"), len(block), len(payload), *([payload] if payloads else [])))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 2000 or held > 32 << 20:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    shape = SHAPE.format(kind="long" if integer else "string") + ", payload binary" * payloads
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, shape)


def resolve(records: DataFrame) -> DataFrame:
    """records (cheap to read twice), each revisit with its response's id (refers_to) and payload size."""
    responses = records.where("record_type = 'response'").select("digest", F.col("record_id").alias("target"), F.col("id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    responses = written(responses.dropDuplicates(["digest", "target"]), "warc-responses")
    revisit = F.col("record_type") == "revisit"
    joined = records.withColumn("target", F.col("refers_to_record")).join(responses, ["digest", "target"], "left")
    return joined.select("id", F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(written(read_archives(spark, path), "warc-records")).withColumnRenamed("id", "page_id")


SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), h AS (SELECT page_id, strlen(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM r),
d AS (SELECT *, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM h),
t AS (SELECT payload_digest, max(page_id) AS target FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to FROM d JOIN t USING (payload_digest)
"""
