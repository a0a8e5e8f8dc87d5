"""Web archives: one record a page, equal payloads stored once and revisited, read back and resolved."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.session import staged

_LINE = "\r\n"
# A record ends with two line breaks: the writer puts them after each row.
_END = _LINE * 2
_HTTP = f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}{_LINE}"
# Rows of one key are dealt to so many parts.
_SALTS = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    """A URN that page and payload decide."""
    name = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, digest, original: the pages whose payload another page of a smaller id holds.

    Headers alone are shuffled by digest.  The ids of a digest are reduced in each task before the shuffle; only digests that
    occur again go on, a row each, and meet the pages over salts, so a payload that many pages share is no hot group.
    """
    heads = staged(_headers(pages).select("page_id", "digest", "payload_bytes")).filter(F.col("payload_bytes") >= least_bytes)
    first = heads.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null")
    joined = _met(heads.select("page_id", "digest"), F.col("page_id"), first.select("digest", "original"), "digest")
    return joined.filter(~F.col("page_id").eqNullSafe(F.col("original"))).distinct()


def _met(many: DataFrame, salt: Column, few: DataFrame, key: str) -> DataFrame:
    """Inner join of ``many`` with ``few``, of one row for a key, over salts of ``many``."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(_SALTS)).cast("int"))
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def records(pages: DataFrame, date: str, least_bytes: int, files: int) -> DataFrame:
    """value: the text of a record without its end, with fresh headers, dealt to ``files`` partitions."""
    key = _record_id(F.col("page_id"), F.col("digest"))
    again = staged(resolve(pages, least_bytes)).select(key.alias("_key"), "original")
    # Payloads move once: the join keeps how they are dealt.
    joined = _headers(pages).withColumn("_key", key).repartition(files, "_key").join(again, "_key", "left")
    revisit = F.col("original").isNotNull()
    # A target is one line of visible characters.
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    lines = F.concat_ws(
        _LINE,
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(lines, F.lit(_END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-31T00:00:00Z", least_bytes: int = 100, file_bytes: int = 64 << 20) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) as gzipped archives of about ``file_bytes`` payload.

    Of rows with equal payloads of at least ``least_bytes``, that of the smallest page_id is the response, the others
    revisit it; shorter payloads are all responses.  Null html is an empty payload.  Rows that repeat a page_id and its
    payload are alike: all responses or all revisits.  A null page_id is larger than all others; such rows revisit one
    with an id, but never each other.  The files are Spark's text files with CRLF CRLF after each row, which is what ends
    a record, so they need no store but Spark's own.
    """
    size = pages.agg(F.sum(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("long"))).first()[0] or 0
    files = max(1, -(-size // file_bytes), pages.sparkSession.sparkContext.defaultParallelism if size > file_bytes else 1)
    records(pages, date, least_bytes, files).write.option("lineSep", _END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield head, view[start:stop]
        at = stop + 4


def _read_batches(with_payload: bool):
    def row(head, block):
        body = bytes(block)
        _, _, payload = body.partition(b"\r\n\r\n")
        page = head.get("x-page-id")
        return (
            int(page) if page is not None else None,
            head["warc-record-id"],
            head["warc-type"],
            head.get("warc-refers-to"),
            head["warc-target-uri"],
            head["warc-payload-digest"].removeprefix("sha256:"),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            payload if with_payload and head["warc-type"] == "response" else None,
        )

    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_id", "record_type", "refers_to_id", "url", "digest", "block_payload_bytes", "block_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(row(head, block))
                    size += len(block)
                    if size > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record, as measured: ``block_payload_bytes`` and ``block_digest`` are of the bytes that are there."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    schema = (
        "page_id long, record_id string, record_type string, refers_to_id string, url string, digest string, "
        "block_payload_bytes long, block_digest string, payload binary"
    )
    return files.mapInArrow(_read_batches(with_payload), schema)


def resolved(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take what their response holds.

    Responses pass through.  Revisits meet the responses that are asked for, a row each, over salts, so neither a response
    that many pages revisit nor the responses themselves are a hot group.  A revisit whose response is in no archive has nulls.
    """
    own = read.filter("record_type = 'response'")
    again = read.filter("record_type <> 'response'").select("page_id", "record_type", F.col("refers_to_id").alias("record_id"))
    wanted = again.select("record_id").distinct()
    held = own.join(wanted, "record_id", "left_semi").dropDuplicates(["record_id"])
    held = held.select("record_id", "block_payload_bytes", "block_digest", F.col("page_id").alias("_page"))
    # Asked ids without a response stay, as rows of nulls.
    asked = wanted.join(held, "record_id", "left")
    # A null id meets nothing.
    lost = again.filter("record_id is null").select(
        "page_id", F.lit(None).cast("long"), F.lit(None).cast("string"), "record_type", F.lit(None).cast("long")
    )
    met = _met(again, F.col("page_id"), asked.filter("record_id is not null"), "record_id")
    named = met.select(
        "page_id",
        F.col("block_payload_bytes").alias("payload_bytes"),
        F.col("block_digest").alias("payload_digest"),
        "record_type",
        F.col("_page").alias("refers_to"),
    )
    plain = own.select(
        "page_id", F.col("block_payload_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    return plain.union(named).union(lost)
