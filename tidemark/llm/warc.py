"""A content-addressed WARC archive.

The archive is two tables in one folder: ``kind=payload`` holds every distinct
payload once, gzip-compressed, under the SHA-256 of its bytes; ``kind=header``
holds every record's exact header bytes and that key. A record is its header, a
payload joined by key if it is a response, and the closing line ends. Which record
is the response is decided on narrow columns.

Of the records with one payload of at least ``REVISIT_BYTES`` bytes, that with
the largest ``page_id`` is the response and the others are revisits of it, without
a payload of their own. On reading, every stored payload is hashed again and must
match its key, and every record is put together and held against its header.

Results in special cases: a null html is an empty payload, and so always a
response; rows that repeat the response's ``page_id`` are responses too (of one
stored payload); a row
with a null ``page_id`` is a revisit where its group has a row with one, else a
response; a null url gives a record without target; an empty table gives an
empty archive; other columns play no part.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path, ship_package

REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Bytes of payloads in one batch that goes out.
BATCH_BYTES = 8_000_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload as a gzip member."""
    for batch in batches:
        names = [*batch.schema.names[:-1], "payload"]
        begin, size, made = 0, 0, []
        for i, html in enumerate(batch.column("html")):
            data = html.as_py().encode("utf-8", "surrogatepass")
            made.append(gzip.compress(data, 6, mtime=0))
            size += len(data)
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                part = batch.slice(begin, i + 1 - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], names=names)
                begin, size, made = i + 1, 0, []


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def _page(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(date: str) -> Column:
    """The exact header of a record from page_id, url, n_bytes, sha1, revisit and response_id."""
    url = F.regexp_replace(F.col("url"), "[\r\n]", "%0A")
    return F.concat(
        F.lit(VERSION),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _page(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        F.coalesce(_field("WARC-Target-URI", url), F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", _page(F.col("response_id"))))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record for every page; the archive's path."""
    spark = pages.sparkSession
    ship_package(spark)
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(html, 256).alias("key"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n_bytes"), html.alias("html"))
    # Equal payloads meet within a task first, so a very common one is shuffled once a task.
    payloads = keyed.groupBy("key").agg(F.min("html").alias("html"))
    payloads.mapInArrow(_packed, "key string, payload binary").write.parquet(f"{path}/kind=payload")
    records = keyed.select("page_id", "url", "key", "sha1", "n_bytes")
    responses = records.groupBy("key").agg(F.max("page_id").alias("response_id"))
    own = F.col("page_id").eqNullSafe(F.col("response_id"))
    headed = records.join(responses, "key").withColumn("revisit", ~own & (F.col("n_bytes") >= REVISIT_BYTES))
    headed.select("key", F.encode(header(date), "utf-8").alias("header")).write.parquet(f"{path}/kind=header")
    return path


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored payloads, unpacked; a payload that doesn't match its key is an error."""
    for batch in batches:
        keys, out, size = [], [], 0
        for key, data in zip(batch.column("key"), batch.column("payload"), strict=True):
            payload = gzip.decompress(data.as_py())
            if hashlib.sha256(payload).hexdigest() != key.as_py():
                raise ValueError(f"payload {key} is damaged")
            keys.append(key.as_py())
            out.append(payload)
            size += len(payload)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out, pa.binary())], names=["key", "payload"])
                keys, out, size = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out, pa.binary())], names=["key", "payload"])


def _checked(value: Column, holds: Column, what: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.concat(F.lit(f"{what} of record "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, record_type, refers_to, payload_bytes, payload_digest and record.

    ``record`` is the whole record as it stands in a WARC file. Its length must be what its header says, and its
    payload's digest (of a revisit: that of the response's payload) the one in the header.
    """
    ship_package(spark)
    headers = spark.read.schema("key string, header binary").parquet(f"{path}/kind=header")
    stored = spark.read.schema("key string, payload binary").parquet(f"{path}/kind=payload").mapInArrow(_verified, "key string, payload binary")
    facts = stored.select("key", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("stored_digest"))
    of = lambda name, form: F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: {form}\r\n", 1)
    page = lambda value: F.expr("try_cast(nullif(" + value + ", 'none') as long)")
    parsed = headers.select(
        "key", "header",
        of("WARC-Type", "([a-z]+)").alias("record_type"),
        F.regexp_extract(F.decode("header", "utf-8"), "WARC-Record-ID: <urn:page:([^>]*)>", 1).alias("id"),
        F.regexp_extract(F.decode("header", "utf-8"), "WARC-Refers-To: <urn:page:([^>]*)>", 1).alias("refers"),
        of("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("header_digest"),
        of("Content-Length", "([0-9]+)").cast("long").alias("length"),
    )
    found = parsed.withColumns({"page_id": page("id"), "refers_to": page("refers")}).join(facts, "key", "left")
    is_response = F.col("record_type") == "response"
    body = F.when(is_response, F.col("payload")).otherwise(F.lit(b""))
    joined = found.withColumn("record", F.concat(F.col("header"), body, F.lit(END.encode())))
    begin = F.octet_length("header")
    held = F.when(is_response, F.substring("record", begin + 1, F.col("length").cast("int")))
    read = joined.withColumn("held_digest", F.when(is_response, F.sha1(held)).otherwise(F.col("stored_digest")))
    whole = F.octet_length("record") == begin + F.col("length") + len(END)
    return read.select(
        "page_id", "record_type", "refers_to", "payload_bytes",
        _checked(F.col("held_digest"), F.col("held_digest") == F.col("header_digest"), "wrong payload digest").alias("payload_digest"),
        _checked(F.col("record"), whole, "wrong length").alias("record"),
    )
