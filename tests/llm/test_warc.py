"""The archive: payloads once, records put together again, and what is damaged is found."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

BIG = "x" * 1500
ROWS = [(1, "http://a", BIG), (2, None, BIG), (2, "http://b", BIG), (3, "http://c", "small"), (4, "http://d\r\n", "small"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (None, "n", BIG), (7, "\u00e9", "\u00e9\n" * 400_000)]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as header", "3 as payload", "4 as record", "5 as `a.b`")
    return warc.write_archive(pages)


def test_round_trip(spark, archive):
    found = warc.read_archive(spark, archive).collect()
    assert sorted(map(str, (r.page_id for r in found))) == sorted(map(str, (r[0] for r in ROWS)))
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in found:
        payload = html[r.page_id]
        revisit = payload == BIG.encode() and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == (b"" if revisit else payload) + b"\r\n\r\n"
        assert f"Content-Length: {len(rest) - 4}".encode() in head and head.startswith(b"WARC/1.1\r\n")
    stored = [gzip.decompress(r.payload) for r in spark.read.parquet(f"{archive}/kind=payload").collect()]
    assert sorted(stored) == sorted(set(html.values()))


@pytest.mark.parametrize("change", [("Content-Length: 1500", "Content-Length: 1499"), ("sha1:", "sha1:0")])
def test_damaged_headers_are_found(spark, archive, tmp_path, change):
    broken = f"file://{tmp_path}"
    spark.read.parquet(f"{archive}/kind=payload").write.parquet(f"{broken}/kind=payload")
    text = F.replace(F.decode("header", "utf-8"), F.lit(change[0]), F.lit(change[1]))
    spark.read.parquet(f"{archive}/kind=header").select("key", F.encode(text, "utf-8").alias("header")).write.parquet(f"{broken}/kind=header")
    with pytest.raises(Exception, match="wrong"):
        warc.read_archive(spark, broken).collect()


def test_empty(spark):
    assert warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
