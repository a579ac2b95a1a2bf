import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from paxcast.llm import op6_warc

SCHEMA = "page_id long, url string, html string"
FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:78>\r\nContent-Length: 100000\r\n\r\n")
PAGES = [
    (1, "u1", "<p>one</p>"), (2, "u2", None), (3, "u3", ""), (4, "u4", "<p>one</p>"), (5, "u\r\n5", "WARC/1.1\r\n"),
    (6, "u6", "x" + FAKE + "y"), (7, None, FAKE), (8, "u8", "é漢🙂\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u9", "WARC/1.1"), (10, "u10", FAKE * 50),
    (11, "u11", "long " * 30000), (12, "u12", "x" + FAKE + "y"), (13, "u13", "\r\n\r\n"), (14, "u14", "\n"), (15, "u15", "end\r\n"),
    (-5, "u-5", "\r\n\r\n"),
]


def want(pages):
    first = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        again = page_id > first[body]
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first[body] if again else None))
    return sorted(out)


@pytest.mark.parametrize("split", ["64", "257", "4096", "128m"])
def test_chain_survives_any_split(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    pages = spark.createDataFrame(PAGES[:9] if split == "64" else PAGES, SCHEMA).repartition(2)
    try:
        if split == "64":
            pages = pages.withColumn("html", F.substring("html", 1, 300))
        data = [(r.page_id, r.url, r.html) for r in pages.collect()]
        spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "257" else "1031")
        got = sorted(tuple(r) for r in op6_warc.archive_and_read(pages).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == want(data)


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted(tuple(r) for r in op6_warc.archive_and_read(pages).collect())
    assert got == want([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_ties_null_ids_extra_columns_empty(spark):
    pages = spark.createDataFrame([(1, "a", "t"), (1, "a", "t"), (None, "b", "t"), (3, "c", "t")], SCHEMA).withColumn("digest", F.lit(1))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in op6_warc.archive_and_read(pages).collect())
    assert got == [(0, "response", None), (1, "response", None), (1, "response", None), (3, "revisit", 1)]
    assert op6_warc.archive_and_read(pages.limit(0)).count() == 0
