import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ballast.functions.durable import scratch
from ballast.llm import warc

BIG = "é" * 600
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a\r\nX: y", "small"), (4, None, "small"), (5, "http://a/5", None), (6, "", ""), (2, "http://a/again", BIG), (None, "http://a/none", BIG), (7, "http://a/7", "WARC/1.1\r\n\r\n" + "z" * 1000)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def test_records_come_back(spark):
    path = scratch(spark, "warc")
    warc.write_archive(pages(spark).withColumn("payload", F.lit("clash")).withColumn("digest", F.lit("clash")), path)
    got = [(r.header, bytes(r.record)) for r in warc.read_archive(spark, path).collect()]
    assert len(got) == len(ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    kinds, blocks = {}, []
    for header, record in got:
        assert record.startswith(header.encode()) and record.endswith(b"\r\n\r\n") and header.count("\r\n\r\n") == 1
        block = record[len(header.encode()) : -4]
        kind = header.split("\r\n")[1]
        if kind.endswith("response"):
            blocks.append(block)
            assert f"sha1:{hashlib.sha1(block).hexdigest()}" in header
        kinds[header.split("urn:page:")[1].split(">")[0], "revisit" in kind] = block
    assert kinds["1", True] == b"" and kinds["", True] == b"" and kinds["2", False] == BIG.encode()
    assert ("3", False) in kinds and ("4", False) in kinds and ("5", False) in kinds
    assert set(blocks) == {(h or "").encode() for *_, h in ROWS}


def test_parsed_from_the_bytes(spark):
    path = scratch(spark, "warc")
    warc.write_archive(pages(spark), path)
    got = warc.parsed(warc.read_archive(spark, path).select("record")).collect()
    bodies = {d: (h or "").encode() for d, _, h in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id in (1, None) else ("response", None))


def test_damage_is_found(spark):
    path = scratch(spark, "warc")
    warc.write_archive(pages(spark), path)
    stored = spark.read.parquet(f"{path}/payloads")
    stored.selectExpr("digest", "encode(concat('!', decode(payload, 'UTF-8')), 'UTF-8') payload").write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.read_archive(spark, f"{path}-2").collect()


def test_no_rows(spark):
    path = scratch(spark, "warc")
    warc.write_archive(pages(spark).where("false"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_urls_come_back(spark):
    urls = [None, "", "http://a/b", "http://a/%20b", "http://a/ b", "http://a/\tb", "http://a/\nb", "http://a/\r\nX-Payload-Length: 3", "\x00\x7f é 日 %", " ", "http://a/" + "long " * 300]
    path = scratch(spark, "warc")
    warc.write_archive(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    records = warc.read_archive(spark, path).collect()
    assert all(r.header.count("\r\n\r\n") == 1 and "\t" not in r.header and "\n" not in r.header.replace("\r\n", "") for r in records)
    got = {r.page_id: r.url for r in warc.parsed(warc.read_archive(spark, path).select("record")).collect()}
    assert got == {i: u or None for i, u in enumerate(urls)}
    heads = {r.header.split("urn:page:")[1].split(">")[0]: r.header for r in records}
    assert "WARC-Target-URI: http://a/%09b" in heads["5"] and "WARC-Target-URI: http://a/%0Ab" in heads["6"] and "Base64" not in heads["3"]


def test_large_payload(spark):
    path = scratch(spark, "warc")
    big = spark.range(3).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789abcdef', 1000000) AS html")  # 16 MB, three times
    warc.write_archive(big, path)
    got = sorted(warc.parsed(warc.read_archive(spark, path).select("record")).collect())
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got] == [("revisit", 2, 16_000_000)] * 2 + [("response", None, 16_000_000)]
