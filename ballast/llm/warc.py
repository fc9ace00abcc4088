"""A content-addressed WARC archive.

The archive is two tables in a shared folder: ``payloads`` holds each distinct payload once under its SHA-256, and ``headers``
the exact header block of each record with that digest. Records are rebuilt by joining the two and verified on the way: the payload read back must
have the digest it is filed under and the length and SHA-1 that its header names.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the largest id is the
response and the others are revisits that refer to it; a revisit's record has no block. Smaller ones are all
responses. A null payload is empty; repeated ids are records of their own. A null id cannot be referred to, and is a revisit wherever a named equal exists. Blanks and control
characters in URLs are percent-encoded by their own numbers, so no header can be broken up; such a URL stands in a header of its own too, in base64, from which it is read back. A null or empty URL is read back as null. Very large payloads are bounded by a row (2 GB). Other columns play no part. No rows make an empty archive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut, scratch, written

LEAST_REVISIT = 1000
_EOL = "\r\n"


def _header(kind: Column) -> Column:
    """The exact header block of a record, up to and including its empty line."""
    odd = F.coalesce(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.lit(False))
    url = F.when(odd, reduce(lambda x, c: F.replace(x, F.lit(chr(c)), F.lit(f"%{c:02X}")), (*range(33), 127), F.col("url"))).otherwise(F.coalesce("url", F.lit("")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(odd, F.concat(F.lit("X-Target-URI-Base64: "), F.replace(F.base64(F.encode("url", "UTF-8")), F.lit(_EOL), F.lit("")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes").cast("string")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("owner").cast("string"), F.lit(">"))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL + _EOL))


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = LEAST_REVISIT) -> None:
    """Files ``pages`` under ``path``."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    light = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("digest"))
    seen = F.struct("n_bytes", "sha1")
    owners = light.groupBy("digest").agg(F.max("page_id").alias("owner"), (F.min(seen) == F.max(seen)).alias("alike"))
    owned = light.join(apart(owners, "digest"), "digest").where(F.when(F.col("alike"), True).otherwise(F.raise_error(F.lit("unequal payloads share a digest")).cast("boolean")))
    kind = F.when((F.col("n_bytes") >= least_revisit) & ~F.coalesce(F.col("page_id") == F.col("owner"), F.col("owner").isNull()), "revisit").otherwise("response")
    written(owned.select("page_id", "digest", _header(kind).alias("header")), f"{path}/headers")
    written(rows.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload").dropDuplicates(["digest"]), f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(header, record)`` of each record in its exact WARC form, rebuilt and verified; a revisit's record has no block.

    Payloads are hashed where they are stored, and only records that hold them are joined with their bytes; revisits are joined with lengths and digests alone, so however often a
    payload is revisited, its bytes move once.
    """
    stored = spark.read.parquet(f"{path}/payloads").select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"), (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("sound"))
    headers, revisit = spark.read.parquet(f"{path}/headers"), field("WARC-Type") == "revisit"
    full = headers.where(~revisit).join(stored, "digest", "left")
    light = headers.where(revisit).join(stored.drop("payload"), "digest", "left").withColumn("payload", F.lit(b""))
    sound = F.col("sound") & (field("WARC-Payload-Digest: sha1") == F.col("payload_sha1")) & (field("X-Payload-Length").cast("long") == F.col("payload_bytes"))
    checked = full.unionByName(light).where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), F.substring_index("header", _EOL, 3))).cast("boolean")))
    return checked.select("header", F.concat(F.encode("header", "UTF-8"), "payload", F.encode(F.lit(_EOL + _EOL), "UTF-8")).alias("record"))


def field(name: str) -> Column:
    """The value of a header line that begins with ``name``; null where there is none."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}:\s?<?([^\r>]*)", 1), F.lit(""))


def parsed(records: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, refers_to, named_sha1, payload_bytes, payload_digest)`` read off the bytes of records alone.

    The payload of a revisit is that of the response that it refers to.
    """
    head = F.concat(F.substring_index(F.col("record").cast("string"), _EOL + _EOL, 1), F.lit(_EOL + _EOL))
    page = lambda name: F.nullif(F.regexp_replace(field(name), "^urn:page:", ""), F.lit("")).cast("long")
    split = records.select("record", head.alias("header"))
    body = F.substring("record", F.octet_length("header") + 1, field("Content-Length").cast("int"))
    url = F.coalesce(F.decode(F.unbase64(field("X-Target-URI-Base64")), "UTF-8"), field("WARC-Target-URI"))
    each = cut(split.select(page("WARC-Record-ID").alias("page_id"), url.alias("url"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest: sha1").alias("named_sha1"), body.alias("body")).select("*", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest")).drop("body"))
    revisit = F.col("record_type") == "revisit"
    known = each.where(~revisit).groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named_sha1")).agg(F.first("payload_bytes").alias("payload_bytes")).withColumn("payload_digest", F.col("named_sha1"))
    again = each.where(revisit).drop("payload_bytes", "payload_digest").join(apart(known, "refers_to", "named_sha1"), ["refers_to", "named_sha1"], "left")
    return each.where(~revisit).unionByName(again)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to a new archive, and what its rebuilt records say when they are parsed."""
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parsed(read_archive(spark, path).select("record")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM p
"""
