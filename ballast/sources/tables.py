"""Readers and writers of the tables that preparation and reports use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions import helpers
from ballast.functions.durable import scratch, settings, width
from ballast.sources.archives import read_members
from ballast.sources.documents import read_json_document  # noqa: F401

#: Files that the driver lists at once (about 1 KB each), and what a small file counts for beside its bytes when files are dealt to tasks.
LISTED, FILE_COST = 100_000, 1 << 17


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per line; a schema is required, as state fields are polymorphic (name them as strings)."""
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, root: str, pattern: str = "*.parquet", columns: list[str] | None = None) -> DataFrame:
    """The shards of a source that match a pattern, with only the columns asked for."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(root)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and quoted line breaks; all strings without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_labelled_lines(spark: SparkSession, path: str, member: str | None = None, kind: str | None = None) -> DataFrame:
    """``label<TAB>text`` lines with their 0-based line number in each file as ``uid``; split once, so texts may hold tabs.

    Files are read in splits: a line's number is its place in its split, and how many lines the splits before hold, found from a count per split.
    With ``member``, a regular expression, the files are those in archives whose names match it; each is bounded by a row.
    """
    parts = F.split("value", "\t", 2)
    if member is not None:
        lines = read_members(spark, path, member, kind).select(F.posexplode(F.split(F.col("raw").cast("string"), "\n")).alias("uid", "value"))
        return lines.where("value <> ''").select(F.col("uid").cast("long").alias("uid"), F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("text"))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.where(F.col("value") != "").join(starts, ["file", "block"])
    return numbered.select((F.col("at") + F.col("shift")).alias("uid"), F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("text"))


def read_mail_archive(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``(path, member, spam, raw)`` of the messages in zip and tar archives whose base names are numbered; spam is told by the archive's name."""
    numbered = read_members(spark, path, r"(^|/)\d+\.[^/]*$", kind)
    return numbered.select("path", "member", _base("path").contains("_spam").alias("spam"), "raw")


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """``(path, spam, raw)`` of the messages in mbox files, which are read in splits, so no file is too large.

    A line that begins with ``From `` starts a message and is no part of it. Bytes are kept as they are.
    """
    parts = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("part"))
    start = F.locate("\n", F.decode("part", "ISO-8859-1"))  # a character for each byte
    raw = F.when(start > 0, F.substring("part", start + 1, F.octet_length("part"))).otherwise(F.lit(b""))
    return parts.where("octet_length(part) > 0").select("path", _base("path").contains("_spam").alias("spam"), raw.alias("raw"))


def _base(path: str) -> Column:
    """The last name of a path."""
    return F.element_at(F.split(path, "/"), -1)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes_key, length)`` of image files; bytes are hashed where they are read, and not carried on."""
    from ballast.functions.keys import byte_key

    return spark.read.format("binaryFile").load(path).select("path", byte_key(F.col("content")).alias("bytes_key"), "length")


def _listings(spark: SparkSession, path: str) -> Iterator[list[str]]:
    """What a path or glob matches, in lists that are read one after the other and hold at most ``LISTED`` files each, or a single folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names, held = [], 0
    for found in store.globStatus(at) or []:
        n = store.getContentSummary(found.getPath()).getFileCount() if found.isDirectory() else 1
        if names and held + n > LISTED:
            yield names
            names, held = [], 0
        names.append(re.sub(r"[][{}*?\\]", r"\\\g<0>", found.getPath().toString()))  # a name is no glob
        held += n
    yield names or [path]  # Spark says that it is not there


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pixel_key)`` of decoded images, so re-encoded copies are equal.

    Pictures are decoded when this is called, and the keys written: Spark's driver holds the files of all that a plan reads, so they are
    read in rounds of :func:`_listings`, whose files it forgets. A folder is read in one round.
    """
    from ballast.functions.keys import pixel_key

    out, key = scratch(spark, "pixel-keys"), pixel_key(F.col("image.width"), F.col("image.height"), F.col("image.data"))
    with settings(spark, {"spark.sql.files.openCostInBytes": str(FILE_COST), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}):
        for names in _listings(spark, path):
            spark.read.format("image").load(names).select(F.col("image.origin").alias("path"), key.alias("pixel_key")).write.mode("append").parquet(out)
    return spark.read.schema("path string, pixel_key string").parquet(out)


def read_pinned(spark: SparkSession, root: str, patterns: dict[str, str], rename: dict[str, str] | None = None) -> DataFrame:
    """Files picked by a glob per split, read by their extension, columns renamed, with ``split``."""
    parts = []
    for split, pattern in patterns.items():
        reader = spark.read.option("pathGlobFilter", pattern)
        kind = pattern.rsplit(".", 1)[-1]
        df = reader.parquet(root) if kind == "parquet" else reader.option("header", True).csv(root) if kind == "csv" else reader.json(root)
        parts.append(df.withColumnsRenamed(rename or {}).withColumn("split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_split_partitions(df: DataFrame, path: str, target_bytes: int = 128_000_000) -> None:
    """JSON lines in one folder per split, in files of about ``target_bytes`` each.

    The bytes of each split are summed first and give its number of files; rows are dealt to a split's files by their content and place, so neither a
    large split nor a row that many repeat makes a large file.
    """
    line = F.to_json(F.struct(*(c for c in df.columns if c != "split")))
    sizes = df.groupBy("split").agg(F.sum(F.octet_length(line) + 1).alias("bytes")).collect()  # a row per split
    first, files = {}, {}
    for r in sorted(sizes, key=lambda r: str(r.split)):
        first[r.split], files[r.split] = sum(files.values()), max(1, round((r.bytes or 0) / target_bytes))
    name = F.concat(F.lit("="), F.col("split").cast("string"))
    of = lambda known: F.element_at(F.create_map(*(F.lit(x) for k, v in known.items() for x in ("null" if k is None else f"={k}", v))), F.coalesce(name, F.lit("null")))
    if not files:
        return df.write.partitionBy("split").json(path)
    spread = F.pmod(F.xxhash64(line, F.monotonically_increasing_id()), of(files)).cast("int")
    dealt = df.withColumn("__file", of(first) + spread)
    dealt.repartitionById(sum(files.values()), F.col("__file")).drop("__file").write.partitionBy("split").json(path)


def write_exclusions(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes a tagged table once, by whether a row has a reason; returns ``(kept, excluded)`` as reread."""
    df.withColumn("excluded", F.col("reason").isNotNull()).write.partitionBy("excluded").parquet(path)
    written = df.sparkSession.read.parquet(path)
    out = F.col("excluded").cast("boolean")  # partition values are read as strings
    return written.where(~out).drop("excluded", "reason"), written.where(out).drop("excluded")


def write_manifest(df: DataFrame, path: str, seed: int) -> None:
    """Counts, exclusions and content hashes by split as JSON."""
    partition_fingerprint(df).withColumn("seed", F.lit(seed)).coalesce(1).write.json(path)


def write_wide_table(dfs: list[DataFrame], path: str) -> None:
    """Tables of differing columns as one CSV, blank where a column is missing."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs).write.option("header", True).csv(path)


def verify_files(manifest: DataFrame, path: str) -> DataFrame:
    """Manifest rows ``(path, bytes, sha256)`` that the files under ``path`` do not match, with the ``reason``."""
    files = manifest.sparkSession.read.format("binaryFile").load(path)
    found = files.select(_base("path").alias("path"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    reason = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "length").when(F.col("found_sha256") != F.col("sha256"), "digest")
    return manifest.join(found, "path", "left").withColumn("reason", reason).where("reason is not null")


def verify_large_files(manifest: DataFrame) -> DataFrame:
    """As :func:`verify_files` for full paths of files too large for a row, in any store that the workers' Arrow has a client for; each is hashed in chunks by one task."""

    def run(it):
        for pdf in it:
            found = [helpers.file_digest(p) for p in pdf["path"]]
            yield pdf.assign(found_bytes=pd.array([x[0] for x in found], "Int64"), found_sha256=[x[1] for x in found])

    schema = T.StructType([*manifest.schema.fields, T.StructField("found_bytes", T.LongType()), T.StructField("found_sha256", T.StringType())])
    # a number of its own, as adaptive execution would put a manifest, whose rows are small however large its files, into one task
    made = manifest.repartition(width(manifest.sparkSession), "path").mapInPandas(run, schema)
    reason = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "length").when(F.col("found_sha256") != F.col("sha256"), "digest")
    return made.withColumn("reason", reason).where("reason is not null")


def partition_state(df: DataFrame, by: str = "split") -> DataFrame:
    """``(by, n, x, s)``: what an order-free digest of each partition's rows is made of; states of parts add up to that of the whole.

    Rows are JSON with their columns by name; of each row's SHA-256 60 bits are summed and another 60 combined by exclusive or.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != by)), {"ignoreNullFields": "false"}), 256)
    bits = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("bigint")
    return df.select(by, row.alias("h")).groupBy(by).agg(F.count("*").alias("n"), F.bit_xor(bits(1)).alias("x"), F.sum(bits(16).cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"))


def merged_state(*states: DataFrame, by: str = "split") -> DataFrame:
    """The state of tables' rows together, from the state of each."""
    return reduce(lambda a, b: a.unionByName(b), states).groupBy(by).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"))


def remaining_state(whole: DataFrame, part: DataFrame, by: str = "split") -> DataFrame:
    """The state of what is left of ``whole`` without the rows of ``part``, which it holds; partitions of which nothing is left go."""
    taken = part.select(by, (-F.col("n")).alias("n"), "x", (-F.col("s")).cast("decimal(38,0)").alias("s"))
    return merged_state(whole, taken, by=by).where("n <> 0")


def state_digest(state: DataFrame, by: str = "split") -> DataFrame:
    """``(by, n, digest)`` of states."""
    return state.select(by, "n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("digest"))


def partition_fingerprint(df: DataFrame, by: str = "split") -> DataFrame:
    """``(by, n, digest)``: an order-free digest of each partition's rows, to tell whether data changed."""
    return state_digest(partition_state(df, by), by)


def reread_equal(a: DataFrame, b: DataFrame, by: str = "split") -> DataFrame:
    """Partitions whose fingerprints differ; none if two tables hold the same rows."""
    one, two = partition_fingerprint(a, by), partition_fingerprint(b.select(*a.columns), by)
    return one.join(two.withColumnsRenamed({"n": "n2", "digest": "digest2"}), by, "full").where("not (digest <=> digest2)")
