"""A log of scored rows that several writers append to, of which readers see whole batches only.

A batch is written to a folder of its own, then committed by a small manifest, whose number follows the last one. A manifest can be made once:
of two writers that want the same number one fails, takes out what the others have committed meanwhile, and tries the next. A writer that fails
before its commit leaves a folder that nobody reads; repeating the append adds what is missing. A manifest without a whole line in it (its writer died at it) is
passed over.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession

from ballast.functions.durable import apart, drop


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file; False if there is one."""
    at, fs = _file_system(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last manifest, and the committed batches in order; a line for each commit reaches the driver."""
    at, fs = _file_system(spark, f"{path}/commits")
    if not fs.exists(at):
        return 0, []
    last, found = 0, []
    for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
        last = max(last, int(status.getPath().getName().split(".")[0]))
    if last:
        for row in spark.read.text(f"{path}/commits/*.json").collect():
            if row.value.endswith("}"):
                said = json.loads(row.value)
                found.append((said["number"], said["batch"]))
    return last, [batch for _, batch in sorted(found)]


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches."""
    batches = committed(spark, path)[1]
    return spark.read.schema(schema).parquet(*(f"{path}/{b}" for b in batches)) if batches else spark.createDataFrame([], schema)


def _missing(df: DataFrame, done: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of ``df`` whose keys ``done`` lacks; null keys are equal."""
    keys = apart(done.select(*key).distinct(), *key)
    return df.join(keys, reduce(and_, (df[k].eqNullSafe(keys[k]) for k in key)), "left_anti")


def stage(df: DataFrame, path: str) -> str:
    """Writes a batch that nobody reads yet; returns its name."""
    batch = f"batch-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{batch}")
    return batch


def append_scored(df: DataFrame, path: str, *key: str) -> DataFrame:
    """Appends the rows whose keys the log at ``path`` lacks, in one commit; returns the log. Running it again adds nothing.

    Rows of one key within ``df`` are appended together. Nothing to append makes no batch. Columns are those of the first batch.
    """
    spark = df.sparkSession
    last, seen = committed(spark, path)
    known = seen
    pending = _missing(df, read_log(spark, path, df.schema), key) if seen else df
    while not pending.isEmpty():
        batch = stage(pending, path)
        if _create_once(spark, f"{path}/commits/{last + 1:012d}.json", json.dumps({"number": last + 1, "batch": batch})):
            break
        # others were quicker: what they have committed since is taken out
        last, now = committed(spark, path)
        own = spark.read.schema(df.schema).parquet(f"{path}/{batch}")
        new = [b for b in now if b not in set(known)]
        pending = _missing(own, spark.read.schema(df.schema).parquet(*(f"{path}/{b}" for b in new)), key) if new else own
        known = now
    return read_log(spark, path, df.schema)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes batches that were never committed; to be run while nobody writes. Returns how many."""
    at, fs = _file_system(spark, path)
    keep = set(committed(spark, path)[1])
    left = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("batch-")]
    gone = [name for name in left if name not in keep]
    for name in gone:
        drop(spark, f"{path}/{name}")
    return len(gone)
