"""Places that every executor can reach: checkpoints and intermediate tables.

Lineage is only cut by reliable checkpoints or written tables in the folder that
``spark.checkpoint.dir`` names, so a lost executor never loses a cut.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    Read from ``spark.checkpoint.dir``. Where it is unset a temporary folder is used, and
    only in local mode: a cluster has no folder that a library could guess.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


_REMOVES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """The session's settings with ``held`` in them, for what is executed inside."""
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """Has Spark remove the shuffle files of what is executed inside as soon as it ends, not when the driver's handles are collected."""
    return settings(spark, {_REMOVES: "true"})


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint; what was shuffled for it goes at once."""
    spark = df.sparkSession
    shared_dir(spark)
    with tidy(spark):
        return df.select("*").checkpoint(eager=True)  # planned anew, under this setting


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet under ``path`` and read back; what was shuffled for it goes at once."""
    with tidy(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`scratch` that nothing reads any more, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the one knob for how finely work is dealt."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per Spark context (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if getattr(sc, "_ballast_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "ballast.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._ballast_shipped = True


def apart(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt evenly by its key, so that a later join on the key deals it anew.

    A side that was just aggregated by the key would be joined where it is, in one stage; with both sides read from plain shuffles,
    adaptive execution can split the partitions of a hot key.
    """
    return df.repartition(F.xxhash64(*key))
