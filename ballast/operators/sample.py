"""Reproducible samples, caps, batches and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions import keys as K
from ballast.functions.durable import cut, width


def stable_sample(df: DataFrame, cap: int, by: str = "dataset", row_id: str = "id") -> DataFrame:
    """The first ``cap`` rows of each group by hashed id; the limit is applied per partition before the shuffle."""
    ordered = W.partitionBy(by).orderBy("__key", row_id)
    return df.withColumn("__key", K.sample_key(F.col(row_id).cast("string"))).withColumn("__at", F.row_number().over(ordered)).where(F.col("__at") <= cap).drop("__key", "__at")


def capped_queries(df: DataFrame, train_cap: int = 450, other_cap: int = 60) -> DataFrame:
    """Distinct ``(locale, query, split)``, capped by hash in each locale and split."""
    key = K.digest(F.concat_ws(":", "locale", "query"))
    ordered = W.partitionBy("locale", "split").orderBy("__key", "query")
    most = F.when(F.col("split") == "train", train_cap).otherwise(other_cap)
    return df.select("locale", "query", "split").distinct().withColumn("__key", key).withColumn("__at", F.row_number().over(ordered)).where((F.col("__at") <= max(train_cap, other_cap)) & (F.col("__at") <= most)).drop("__key", "__at")


def query_split(df: DataFrame, is_test: Column, prefix: str = "esci:") -> DataFrame:
    """One split per ``(locale, query)``: test if any of its rows is, else by hash of the query."""
    group = F.concat(F.lit(prefix), F.col("locale"), F.lit(":"), K.normalized(F.col("query")))
    tested = df.groupBy("locale", "query").agg(F.max(is_test).alias("tested"))
    return tested.select("locale", "query", F.when(F.col("tested"), "test").otherwise(K.train_split(group, False)).alias("split"))


def length_batches(df: DataFrame, size: int, length: Column, by: str = "dataset", row_id: str = "id") -> DataFrame:
    """``df`` with the ``batch`` of rows near in length, within each group; rows of one length go by hash bucket and id."""
    run = F.struct(length.alias("length"), K.hash_bucket(F.col(row_id).cast("string"), 64).alias("bucket"))
    ranked = group_ranks(df.withColumn("__run", run), by, "__run", row_id)
    return ranked.withColumn("batch", F.floor(F.col("rank") / size)).drop("__run", "rank")


def group_ranks(df: DataFrame, by: str, first: str, then: str) -> DataFrame:
    """``df`` with its 0-based ``rank`` in its group by ``(first, then)``, without a task that sorts a whole group.

    Rows are only ranked among those of the same group and ``first``; running counts, one row each, place these runs.
    """
    runs = df.groupBy(by, first).agg(F.count("*").alias("__n"))
    before = W.partitionBy(by).orderBy(first).rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = df.withColumn("__own", F.row_number().over(W.partitionBy(by, first).orderBy(then)) - 1)
    same = own[by].eqNullSafe(starts[by]) & own[first].eqNullSafe(starts[first])
    return own.join(starts, same).select(*(own[c] for c in df.columns), (F.col("__own") + F.col("__start")).alias("rank"))


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` dealt into ranges of ``(by, order)``, numbered by ``__range``, so that a large group lies in several tasks.

    What runs along a group is then found inside each range, and carried on by one row for each group and range. The result is cut, as ranges are drawn from a sample.
    """
    return cut(df.repartitionByRange(width(df.sparkSession), *by, *order).withColumn("__range", F.spark_partition_id()))


def carried(ranges: DataFrame, by: list[str], what: Column, name: str, along=F.sum) -> DataFrame:
    """``ranges`` with the aggregate ``what`` of each earlier range of the row's group, taken together by ``along``; null in its first one."""
    each = ranges.groupBy(*by, "__range").agg(what.alias("__x"))
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    rows = each.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), along("__x").over(before).alias(name))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranges.join(rows, same).drop("__r", *(f"__{c}" for c in by))


def first_n(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__at", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__at") <= n).drop("__at")


def training_plan(pool: DataFrame, first: int, last: int, batch: int, seed: int, by: str = "dataset", row_id: str = "id") -> DataFrame:
    """``(step, slot, dataset, id)`` for the steps in ``[first, last)``: a dataset for each step, uniformly, then its rows, with replacement.

    A step's content depends on seed and number only, so a plan can be resumed anywhere. Ranks within datasets go by hash bucket and id; draws meet
    rows in an equi-join on (dataset, rank).
    """
    ranked = group_ranks(pool.select(by, row_id, K.hash_bucket(F.col(row_id).cast("string"), 4096).alias("__bucket")), by, "__bucket", row_id).drop("__bucket")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("size"))
    named = sizes.withColumn("ordinal", F.row_number().over(W.orderBy(by)) - 1)  # a row per dataset
    n = sizes.select(F.count("*").alias("datasets"))
    draw = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 12), 16, 10).cast("bigint")
    steps = pool.sparkSession.range(first, last).withColumnRenamed("id", "step").join(n)  # n is one row
    steps = steps.withColumn("ordinal", draw(F.lit("dataset"), F.col("step").cast("string")) % F.col("datasets"))
    drawn = steps.join(named, "ordinal").select("step", by, "size", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("slot"))
    drawn = drawn.withColumn("rank", draw(F.lit("row"), F.col("step").cast("string"), F.col("slot").cast("string")) % F.col("size"))
    return drawn.join(ranked, [by, "rank"]).select("step", "slot", by, row_id)
