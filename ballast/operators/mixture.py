"""Unions of sources, replay of an earlier mixture, and counts of what is in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First match wins, in this order.
REASONS = ("invalid_target", "missing_assets", "candidate_count", "multi_or_empty", "disagreement", "unmapped_region", "cross_split_group", "duplicate_input", "frozen_benchmark_overlap", "token_budget")


def concatenate(sources: list[DataFrame], position: str = "row_index") -> DataFrame:
    """All sources with ``input_pos``, the order of sources and then of rows; no order of scanning is relied on."""
    placed = [s.withColumn("input_pos", F.struct(F.lit(k).alias("source"), F.col(position).cast("long").alias("row"))) for k, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def replay(base: DataFrame, sampled_ids: DataFrame, new: DataFrame) -> DataFrame:
    """New rows and an earlier mixture, whose training rows are only kept if they were sampled."""
    return new.unionByName(replay_filter(base, sampled_ids), allowMissingColumns=True)


def replay_filter(base: DataFrame, sampled_ids: DataFrame) -> DataFrame:
    """Rows of other splits, and sampled training rows."""
    train = base.where("split = 'train'").join(sampled_ids.select("id").distinct(), "id", "left_semi")
    return base.where("split <> 'train'").unionByName(train)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows by dataset and split."""
    return df.groupBy("dataset", "split").agg(F.count("*").alias("n"))


def class_counts(df: DataFrame) -> DataFrame:
    """Rows by dataset, split and class; soft targets have none."""
    at = F.array_position("target", F.lit(1.0)) - 1
    return df.withColumn("class", at.cast("int")).where("class >= 0").groupBy("dataset", "split", "class").agg(F.count("*").alias("n"))


def first_reason(*reasons: Column) -> Column:
    """The first reason that applies."""
    return F.coalesce(*reasons)


def exclusion_counts(df: DataFrame) -> DataFrame:
    """Excluded rows by dataset, split and reason."""
    return df.where("reason is not null").groupBy("dataset", "split", "reason").agg(F.count("*").alias("n"))


def subset_check(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys of one side only, with the side."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))
