"""Keeping related rows in one split: components over shared keys, split priority, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions import keys as K
from ballast.functions.durable import apart, cut
from ballast.operators.components import extended_components, numbered_components


def alias_edges(df: DataFrame) -> DataFrame:
    """Distinct ``(group, alias)``; rows with ``image_bytes_key`` or ``image_pixel_key`` are aliased by these too."""
    more = [c for c in ("image_bytes_key", "image_pixel_key") if c in df.columns]
    all_aliases = F.array_compact(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(*more).cast("array<string>")))
    return df.select("group", F.explode(all_aliases).alias("alias")).distinct()


def component_roots(df: DataFrame) -> DataFrame:
    """``(group, root)`` of every group; the root is the least key of the component, groups and aliases alike.

    An alias links its groups to the least of them, so aliases of one group, which are most, take no part in the rounds, and no alias does under its own name.
    """
    edges = cut(_keys_of(df))
    own = edges.groupBy("group").agg(F.min("alias").alias("own"))
    shared = edges.groupBy("alias").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most")
    links = edges.join(apart(shared, "alias"), "alias").where("group <> least").select("group", "least").distinct()
    met = numbered_components(links, "group", "least")
    joined = own.join(apart(met, "node"), F.col("group") == F.col("node"), "left").select("group", "own", F.col("root").alias("met"))
    least = joined.where("met is not null").groupBy("met").agg(F.min("own").alias("low"))
    return joined.join(apart(least, "met"), "met", "left").select("group", F.coalesce("low", "own").alias("root"))


def _keys_of(df: DataFrame) -> DataFrame:
    """Distinct ``(group, alias)``, each group among its own aliases."""
    own = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("group"))  # in one pass, as keys are dear to make
    return alias_edges(df.withColumn("aliases", own))


def extended_roots(roots: DataFrame, base: DataFrame, added: DataFrame) -> DataFrame:
    """``(group, root)`` of the groups of ``base`` and ``added`` rows, from the ``roots`` of ``base``; equal to those of both together.

    Only what the added rows touch is walked: their keys, and the components of ``base`` that have one of them.
    """
    new = cut(_keys_of(added))
    asked = new.select("alias").distinct()
    touched = cut(_keys_of(base).join(asked, "alias", "left_semi").join(apart(roots, "group"), "group").select(F.col("alias").alias("node"), "root").distinct())
    made = cut(extended_components(touched, new, "group", "alias"))
    moved = touched.join(apart(made.select("node", F.col("root").alias("to")), "node"), "node").where("root <> to").select("root", "to").distinct()
    old = roots.join(apart(moved, "root"), "root", "left").select("group", F.coalesce("to", "root").alias("root"))
    fresh = new.select("group").distinct().join(roots.select("group"), "group", "left_anti")
    return old.unionByName(made.join(fresh, made["node"] == fresh["group"]).select("group", "root"))


def component_sizes(df: DataFrame) -> DataFrame:
    """Rows and groups of each component, to see giant ones."""
    return df.join(apart(component_roots(df), "group"), "group").groupBy("root").agg(F.count("*").alias("rows"), F.count_distinct("group").alias("groups"))


def resolve_split_priority(df: DataFrame, root: str = "root") -> DataFrame:
    """``df`` with ``conflict``: whether its component also has a split of higher rank. Rows never move.

    An aggregation and a join rather than a window: a hub component must not land in one task.
    """
    top = df.groupBy(root).agg(F.max(K.split_rank(F.col("split"))).alias("__top"))
    return df.join(apart(top, root), root).withColumn("conflict", K.split_rank(F.col("split")) < F.col("__top")).drop("__top")


def dedupe_inputs(df: DataFrame, *key: str, order: str = "input_pos", row_id: str = "id") -> DataFrame:
    """``df`` with ``duplicate``: whether an earlier row has the same key. The target takes no part; rows of one position count by id.

    The first row of each key is a partial aggregate, so an input that a third of all rows repeat does not meet in one task; the join back splits
    where it is skewed.
    """
    keyed = df.withColumn("__key", K.digest(K.canonical_json(*key))).withColumn("__at", F.struct(order, row_id))
    first = keyed.groupBy("__key").agg(F.min("__at").alias("__first"))
    return keyed.join(apart(first, "__key"), "__key").withColumn("duplicate", F.col("__at") > F.col("__first")).drop("__key", "__at", "__first")


def isolation_reasons(df: DataFrame) -> DataFrame:
    """``(id, input_pos, dataset, split, root, reason)``: each row's component, and the first reason to exclude it or null.

    All of it works on keys; states are hashed once and not shuffled.
    """
    keys = [c for c in ("image_bytes_key", "image_pixel_key") if c in df.columns]
    light = cut(df.select("id", "input_pos", "dataset", "group", "aliases", "split", *keys, K.digest(K.canonical_json("state", "question")).alias("input")))
    rooted = light.join(apart(component_roots(light), "group"), "group")
    judged = resolve_split_priority(rooted)
    # duplicates are only sought among rows that the split rule keeps
    deduped = dedupe_inputs(judged.where(~F.col("conflict")), "dataset", "root", "input").withColumn("reason", F.when(F.col("duplicate"), "duplicate_input"))
    out = judged.where("conflict").withColumn("reason", F.lit("cross_split_group"))
    names = ["id", "input_pos", "dataset", "split", "root", "reason"]
    return deduped.select(*names).unionByName(out.select(*names))


def _under_roots(df: DataFrame, reasons: DataFrame) -> DataFrame:
    joined = df.join(reasons.select("id", "input_pos", "root", "reason"), ["id", "input_pos"])
    return joined.withColumn("group", F.col("root")).drop("root")


def tagged(df: DataFrame) -> DataFrame:
    """``df`` under component roots, with the first ``reason`` to exclude it or null."""
    return _under_roots(df, isolation_reasons(df))


def isolate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, audit of the others by dataset, split and reason)``."""
    reasons = cut(isolation_reasons(df))
    audit = reasons.where("reason is not null").groupBy("dataset", "split", "reason").agg(F.count("*").alias("n"))
    return _under_roots(df, reasons.where("reason is null")).drop("reason"), audit
