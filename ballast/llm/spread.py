"""Links between the items of groups of any size.

A group of bounded weight is one task's. A larger one is split into shards of about that weight. A few of its items, the pivots, are compared with all others first, each
in its shard; those that are linked to the pivot with the most links need no further links among themselves, as they are one component already. Only the rest of the group is
compared with every shard. So a group of near copies costs its size, however large, and not its square; what remains grows with the number of items that are unlike their group's pivot.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut, width
from ballast.llm.text import batches

PIVOTS = 8


def linked(rows: DataFrame, weight: Column, most: float, add: Callable, near: Callable) -> DataFrame:
    """Links ``(a, b)`` of items; rows: ``(grp long, id, ...)``, each id once in a group, read twice or more where a group is large.

    ``add()`` makes what links the items of one shard: it is called with each row (an id and the further columns) and whether the row only asks, and returns the ids that it is linked to. ``near()``
    makes what compares with pivots: called with a row and whether it is a pivot, it returns the pivots near it.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    more = [c for c in rows.columns if c != "grp"]
    hot = cut(rows.groupBy("grp").agg(F.ceil(F.sum(weight) / most).cast("int").alias("shards")).where("shards > 1"))
    if hot.isEmpty():
        dealt = rows.select("grp", F.lit(0).alias("shard"), F.lit(False).alias("late"), *more)
        return _each(dealt.repartition(width(spark), "grp"), add, f"a {kind}, b {kind}").distinct()

    split = rows.join(apart(hot, "grp"), "grp", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")).cast("int"))
    many = split.where("shards > 1")
    some = many.withColumn("at", F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(7)), "id"))).where(F.col("at") <= PIVOTS)
    pivots = some.select("grp", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(False).alias("late"), *more)
    members = many.select("grp", F.col("own").alias("shard"), F.lit(True).alias("late"), *more)
    found = cut(_each(pivots.unionByName(members).repartition(width(spark), "grp", "shard"), near, f"grp long, id {kind}, pivot {kind}", True))
    best = found.groupBy("grp", "pivot").count().groupBy("grp").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    stars = cut(found.join(apart(best, "grp", "pivot"), ["grp", "pivot"]).select("grp", "id", "pivot", F.lit(True).alias("free")))

    marked = split.join(apart(stars.drop("pivot"), "grp", "id"), ["grp", "id"], "left")
    alone = F.col("free").isNotNull() | (F.col("shards") == 1)
    each = marked.withColumn("shard", F.explode(F.when(alone, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))))
    dealt = each.select("grp", "shard", (F.col("shard") != F.col("own")).alias("late"), *more)
    links = _each(dealt.repartition(width(spark), "grp", "shard"), add, f"a {kind}, b {kind}")
    return links.unionByName(stars.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))).distinct()


def _each(dealt: DataFrame, make: Callable, schema: str, named: bool = False) -> DataFrame:
    """What is linked in each shard, rows that are late after the others; ``named``: with the group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Field] = []

        def links() -> Iterator[tuple]:
            at, find = None, None
            for batch in it:
                names = batch.schema.names
                if not out:
                    own = batch.schema.field("id").type
                    out.extend([*([pa.field("grp", pa.int64()), pa.field("id", own), pa.field("pivot", own)] if named else [pa.field("a", own), pa.field("b", own)])])
                columns = [batch.column(k).to_pylist() for k in range(3)]
                rest = [batch.column(names.index(c)).to_pylist() for c in names[3:]]
                for grp, shard, late, *row in zip(*columns, *rest):
                    if (grp, shard) != at:
                        at, find = (grp, shard), make()
                    for other in find(late, *row):
                        yield (grp, row[0], other) if named else (row[0], other)

        made = links()
        first = next(made, None)  # so that the fields are known
        if first is not None:
            yield from batches(itertools.chain([first], made), pa.schema(out))

    return dealt.sortWithinPartitions("grp", "shard", "late", "id").mapInArrow(run, schema)
