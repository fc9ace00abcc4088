"""Sharding by longest-processing-time scheduling of groups that must stay together.

Equal texts form a group; groups go in falling size to the least-loaded shard through a heap. The
schedule only depends on how many groups there are of each size, so the driver gets a histogram and
no group: sizes up to 4096 bytes are classes of their own and larger ones are classed by their leading 12
bits, which bounds the histogram at about 90,000 rows for any input. A class is scheduled at the mean size of its
groups (the exact size where it holds one). What comes back is, per class, how many groups each shard takes;
which of the equal-sized groups go where is then settled by their rank, found without any global sort:
groups are dealt into blocks by hash, ranked within blocks, and blocks are offset by running counts.

Nulls and empties: a null text counts as an empty one (size 1, CRC 0, the same group). Repeated rows are copies of one text and
share a shard. Ties of size are broken by shard number, ties within a shard by hash and doc_id.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions.durable import cut

#: Rows that one block of the ranking holds on average.
BLOCK_ROWS = 20_000
#: Classes of at most this many groups are dealt one by one.
ONE_BY_ONE = 4096


def size_class(size: Column) -> Column:
    """A class that rises with the size; sizes that share their 12 leading bits share it."""
    excess = F.greatest(F.length(F.bin(size)) - 12, F.lit(0))
    return F.floor(size / F.pow(F.lit(2.0), excess)).cast("long") + excess.cast("long") * (1 << 13)


def schedule(classes: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """How many groups of each class each shard takes; classes: ``(mean size, groups)`` in falling size.

    Small classes are dealt through the heap. For large ones the same outcome is found without dealing each group: shard j
    with load l takes its k-th group of size s at level ``l + k * s``, and the n lowest levels are taken.
    """
    heap = [(0.0, j) for j in range(shards)]
    out = []
    for size, n in classes:
        taken = [0] * shards
        if n > ONE_BY_ONE:
            loads = [x for x, _ in sorted(heap, key=lambda x: x[1])]
            low, high = 0.0, max(loads) + size * n
            for _ in range(200):
                mid = (low + high) / 2
                if sum(max(0, int((mid - x) // size)) for x in loads) <= n:
                    low = mid
                else:
                    high = mid
            taken = [max(0, int((low - x) // size)) for x in loads]
            heap = [(x + k * size, j) for j, (x, k) in enumerate(zip(loads, taken))]
            heapq.heapify(heap)
        for _ in range(n - sum(taken)):
            load, j = heap[0]
            taken[j] += 1
            heapq.heapreplace(heap, (load + size, j))
        out.append(taken)
    return out


def ranked(rows: DataFrame, within: str, apart_by: str, order: list[str], total: int) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 within each value of ``within``; no task ranks more than its blocks.

    apart_by: a column that tells rows apart; it is hashed into blocks.
    """
    blocks = max(1, -(-total // BLOCK_ROWS))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(apart_by), F.lit(blocks)))
    counts = dealt.groupBy(within, "__block").agg(F.count("*").alias("__n"))
    before = W.partitionBy(within).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(within, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = W.partitionBy(within, "__block").orderBy(*order)
    return dealt.withColumn("__at", F.row_number().over(here) - 1).join(offsets, [within, "__block"]).withColumn("rank", F.col("__at") + F.col("__before")).drop("__block", "__at", "__before")


def shard(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row, shards near equal in bytes and equal texts together."""
    spark = docs.sparkSession
    body = F.coalesce(text, F.lit(""))
    light = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("text_key"))).withColumn("__row", F.monotonically_increasing_id())
    groups = cut(light.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).withColumn("class", size_class(F.col("bytes"))))
    histogram = groups.groupBy("class").agg(F.avg("bytes").alias("mean"), F.count("*").alias("n"), F.sum("rows").alias("rows")).orderBy(F.desc("mean"), F.desc("class")).collect()
    taken = schedule([(r["mean"], r["n"]) for r in histogram], shards)
    plan = [(r["class"], j, at - k, at) for r, ks in zip(histogram, taken) for j, (k, at) in enumerate(zip(ks, _running(ks))) if k]
    plan = spark.createDataFrame(plan, "class long, shard int, low long, high long")
    placed = ranked(groups, "class", "text_key", ["text_key"], sum(r["n"] for r in histogram)).join(plan, "class").where("rank >= low and rank < high").select("text_key", "shard")
    rows = light.join(placed, "text_key").select("doc_id", "size", "text_crc32", "shard", "text_key", "__row")
    return ranked(rows, "shard", "__row", ["doc_id", "text_key"], sum(r["rows"] for r in histogram)).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def _running(ks: list[int]) -> list[int]:
    out, at = [], 0
    for k in ks:
        at += k
        out.append(at)
    return out


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    got = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
