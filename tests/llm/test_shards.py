import heapq
import random
import zlib

from ballast.llm import shards as S
from tests.llm.fixtures import SCHEMA, documents


def test_schedule_equals_a_plain_heap():
    draw = random.Random(1)
    classes = sorted(((draw.randrange(1, 400), draw.choice([1, 3, 50, 6000])) for _ in range(40)), reverse=True)
    heap = [(0, j) for j in range(7)]
    for size, n in classes:
        for _ in range(n):
            load, j = heap[0]
            heapq.heapreplace(heap, (load + size, j))
    loads = [0.0] * 7
    for (size, n), taken in zip(classes, S.schedule([(float(s), n) for s, n in classes], 7)):
        assert sum(taken) == n
        loads = [x + size * k for x, k in zip(loads, taken)]
    assert sorted(loads) == sorted(float(x) for x, _ in heap)


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    docs = documents()
    got = S.shard(spark.createDataFrame(docs, SCHEMA), 4).collect()
    assert len(got) == len(docs)
    of = {}
    for r in got:
        of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    for j in range(4):
        slots = sorted(r.slot for r in got if r.shard == j)
        assert slots == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in docs)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    assert S.shard(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_bytes_are_near_equal(spark):
    draw = random.Random(4)
    rows = [(i, "x" * draw.randrange(1, 9000) + str(i), None, None, 0) for i in range(600)]
    got = S.shard(spark.createDataFrame(rows, SCHEMA), 8).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert max(loads) - min(loads) < 0.01 * max(loads)


def test_size_classes_rise(spark):
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([(x,) for x in [1, 2, 4095, 4096, 4097, 8191, 8192, 8193, 16384, 10**6, 10**9, 10**12]], "s long")
    got = [r.c for r in sizes.orderBy("s").select(S.size_class(F.col("s")).alias("c")).collect()]
    assert got == sorted(got) and got[:4] == [1, 2, 4095, 4096] or got[:3] == [1, 2, 4095]


def test_columns_of_the_same_names(spark):
    docs = documents()
    odd = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as size", "'x' as shard", "'x' as slot", "'x' as rank", "'x' as class", "'x' as text_key")
    assert S.shard(odd, 3).columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and S.shard(odd, 3).count() == len(docs)


def test_rows_without_an_id_are_ranked_in_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("k"), F.col("id").alias("at"))
    old, S.BLOCK_ROWS = S.BLOCK_ROWS, 300
    try:
        plan = S.ranked(rows, "k", "at", ["doc_id"], 3000)
        blocks = rows.withColumn("b", F.pmod(F.xxhash64("at"), F.lit(10))).groupBy("b").count().agg(F.max("count")).first()[0]
        got = sorted(r["rank"] for r in plan.collect())
        docs = spark.range(900).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('t', id % 100) AS text")
        made = S.shard(docs, 4).collect()
    finally:
        S.BLOCK_ROWS = old
    assert got == list(range(3000)) and blocks < 400
    for j in range(4):
        slots = sorted(r.slot for r in made if r.shard == j)
        assert slots == list(range(len(slots)))
