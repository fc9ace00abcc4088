"""Leakage isolation: components, split priority, duplicates; whatever the order of partitions."""

import random

from pyspark.sql import functions as F

from ballast.operators import isolate
from ballast.operators.components import connected_components, extended_components, numbered_components
from ballast.plans.fixtures import examples

SCHEMA = "id string, dataset string, `group` string, aliases array<string>, split string, state string, question string, input_pos long, image_bytes_key string, image_pixel_key string"


def test_same_pixels_keep_only_the_test_row(spark):
    df = spark.createDataFrame([("a", "d", "g1", [], "train", "s", "q", 1, "b1", "p"), ("b", "d", "g2", [], "test", "s", "q", 2, "b2", "p")], SCHEMA)
    kept, audit = isolate.isolate(df)
    assert [r.id for r in kept.collect()] == ["b"]
    assert [(r.split, r.reason, r.n) for r in audit.collect()] == [("train", "cross_split_group", 1)]


def test_null_aliases_and_no_rows(spark):
    df = spark.createDataFrame([("a", "d", "g1", None, "train", None, "q", 1, None, None), ("b", "d", "g1", None, "train", None, "q", 2, None, None)], SCHEMA)
    kept, audit = isolate.isolate(df)
    assert [r.id for r in kept.collect()] == ["a"]
    assert audit.first().reason == "duplicate_input"
    kept, audit = isolate.isolate(df.where("false"))
    assert kept.count() == 0 and audit.count() == 0


def test_components_against_union_find(spark):
    draw = random.Random(7)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)] + [(1000, x) for x in range(1001, 1200)] + [(x, x + 1) for x in range(2000, 2060)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(table, "a", "b").collect()}
    assert got == {x: find(x) for x in up}
    wide = table.select(*(F.concat(F.lit("key"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c) for c in ("a", "b")))
    named = {int(r.node[3:]): int(r.root[3:]) for r in numbered_components(wide, "a", "b").collect()}
    assert named == got
    for share in (0.0, 0.5, 0.97, 1.0):  # a first part, then the rest
        first, rest = [e for k, e in enumerate(edges) if k % 100 < 100 * share], [e for k, e in enumerate(edges) if k % 100 >= 100 * share]
        known = connected_components(spark.createDataFrame(first, "a long, b long"), "a", "b")
        more = extended_components(known, spark.createDataFrame(rest, "a long, b long"), "a", "b").collect()
        assert {r.node: r.root for r in more} == got and len(more) == len(got)


def test_roots_against_union_find(spark):
    draw = random.Random(9)
    rows = []
    for i in range(240):
        aliases = [draw.choice(["b", "a", "z"]) + str(draw.randrange(150)) for _ in range(draw.randrange(3))] + [None] * (i % 2)
        if i % 3 == 0:
            aliases.append("hub" if i < 120 else "m" + str(draw.randrange(60)))  # the hub; names of other groups
        rows.append((str(i), "d", f"m{draw.randrange(90)}", aliases, "train", "s", "q", i, f"p{draw.randrange(400)}", None))
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for r in rows:
        for x in [*r[3], r[8], r[2]]:
            if x is not None:
                p, q = find(r[2]), find(x)
                up[max(p, q)] = min(p, q)
    want = {r[2]: find(r[2]) for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    whole = isolate.component_roots(df).collect()
    assert {r.group: r.root for r in whole} == want and len(whole) == len(want)
    base, added = df.where("input_pos < 200"), df.where("input_pos >= 200")
    for one, two in ((base, added), (added, base), (df, df.where("false")), (df.where("false"), df), (df, added)):
        more = isolate.extended_roots(isolate.component_roots(one), one, two).collect()
        assert {r.group: r.root for r in more} == want and len(more) == len(want)


def test_invariants_on_documents(spark):
    ex = examples(spark, "/root/testdata/sf0.001")
    kept, audit = isolate.isolate(ex)
    kept = kept.cache()
    assert kept.count() + audit.agg(F.sum("n")).first()[0] == ex.count()
    assert kept.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    again, _ = isolate.isolate(kept.withColumn("aliases", F.array(F.col("group"))))
    assert again.count() == kept.count()
    moved, _ = isolate.isolate(ex.repartition(7, "state"))
    assert sorted(r.id for r in moved.collect()) == sorted(r.id for r in kept.collect())
