"""The overlap guard and its filter against brute force."""

import random
import re

from ballast.operators import guard, membership
from ballast.functions import keys as K


def test_filter_lets_all_members_pass_and_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.lit("x").alias("__block0"))
    asked = spark.range(0, 60_000, 2).select(F.when(F.col("id") % 1000 != 0, F.xxhash64("id")).alias("k"), "id")
    for most in (membership.MOST_BYTES, 0):
        old, membership.MOST_BYTES = membership.MOST_BYTES, most
        try:
            got = {r.id for r in membership.maybe(asked, "k", membership.build(keys, "k")).collect()}
        finally:
            membership.MOST_BYTES = old
        members = {i for i in range(0, 20_000, 2) if i % 1000}
        assert members <= got and len(got - members) < 0.02 * 20_000
    assert membership.maybe(asked, "k", membership.build(keys.where("false"), "k")).count() == 0
    assert membership.maybe(asked.where("false"), "k", membership.build(keys, "k")).count() == 0


def fold(t):
    return " ".join(re.findall(r"[^\W]+", t.lower().replace("ß", "ss").replace("ς", "σ")))


def test_equal_fingerprints_have_equal_keys(spark):
    draw = random.Random(3)
    words = ["Straße", "İstanbul", "ΣΊΣΥΦΟΣ", "a", "B2", "x_y", "naïve", "Ⅻ", "日本", "ẞ"]
    texts = []
    for _ in range(300):
        ws = [draw.choice(words) for _ in range(draw.randrange(0, 14))]
        for _ in range(2):
            texts.append(draw.choice(["", " ", "--", "¿"]) + "".join(draw.choice([w, w.lower(), w.upper() if w != "İstanbul" else w]) + draw.choice([" ", " - ", "\n\n", "!? "]) for w in ws))
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.fingerprint(F.col("t")).alias("f"), guard.first_words_key(F.col("t")).alias("k")).collect()
    keys = {}
    for r in rows:
        keys.setdefault(r.f, set()).add(r.k)
    assert all(len(k) == 1 for k in keys.values()) and len({r.k for r in rows}) > 150


def test_overlap_against_brute_force(spark):
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice(["alpha", "Beta", "gamma", "Delta2", "ε"]) for _ in range(n))
    held = [text(draw.randrange(5, 60)) for _ in range(40)] + ["common start of many words in a row here " + text(20) for _ in range(20)]
    rows = []
    for i in range(300):
        leaves = [text(draw.randrange(3, 50)), None]
        if i % 3 == 0:  # a third of all rows hold one blocked text
            leaves.append(held[0].upper())
        elif i % 7 == 0:
            leaves.append("  " + draw.choice(held).replace(" ", " ,\n"))
        elif i % 11 == 0:
            leaves.append("common start of many words in a row here " + text(20))
        elif i % 13 == 0:
            leaves.append((held[1] + " ") * 200)
        rows.append((i, leaves, f"g{i % 40}"))
    long = (held[1] + " ") * 200
    held.append(long[:3000])
    blocked_texts = {fold(h) for h in held if len(h.strip()) >= 80}
    want = {i for i, leaves, _ in rows if any(x and len(v.strip()) >= 80 and fold(v) in blocked_texts for x in leaves for v in (x, (x or "")[:3000]))}
    df = spark.createDataFrame(rows, "id long, state_leaves array<string>, `group` string")
    base = spark.createDataFrame([(k, "test", [h]) for k, h in enumerate(held)], "id long, split string, state_leaves array<string>")
    none = base.where("false")
    leaves = guard.blocked_leaves(base, none)
    assert {r.id for r in guard.benchmark_overlap(df, leaves).collect()} == want
    assert {r.id for r in guard.benchmark_overlap(df, guard.blocked_fingerprints(base, none)).collect()} == want
    frozen = spark.createDataFrame([(held[0],), (None,), ("short",)], "text string")
    assert {r.id for r in guard.benchmark_overlap(df, guard.blocked_leaves(none, none, frozen)).collect()} >= {i for i in range(0, 300, 3)}
    assert guard.benchmark_overlap(df.where("false"), leaves).count() == 0 and guard.benchmark_overlap(df, leaves.where("false")).count() == 0
    bad = {g for i, _, g in rows if i in want}
    kept = guard.reject_overlap_groups(df, guard.benchmark_overlap(df, leaves)).collect()
    assert {r.id for r in kept} == {i for i, _, g in rows if g not in bad}


def test_hot_groups_are_joined_behind_a_shuffle_of_their_own(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, "hub" if i % 3 else f"g{i}") for i in range(30)], "id long, `group` string")
        plan = guard.reject_overlap_groups(df, df.where("id = 4").select("id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the side that was aggregated by the group reaches the join through another exchange, so a hot group's partition can be split
    assert plan.index("xxhash64(group") > plan.index("LeftAnti") and plan.count("REPARTITION_BY_COL") >= 2
