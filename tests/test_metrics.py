"""Golden values of metrics, temperatures, latencies and rewards."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ballast.operators import calibrate, metrics, report, rowmetrics

SCHEMA = "id int, type string, dataset string, logits array<double>, target array<double>"


@pytest.fixture(scope="module")
def binary(spark):
    z = [0.0, math.log(4)]
    rows = [(i, "noul", "d", z, [0.0, 1.0] if i < 3 else [1.0, 0.0]) for i in range(4)]
    return rowmetrics.row_metrics(spark.createDataFrame(rows, SCHEMA))


def test_binary_means(binary):
    m = metrics.metric_means(binary, "dataset").first()
    assert m.accuracy == pytest.approx(0.75)
    assert m.nll == pytest.approx(-(0.75 * math.log(0.8) + 0.25 * math.log(0.2)))
    assert m.brier_sum == pytest.approx(0.38)
    assert m.brier_per_candidate == pytest.approx(0.19)
    assert m.rps is None and m.score_mae is None


def test_binary_bins(binary):
    assert metrics.ece(binary, "dataset").first().ece_15 == pytest.approx(0.05)
    bins = metrics.reliability(binary, "dataset").orderBy("bin").collect()
    assert len(bins) == 15
    empty = [b for b in bins if b.n == 0]
    assert len(empty) == 14 and all(b.confidence is None and b.accuracy is None for b in empty)


def test_macro_f1_counts_predicted_only_classes(spark):
    rows = [(0, 0), (0, 1), (2, 1)]
    df = spark.createDataFrame([("d", a, b) for a, b in rows], "dataset string, label int, guess int")
    # class 0: 2 * 1 / (2 + 1); class 1: 0; class 2: 0
    assert metrics.macro_f1(df, "dataset").first().macro_f1 == pytest.approx(2 / 3 / 3)


def test_temperature(spark):
    df = spark.createDataFrame([(i, "noul", "d", [0.0, 4.0], [0.25, 0.75]) for i in range(20)], SCHEMA)
    t = calibrate.fit_temperatures(df, "type").first()
    assert t.temperature == pytest.approx(4 / math.log(3), abs=0.02)
    before = rowmetrics.row_metrics(df).agg(F.avg("nll")).first()[0]
    assert rowmetrics.row_metrics(df, t.temperature).agg(F.avg("nll")).first()[0] < before


def test_temperature_of_few_rows_is_one(spark):
    df = spark.createDataFrame([(i, "noul", "d", [0.0, 4.0], [0.25, 0.75]) for i in range(9)], SCHEMA)
    assert calibrate.fit_temperatures(df, "type").first().temperature == 1.0


def test_ordinal(spark):
    row = rowmetrics.row_metrics(spark.createDataFrame([(0, "score", "d", [-100.0, -100.0, 0.0], [1.0, 0.0, 0.0])], SCHEMA)).first()
    assert row.rps == pytest.approx(1.0) and row.score_mae == pytest.approx(2.0) and row.soft_accuracy == 0


def test_latency(spark):
    df = spark.range(1, 21).select(F.col("id").cast("double").alias("ms"), F.lit("a").alias("case"))
    assert report.latency_stats(df, "ms", "case").first().p95_ms == pytest.approx(19.05)


def test_reward_prefers_the_nearer_level(spark):
    rows = [(0, [10.0, -10.0, -10.0, -10.0]), (1, [-10.0, -10.0, 10.0, -10.0])]
    df = spark.createDataFrame([(i, z, [0.0, 0.0, 0.0, 1.0], True) for i, z in rows], "id int, logits array<double>, target array<double>, ordinal boolean")
    far, near = (r.reward for r in rowmetrics.proper_score_reward(df).orderBy("id").collect())
    assert near > far


def test_bootstrap_is_reproducible_and_covers():
    low, high = calibrate.bootstrap_interval(10, 70, 20)
    assert (low, high) == calibrate.bootstrap_interval(10, 70, 20)
    assert low < 0.1 < high


def test_answers_are_distributions(spark):
    draw = random.Random(1)
    rows = [(i, k, "d", [draw.gauss(0, 3) for _ in range(n)], [1.0] + [0.0] * (n - 1)) for i, (k, n) in enumerate([("choice", 7), ("noul", 2), ("score", 5)] * 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.transform("logits", lambda x, i: i.cast("string")))
    for r in rowmetrics.answers_from_logits(df).collect():
        assert all(0 <= p <= 1 for p in r.probabilities) and sum(r.probabilities) == pytest.approx(1, abs=1e-5)
        assert 0 <= r.confidence <= 1
        if r.type == "choice":
            assert int(r.choice) == max(range(7), key=lambda i: r.probabilities[i])
        if r.type == "score":
            assert 0 <= r.score <= 4


def test_ranks_and_maxima_over_many_ranges(spark):
    from ballast.operators import calibrate

    draw = random.Random(9)
    rows = [("big" if i % 10 else None, i, float(draw.randrange(1000)), draw.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "suite string, case long, score double, ms int")
    want, best, seen = {}, {}, {}
    for name in ("big", None):
        own = sorted(r[1] for r in rows if r[0] == name)
        want |= {c: k < len(own) // 2 for k, c in enumerate(own)}
    assert {r.case: r.in_first_half for r in calibrate.half_rank(df).collect()} == want
    for name, case, score, _ in sorted(rows, key=lambda r: r[1]):
        top = seen.get(name)
        best[case] = (top is None or score > top, max(score, top) if top is not None else score)
        seen[name] = best[case][1]
    assert {r.case: (r.improves, r.best) for r in report.best_so_far(df, "suite", step="case").collect()} == best
    import numpy as np

    for name, r in ((r.suite, r) for r in report.latency_stats(df, "ms", "suite").collect()):
        own = [x[3] for x in rows if x[0] == name]
        assert r.n == len(own) and r.p50_ms == pytest.approx(np.quantile(own, 0.5)) and r.p95_ms == pytest.approx(np.quantile(own, 0.95))
    assert report.latency_stats(df, "ms").first().p95_ms == pytest.approx(np.quantile([x[3] for x in rows], 0.95))


def test_temperatures_against_halving(spark):
    import numpy as np

    draw = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(30):
        k, sharp = int(draw.integers(2, 7)), float(np.exp(draw.uniform(-3.2, 3.2)))
        z = draw.normal(size=(40 if g % 5 else 9, k)) * sharp
        p = np.exp(z / sharp * 1.5)
        t = p / p.sum(1, keepdims=True)
        if g == 7:
            z[:] = 2.0  # any temperature is as good
        name = f"g{g}" if g else None
        rows += [(name, [float(x) for x in a], [float(x) for x in b]) for a, b in zip(z, t)]

        def slope(beta, z=z, t=t):
            e = np.exp((z - z.max(1, keepdims=True)) * beta)
            return float(((e / e.sum(1, keepdims=True) - t) * z).sum(1).mean())

        low, high = 0.1, 10.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) < 0 else (low, mid)
        want[name] = 1.0 if len(z) < 10 or g == 7 else 1 / low
    df = spark.createDataFrame(rows, "g string, logits array<double>, target array<double>")
    got = {r.g: r.temperature for r in calibrate.fit_temperatures(df, "g").collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-8), g
    assert calibrate.fit_temperatures(df.where("false"), "g").count() == 0
    plan = calibrate.fit_temperatures(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3  # two scans, one of them read for the guess as well


def test_bootstrap_interval_of_groups(spark):
    deltas = [("a", d) for d in [-1] * 10 + [0] * 70 + [1] * 20] + [("b", 0)] * 5
    got = {r.g: r for r in calibrate.paired_bootstrap(spark.createDataFrame(deltas, "g string, delta int"), "g").collect()}
    assert (got["a"].low, got["a"].high) == calibrate.bootstrap_interval(10, 70, 20) and got["a"].mean_delta == pytest.approx(0.1)
    assert (got["b"].low, got["b"].high) == (0.0, 0.0)
