"""Temperatures: fits, lookups, and held-out comparisons of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import keys as K
from ballast.functions.durable import cut
from ballast.operators.sample import carried, in_ranges

LEAST_ROWS, LOW, HIGH, NODES = 10, 0.1, 10.0, 20


def _moments(beta: Column, order: int) -> Column:
    """A row's means of the first powers of its logits, under their softmax with the inverse temperature ``beta``, as ``m1, m2, ...``."""
    zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(order + 1)))
    most = F.array_max("logits")

    def add(acc: Column, z: Column) -> Column:
        return A.let(F.exp((z - most) * beta), lambda e: F.struct(*((acc[f"s{k}"] + (e * F.pow(z, F.lit(k)) if k else e)).alias(f"s{k}") for k in range(order + 1))))

    return A.let(F.aggregate("logits", zero, add), lambda acc: F.struct(*((acc[f"s{k}"] / acc["s0"]).alias(f"m{k}") for k in range(1, order + 1))))


def _crossing(left: Column, right: Column) -> Column:
    """Where the cubic with the nodes' slopes and bends is zero between them, in terms of the logarithm of the inverse temperature."""
    width = F.log(right["beta"]) - F.log(left["beta"])
    d0, d1 = left["bend"] * left["beta"] * width, right["bend"] * right["beta"] * width
    at = lambda t: (2 * t * t * t - 3 * t * t + 1) * left["slope"] + (t * t * t - 2 * t * t + t) * d0 + (3 * t * t - 2 * t * t * t) * right["slope"] + (t * t * t - t * t) * d1

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        return A.let(F.struct(mid.alias("t"), (at(mid) < 0).alias("below")), lambda m: F.struct(F.when(m["below"], m["t"]).otherwise(acc["low"]).alias("low"), F.when(m["below"], acc["high"]).otherwise(m["t"]).alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve)
    return F.exp(F.log(left["beta"]) + found["low"] * width)


def fit_temperatures(df: DataFrame, *by: str, least_rows: int = LEAST_ROWS, nodes: int = NODES) -> DataFrame:
    """``(by..., n, temperature)``: the temperature in [0.1, 10] of least cross-entropy of each group; 1.0 for small groups, and where all temperatures are alike.

    The loss is convex in the inverse temperature. One scan sums its slope and bend at fixed nodes; a cubic through the two nodes between which the slope
    changes its sign is zero near the solution, and a second scan's slope, bend and the bend's own slope there give a step of third order to it. So
    there are two scans for any number of groups, nothing of them reaches the driver, and no row counts more than once a scan.
    """
    keys = list(by)
    light = df.select(*keys, "logits", "target")
    fixed = F.array(*(F.lit(LOW * (HIGH / LOW) ** (k / (nodes - 1))) for k in range(nodes)))
    each = light.select(*keys, A.dot(F.col("target"), F.col("logits")).alias("__said"), F.posexplode(F.transform(fixed, lambda beta: F.struct(beta.alias("beta"), _moments(beta, 2).alias("m")))).alias("__k", "__x"))
    x = F.col("__x")
    sums = each.groupBy(*keys, "__k").agg(F.count("*").alias("n"), F.first(x["beta"]).alias("beta"), F.avg(x["m"]["m1"] - F.col("__said")).alias("slope"), F.avg(x["m"]["m2"] - x["m"]["m1"] * x["m"]["m1"]).alias("bend"))
    grouped = sums.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("__k", "beta", "slope", "bend"))).alias("nodes"))  # as many as there are nodes
    below = F.size(F.filter("nodes", lambda p: p["slope"] < 0))
    left, right = F.get("nodes", below - 1), F.get("nodes", below)
    flat = F.aggregate("nodes", F.lit(0.0), lambda s, p: s + p["bend"]) <= 0
    start = F.when((F.col("n") < least_rows) | flat, 1.0).when(below == 0, LOW).when(below == nodes, HIGH).otherwise(_crossing(left, right))
    free = (F.col("n") >= least_rows) & ~flat & (below > 0) & (below < nodes)
    guess = grouped.select(*keys, "n", start.alias("__beta"), free.alias("__free"), left["beta"].alias("__low"), right["beta"].alias("__high"))
    scored = K.joined(light, guess.where("__free").drop("n"), keys).select(*keys, A.dot(F.col("target"), F.col("logits")).alias("__said"), _moments(F.col("__beta"), 3).alias("m"))
    m1, m2, m3 = (F.col(f"m.m{k}") for k in (1, 2, 3))
    steps = scored.groupBy(*keys).agg(F.avg(m1 - F.col("__said")).alias("__f"), F.avg(m2 - m1 * m1).alias("__g"), F.avg(m3 - 3 * m2 * m1 + 2 * m1 * m1 * m1).alias("__h"))
    f, g, h = F.col("__f"), F.col("__g"), F.col("__h")
    moved = F.col("__beta") - F.try_divide(2 * f * g, 2 * g * g - f * h)
    beta = F.when(F.col("__free"), F.greatest(F.least(F.coalesce(moved, F.col("__beta")), "__high"), "__low")).otherwise(F.col("__beta"))
    return K.joined(guess, steps, keys, "left").select(*keys, "n", (1 / beta).alias("temperature"))


def temperature_lookup(df: DataFrame, by_bucket: DataFrame, by_type: DataFrame, floor: float = 1e-3) -> DataFrame:
    """``df`` with the temperature of its ``(type, candidates)`` bucket, else of its type, else 1; never below the floor."""
    fine = by_bucket.select("type", "candidates", F.col("temperature").alias("__fine"))
    rough = by_type.select("type", F.col("temperature").alias("__rough"))
    joined = df.join(fine, ["type", "candidates"], "left").join(rough, "type", "left")
    return joined.withColumn("temperature", F.greatest(F.coalesce("__fine", "__rough", F.lit(1.0)), F.lit(floor))).drop("__fine", "__rough")


def half_rank(df: DataFrame, suite: str = "suite", case: str = "case") -> DataFrame:
    """``df`` with ``in_first_half``: whether a row is among the first ``floor(n / 2)`` of its suite by case.

    Rows are counted inside ranges of (suite, case), so no task sorts a whole suite.
    """
    counted = carried(in_ranges(df, [suite], [case]), [suite], F.count("*"), "__before")
    sizes = df.groupBy(F.col(suite).alias("__suite")).agg(F.count("*").alias("__n"))
    at = F.row_number().over(W.partitionBy(suite, "__range").orderBy(case)) + F.coalesce("__before", F.lit(0))
    ranked = counted.withColumn("__at", at).join(sizes, F.col(suite).eqNullSafe(F.col("__suite")))
    return ranked.select(*df.columns, (F.col("__at") <= F.floor(F.col("__n") / 2)).alias("in_first_half"))


def half_split_calibration(df: DataFrame, shipped: float = 1.0, least_valid: int = 60, least_bucket: int = 25) -> DataFrame:
    """Per suite of enough rows: temperatures by ``(type, K)`` fitted on its first half, both halves' sizes, and both
    calibrations of the second half.
    """
    from ballast.operators.metrics import ece
    from ballast.operators.rowmetrics import row_metrics

    big = df.join(df.groupBy("suite").agg(F.count("*").alias("n_valid")).where(F.col("n_valid") >= least_valid), "suite")
    halves = cut(half_rank(big.withColumn("candidates", F.size("target"))))
    fitted = fit_temperatures(halves.where("in_first_half"), "suite", "type", "candidates", least_rows=least_bucket).where(F.col("n") >= least_bucket).drop("n")
    second = halves.where(~F.col("in_first_half")).join(fitted, ["suite", "type", "candidates"], "left").withColumn("temperature", F.coalesce("temperature", F.lit(shipped)))
    both = second.withColumn("mode", F.explode(F.array(F.lit("shipped"), F.lit("refit"))))
    scored = row_metrics(both, F.when(F.col("mode") == "refit", F.col("temperature")).otherwise(F.lit(shipped)))
    means = scored.groupBy("suite", "mode").agg(F.count("*").alias("n_heldout"), F.avg("nll").alias("nll"), F.avg("accuracy").alias("accuracy"))
    return means.join(ece(scored, "suite", "mode"), ["suite", "mode"])


def mean_calibration(halves: DataFrame, published: list[str] | None = None) -> DataFrame:
    """Mean calibration error by mode over all suites, and over the published ones."""
    shown = F.col("suite").isin(*published) if published else F.lit(True)
    return halves.groupBy("mode").agg(F.avg("ece_15").alias("mean_ece"), F.avg(F.when(shown, F.col("ece_15"))).alias("mean_ece_published"), F.count("*").alias("suites"))


def bootstrap_interval(minus: int, zero: int, plus: int, draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the mean of ``n`` deltas of -1, 0 and 1, resampled; three counts say all about them."""
    n = minus + zero + plus
    if not n:
        return math.nan, math.nan
    got = np.random.default_rng(seed).multinomial(n, [minus / n, zero / n, plus / n], size=draws)
    low, high = np.quantile((got[:, 2] - got[:, 0]) / n, [0.025, 0.975])
    return float(low), float(high)


def paired_bootstrap(deltas: DataFrame, by: str, delta: str = "delta", draws: int = 2000, seed: int = 42) -> DataFrame:
    """``(by, n, mean_delta, low, high)``; only counts by group reach the helper."""
    counts = deltas.groupBy(by).agg(*(F.count_if(F.col(delta) == k).alias(name) for k, name in ((-1, "minus"), (0, "zero"), (1, "plus"))))

    @F.pandas_udf("low double, high double")
    def interval(minus: pd.Series, zero: pd.Series, plus: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bootstrap_interval(*x, draws, seed) for x in zip(minus, zero, plus)], columns=["low", "high"])

    made = counts.withColumn("i", interval("minus", "zero", "plus"))
    n = F.col("minus") + F.col("zero") + F.col("plus")
    return made.select(by, n.alias("n"), ((F.col("plus") - F.col("minus")) / n).alias("mean_delta"), "i.low", "i.high")
