"""Aggregates over rows that ``rowmetrics.row_metrics`` has scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.operators.rowmetrics import MEANS

BINS = 15

# Datasets whose candidates differ by question, so that label positions are no classes.
VARYING_CANDIDATES = ("aokvqa", "scienceqa", "typed_decisions", "screenqa_choice", "clevr_attribute")


def metric_means(rows: DataFrame, *by: str) -> DataFrame:
    """Mean of each row metric and ``n`` by group; ordinal means only count ordinal rows."""
    return rows.groupBy(*by).agg(*(F.avg(m).alias(m) for m in MEANS), F.count("*").alias("n"))


def bin_index(confidence: Column) -> Column:
    """0-based bin of ``(lower, upper]``; null for a confidence of zero or none."""
    edges = F.array(*(F.lit(i / BINS) for i in range(BINS + 1)))
    return F.when((confidence > 0) & (confidence <= 1), F.size(F.filter(edges, lambda e: e < confidence)) - 1)


def _bins(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, bin_index(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("accuracy").alias("accuracy"))


def reliability(rows: DataFrame, *by: str) -> DataFrame:
    """All bins of each group with their count, mean confidence and accuracy; the last two are null in empty bins."""
    spark: SparkSession = rows.sparkSession
    edges = spark.range(BINS).select(F.col("id").cast("int").alias("bin"), (F.col("id") / BINS).alias("lower"), ((F.col("id") + 1) / BINS).alias("upper"))
    counted = _bins(rows, *by)
    groups = counted.select(*by).distinct() if by else None
    frame = groups.join(edges) if by else edges  # fifteen rows to each group
    return frame.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(rows: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error over the bins, by group."""
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).otherwise(0.0))
    return _bins(rows, *by).groupBy(*by).agg((gap / F.sum("n")).alias("ece_15"))


def macro_f1(rows: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean F1 over the classes seen as label or guess, by group, from a confusion count."""
    cells = rows.groupBy(*by, "label", "guess").agg(F.count("*").alias("c"))
    hit = (F.col("label") == F.col("guess")).cast("long") * F.col("c")
    miss = F.col("c") - hit
    sides = F.explode(F.array(F.struct(F.col("label").alias("class"), hit.alias("tp"), miss.alias("wrong")), F.struct(F.col("guess").alias("class"), F.lit(0).cast("long").alias("tp"), miss.alias("wrong"))))
    each = cells.select(*by, sides.alias("s")).groupBy(*by, F.col("s.class").alias("class")).agg(F.sum("s.tp").alias("tp"), F.sum("s.wrong").alias("wrong"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0))
    return each.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def metrics_by(rows: DataFrame, *by: str) -> DataFrame:
    """Means and calibration error by group."""
    return metric_means(rows, *by).join(ece(rows, *by), [*by])


def metrics_by_dataset(rows: DataFrame) -> DataFrame:
    """Means, calibration error and macro F1 by dataset; the last is null where candidates vary."""
    f1 = macro_f1(rows.where(~F.col("dataset").isin(*VARYING_CANDIDATES)), "dataset")
    return metrics_by(rows, "dataset").join(f1, "dataset", "left")


def macro_accuracy(by_dataset: DataFrame) -> DataFrame:
    """Plain mean of the datasets' accuracies."""
    return by_dataset.agg(F.avg("accuracy").alias("macro_accuracy"))


def metrics_by_primitive_candidates(rows: DataFrame) -> DataFrame:
    """Means and calibration error by type and number of candidates."""
    return metrics_by(rows.withColumn("candidates", F.size("target")), "type", "candidates")
