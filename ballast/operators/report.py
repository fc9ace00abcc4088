"""Report tables: flattened metrics, latencies, telemetry, training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions import keys as K
from ballast.operators.sample import carried, in_ranges


def flatten_metrics(df: DataFrame, metrics: str, *keep: str) -> DataFrame:
    """One row per entry of a metric map, scalars only: ``(keep..., metric, value)``."""
    return df.select(*keep, F.explode(metrics).alias("metric", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


def prefixed(df: DataFrame, nested: str, *keep: str) -> DataFrame:
    """``keep`` and the fields of a struct column, named ``nested_field``."""
    fields = df.schema[nested].dataType.fieldNames()
    return df.select(*keep, *(F.col(f"{nested}.{f}").alias(f"{nested}_{f}") for f in fields))


def chart_rows(df: DataFrame, figure: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics as long rows ``(figure, keys..., metric, value)``."""
    return df.unpivot(keys, metrics, "metric", "value").withColumn("figure", F.lit(figure)).where("value is not null")


#: Ranks of the sketch are off by less than one in so many rows; brackets reach further by ten times that. Groups of fewer rows than a bracket needs to be sure are bracketed whole.
ACCURACY, SMALL = 50_000, 20_000


def quantiles(df: DataFrame, value: str, at: list[float], *by: str, more: dict[str, Column] | None = None) -> DataFrame:
    """``(by..., n, q, more...)``: the exact quantiles ``at`` of each group's values by linear interpolation at ``at * (n - 1)``, how many values there are, and further aggregates of the rows that have one.

    Two scans. The first takes a mergeable sketch of each group, which brackets each rank asked for. The second counts values: those in a bracket one by
    one, all others by the zone that they lie in, so what is ranked is a bracket's distinct values, a few in ten thousand of a large group's rows. Nothing is cut or collected.
    """
    keys, at_sorted, reach = [*by] or ["__all"], sorted(at), 10 / ACCURACY
    rows = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    probes = [p for q in at_sorted for p in (max(0.0, q - reach), min(1.0, q + reach))]
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", probes, ACCURACY).alias("__edges"), *(c.alias(k) for k, c in (more or {}).items()))
    first = first.withColumn("__edges", F.when(F.col("n") > SMALL, F.col("__edges")))
    # an even zone lies between brackets, an odd one is a bracket; small groups are one bracket
    zone = F.lit(len(probes))
    for k in reversed(range(len(probes))):
        edge = F.get("__edges", F.lit(k))
        zone = F.when(F.col("__v") <= edge if k % 2 else F.col("__v") < edge, k).otherwise(zone)
    zoned = K.joined(rows.select(*keys, "__v"), first.select(*keys, "__edges"), keys).select(*keys, "__v", F.when(F.col("__edges").isNull(), 1).otherwise(zone).alias("__zone"))
    counts = zoned.groupBy(*keys, "__zone", F.when(F.col("__zone") % 2 == 1, F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    placed = counts.withColumn("__end", F.sum("__c").over(W.partitionBy(*keys).orderBy("__zone", "__v"))).withColumn("__start", F.col("__end") - F.col("__c"))
    joined = K.joined(placed, first.drop("__edges"), keys)
    sure = F.when(F.col("__zone") % 2 == 1, F.col("__v")).otherwise(F.raise_error(F.lit("a rank lies outside of its bracket")).cast(df.schema[value].dataType))
    picked = []
    for q in at:
        for rank in (F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1))):
            picked.append(F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), sure)).alias(f"__p{len(picked)}"))
    made = joined.groupBy(*keys).agg(F.first("n").alias("n"), *(F.first(k).alias(k) for k in more or {}), *picked)
    share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    between = [F.col(f"__p{2 * k}") + (F.col(f"__p{2 * k + 1}") - F.col(f"__p{2 * k}")) * share(q) for k, q in enumerate(at)]
    return made.select(*by, "n", F.array(*between).alias("q"), *(more or {}))


def latency_stats(df: DataFrame, value: str, *by: str, batch: Column | int = 1) -> DataFrame:
    """p50 and p95 by linear interpolation, mean, decisions per second and amortized time; the first call and the others alone. A group without any value has no row."""
    n = F.lit(batch) if isinstance(batch, int) else batch
    made = quantiles(df, value, [0.5, 0.95], *by, more={"mean_ms": F.avg(value), "batch": F.avg(n.cast("double"))})
    return made.select(*by, "n", F.get("q", F.lit(0)).alias("p50_ms"), F.get("q", F.lit(1)).alias("p95_ms"), "mean_ms", (1000 * F.col("batch") / F.col("mean_ms")).alias("per_second"), (F.col("mean_ms") / F.col("batch")).alias("amortized_ms"))


def first_and_rest(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """The first sample of each group and the mean of the others."""
    made = df.groupBy(*by).agg(F.min_by(value, order).alias("first_ms"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return made.select(*by, "first_ms", F.try_divide(F.col("s") - F.col("first_ms"), F.col("n") - 1).alias("rest_ms"))


def telemetry_summary(df: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """Maximum and mean of each numeric field where it is present."""
    long = df.select(*by, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(list(by), fields, "field", "value").where("value is not null")
    return long.groupBy(*by, "field").agg(F.max("value").alias("most"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def same_commit_rows(log: DataFrame, step: int) -> DataFrame:
    """Log rows up to the committed step, without completion marks."""
    return log.where((F.coalesce("step", F.lit(0)) <= step) & (F.col("kind") != "train_complete"))


def last_committed(log: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    """The last ``train`` row at or before the step, by position in the log."""
    rows = log.where((F.col("kind") == "train") & (F.col("step") <= step))
    return rows.agg(F.max_by(F.struct(*log.columns), pos).alias("r")).where("r is not null").select("r.*")


def best_so_far(df: DataFrame, by: str, score: str = "score", step: str = "step") -> DataFrame:
    """``df`` with the running best score and whether the row set it: strictly greater than all before.

    The best of earlier ranges of steps is carried on, so no task goes through all steps of a group.
    """
    ranges = carried(in_ranges(df, [by], [step]), [by], F.max(score), "__best", F.max)
    inside = W.partitionBy(by, "__range").orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    marked = ranges.withColumn("__best", F.greatest("__best", F.max(score).over(inside)))
    return marked.select(*df.columns, F.coalesce(F.col(score) > F.col("__best"), F.lit(True)).alias("improves"), F.greatest(score, "__best").alias("best"))


def select_checkpoint(df: DataFrame, by: str, score: str = "score", step: str = "step") -> DataFrame:
    """The earliest step of the best score, by group."""
    return df.groupBy(by).agg(F.max_by(F.struct(F.col(step), F.col(score)), F.struct(F.col(score), -F.col(step))).alias("r")).select(by, "r.*")


def consumed_counts(log: DataFrame, consumed: str = "consumed", pos: str = "pos") -> DataFrame:
    """The last count per dataset in a log of running counts."""
    each = log.select(pos, F.explode(consumed).alias("dataset", "n"))
    return each.groupBy("dataset").agg(F.max_by("n", pos).alias("n"))


def budget_deltas(before: DataFrame, after: DataFrame, metrics: list[str], key: str = "dataset", fingerprint: str | None = None) -> DataFrame:
    """Each metric before and after by key, and the change of accuracy in points; with ``fingerprint``, rows of unequal data fail."""
    named = lambda df, side: df.select(key, *(F.col(m).alias(f"{m}_{side}") for m in metrics), *([F.col(fingerprint).alias(f"__{side}")] if fingerprint else []))
    joined = named(before, "before").join(named(after, "after"), key)
    if fingerprint:
        same = F.when(F.col("__before") == F.col("__after"), True).otherwise(F.raise_error(F.lit("the partitions of the two runs differ")).cast("boolean"))
        joined = joined.where(same).drop("__before", "__after")
    return joined.withColumn("accuracy_points", 100 * (F.col("accuracy_after") - F.col("accuracy_before")))
