"""The three workloads end to end: prepare a mixture, evaluate predictions, compare systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut, width
from ballast.operators import budget, calibrate, compare, guard, isolate, metrics, mixture, report
from ballast.operators.rowmetrics import row_metrics
from ballast.plans.fixtures import PRED, examples, predictions, sql_print, sql_rows, table
from ballast.plans.mixture import _LEAF, _REC, _TOKENS
from ballast.plans.metrics import _F1, _MEANS, _ece, rounded, sql_fitted
from ballast.plans.registry import query
from ballast.sources import tables


def prepare(sources: list[DataFrame], frozen: DataFrame, most_tokens: int = 2048) -> DataFrame:
    """The tagged mixture of all sources: kept rows have no ``reason``, the others their first one; ``tokens`` are those of rows that got so far.

    Rows are put under their components, split conflicts and repeated inputs are tagged, then whole components that hold
    frozen text (the flag is set on all rows, dropped ones among them), then what is over the token budget. sources: rows of the common form;
    frozen: ``(leaf, key)``. All is decided on keys; rows are joined with what was decided once.
    """
    whole = mixture.concatenate(sources, "row_index")
    reasons = cut(isolate.isolation_reasons(whole).select("id", "input_pos", "root", "reason"))
    flagged = guard.benchmark_overlap(whole.withColumn("state_leaves", F.array("state")), frozen)
    bad = reasons.select("id", "root").join(apart(flagged, "id"), "id", "left_semi").select("root").distinct().withColumn("overlaps", F.lit("frozen_benchmark_overlap"))
    judged = reasons.join(apart(bad, "root"), "root", "left").select("id", "input_pos", "root", mixture.first_reason(F.col("reason"), F.col("overlaps")).alias("earlier"))
    rows = whole.join(judged, ["id", "input_pos"]).withColumn("group", F.col("root")).drop("root")
    counted = budget.token_budget(rows, F.when(F.col("earlier").isNull(), budget.count_pieces(F.col("state"))), most_tokens)
    return counted.withColumn("reason", mixture.first_reason(F.col("earlier"), F.col("reason"))).drop("earlier")


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    ex = examples(spark, d).withColumn("row_index", F.col("input_pos")).drop("input_pos")
    halves = [ex.where(F.pmod("row_index", F.lit(2)) == k) for k in (0, 1)]
    frozen = examples(spark, d).where("split = 'test'").select(F.col("state").alias("text")).unionByName(table(spark, d, "benchmark").select("text"))
    return prepare(halves, guard.frozen_leaves(frozen), 2048)


_PREPARED = f"""{_REC.replace('\nex AS (', '\nex AS MATERIALIZED (').replace('row_number() OVER (PARTITION BY dataset, root, state ORDER BY input_pos)', 'row_number() OVER (PARTITION BY dataset, root, state ORDER BY input_pos % 2, input_pos)')},
frozen AS MATERIALIZED (SELECT DISTINCT {sql_print('text')} AS f FROM (SELECT state AS text FROM ex WHERE split = 'test' UNION ALL SELECT text FROM benchmark)),
flagged AS MATERIALIZED (SELECT id FROM ex WHERE {_LEAF.format(x='state')} AND {sql_print('state')} IN (SELECT f FROM frozen) UNION SELECT id FROM ex WHERE {_LEAF.format(x='substr(state, 1, 3000)')} AND {sql_print('substr(state, 1, 3000)')} IN (SELECT f FROM frozen)),
bad AS (SELECT DISTINCT root FROM rooted JOIN flagged USING (id)),
tagged AS (SELECT j.id, j.dataset, j.split, j.root, CASE WHEN j.conflict THEN 'cross_split_group' WHEN s.duplicate THEN 'duplicate_input' WHEN j.root IN (SELECT root FROM bad) THEN 'frozen_benchmark_overlap' WHEN {_TOKENS.replace('text', 'j.state')} > 2048 THEN 'token_budget' END AS reason
  FROM judged j LEFT JOIN survive s ON j.id = s.id)"""


@query("prepare_mixture", f'WITH {_PREPARED} SELECT id, dataset, split, root AS "group", reason FROM tagged')
def _(spark, d):
    return _mixture(spark, d).select("id", "dataset", "split", "group", "reason")


@query("prepare_counts", f"WITH {_PREPARED} SELECT dataset, split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM tagged GROUP BY ALL")
def _(spark, d):
    return _mixture(spark, d).groupBy("dataset", "split", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# Evaluation: both calibrations of each row in one pass
TEMPERATURES = {"choice": 1.8, "noul": 3.5, "score": 1.25}
_T = "CASE WHEN mode = 'uncalibrated' THEN 1.0 WHEN type = 'choice' THEN 1.8 WHEN type = 'noul' THEN 3.5 ELSE 1.25 END"
_MODES = f"{PRED}, modes AS (SELECT * FROM pred, (VALUES ('uncalibrated'), ('calibrated')) v(mode)), {sql_rows('logits', _T, 'modes')}"


def evaluate(df: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Means, calibration error and macro F1 by dataset and calibration; temperatures: ``(type, temperature)``."""
    both = df.join(temperatures, "type").withColumn("mode", F.explode(F.array(F.lit("uncalibrated"), F.lit("calibrated"))))
    rows = cut(row_metrics(both, F.when(F.col("mode") == "calibrated", F.col("temperature")).otherwise(F.lit(1.0))))
    return metrics.metrics_by(rows, "dataset", "mode").join(metrics.macro_f1(rows, "dataset", "mode"), ["dataset", "mode"])


@query("evaluate_predictions", f"""WITH {_MODES}, {_F1.replace('dataset', 'dataset, mode')}, m AS (SELECT dataset, mode, {_MEANS} FROM rm GROUP BY ALL)
SELECT m.*, round(e, 6) AS ece_15, round(macro_f1, 6) AS macro_f1 FROM m JOIN {_ece('dataset, mode')} x USING (dataset, mode) JOIN f1 USING (dataset, mode)""")
def _(spark, d):
    fixed = spark.createDataFrame(list(TEMPERATURES.items()), "type string, temperature double")
    return rounded(evaluate(predictions(spark, d), fixed))


@query("evaluate_fitted", f"""WITH {sql_fitted('type')}, modes AS (SELECT pred.*, mode, temperature FROM pred JOIN fitted USING (type), (VALUES ('uncalibrated'), ('calibrated')) v(mode)),
{sql_rows('logits', "CASE WHEN mode = 'calibrated' THEN temperature ELSE 1.0 END", 'modes')}
SELECT dataset, mode, round(avg(nll), 5) AS nll, round(avg(accuracy), 6) AS accuracy, count(*) AS n FROM rm GROUP BY ALL""")
def _(spark, d):
    """Temperatures fitted on the rows themselves."""
    p = cut(predictions(spark, d))
    made = evaluate(p, calibrate.fit_temperatures(p, "type").select("type", "temperature"))
    return made.select("dataset", "mode", F.round("nll", 5).alias("nll"), F.round("accuracy", 6).alias("accuracy"), "n")


@query("run_comparison", f"""WITH {_MODES}, m AS (SELECT dataset, mode, avg(accuracy) AS a, avg(nll) AS l FROM rm GROUP BY ALL)
SELECT u.dataset, round(u.a, 6) AS accuracy_before, round(u.l, 6) AS nll_before, round(c.a, 6) AS accuracy_after, round(c.l, 6) AS nll_after, round(c.a - u.a, 6) AS accuracy_change, round(c.l - u.l, 6) AS nll_change
FROM m u JOIN m c ON u.dataset = c.dataset AND u.mode = 'uncalibrated' AND c.mode = 'calibrated'""")
def _(spark, d):
    fixed = spark.createDataFrame(list(TEMPERATURES.items()), "type string, temperature double")
    p = predictions(spark, d)
    made = cut(evaluate(p, fixed))
    # the second run's rows come in another order and another number of partitions
    prints = [tables.partition_fingerprint(x.withColumn("split", F.lit("test"))) for x in (p, p.repartition(width(spark), F.xxhash64("id")))]
    return rounded(compare.run_comparison(made.where("mode = 'uncalibrated'"), made.where("mode = 'calibrated'"), *prints, ["accuracy", "nll"]))


@query("report_table", f"""WITH {PRED}, {sql_rows()}, {sql_rows('other_logits', '1.0', 'pred', 'ot')},
a AS (SELECT 'ours' AS system, dataset, avg(accuracy) AS accuracy, avg(nll) AS nll FROM rm GROUP BY ALL UNION ALL SELECT 'reference', dataset, avg(accuracy), avg(nll) FROM ot GROUP BY ALL)
SELECT 'quality' AS figure, system, dataset, metric, round(value, 6) AS value FROM (SELECT system, dataset, 'accuracy' AS metric, accuracy AS value FROM a UNION ALL SELECT system, dataset, 'nll', nll FROM a)""")
def _(spark, d):
    p = predictions(spark, d)
    sides = [row_metrics(p, logits=c).groupBy("dataset").agg(F.avg("accuracy").alias("accuracy"), F.avg("nll").alias("nll")).withColumn("system", F.lit(s)) for s, c in (("ours", "logits"), ("reference", "other_logits"))]
    wide = reduce(lambda a, b: a.unionByName(b), sides)
    return rounded(report.chart_rows(wide, "quality", ["system", "dataset"], ["accuracy", "nll"]).select("figure", "system", "dataset", "metric", "value"))
