"""Queries over logs, latencies and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators import compare, report
from ballast.plans.fixtures import table
from ballast.plans.metrics import rounded
from ballast.plans.registry import query


def _events(spark, d):
    return table(spark, d, "events")


def _log(spark, d):
    """Events as a training log: steps in time order, kinds by type."""
    e = _events(spark, d)
    return e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 10 == 9, F.lit(None)).otherwise(F.floor(F.col("event_id") / 4)).cast("long").alias("step"), F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "purchase", "train_complete").otherwise("dev").alias("kind"), "value", "user_id")


_LOG = "log AS (SELECT event_id AS pos, CASE WHEN event_id % 10 = 9 THEN NULL ELSE CAST(floor(event_id / 4.0) AS BIGINT) END AS step, CASE event_type WHEN 'click' THEN 'train' WHEN 'purchase' THEN 'train_complete' ELSE 'dev' END AS kind, value, user_id FROM events)"


@query("latency_stats", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(avg(value), 6) AS mean_ms, round(4000 / avg(value), 6) AS per_second, round(avg(value) / 4, 6) AS amortized_ms FROM events GROUP BY 1")
def _(spark, d):
    return rounded(report.latency_stats(_events(spark, d), "value", "event_type", batch=4))


@query("first_and_rest", "SELECT event_type, round(min_by(value, event_id), 6) AS first_ms, round((sum(value) - min_by(value, event_id)) / (count(*) - 1), 6) AS rest_ms FROM events GROUP BY 1")
def _(spark, d):
    return rounded(report.first_and_rest(_events(spark, d), "value", "event_id", "event_type"))


@query("telemetry_summary", "SELECT event_type, field, round(max(v), 6) AS most, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT event_type, 'value' AS field, value AS v FROM events UNION ALL SELECT event_type, 'gpu', CAST(CASE WHEN user_id % 3 <> 0 THEN user_id END AS DOUBLE) FROM events) WHERE v IS NOT NULL GROUP BY ALL")
def _(spark, d):
    e = _events(spark, d).withColumn("gpu", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return rounded(report.telemetry_summary(e, ["value", "gpu"], "event_type"))


@query("same_commit_rows", f"WITH {_LOG} SELECT pos, kind FROM log WHERE coalesce(step, 0) <= 100 AND kind <> 'train_complete'")
def _(spark, d):
    return report.same_commit_rows(_log(spark, d), 100).select("pos", "kind")


@query("last_committed", f"WITH {_LOG} SELECT pos, step, kind FROM log WHERE kind = 'train' AND step <= 100 ORDER BY pos DESC LIMIT 1")
def _(spark, d):
    return report.last_committed(_log(spark, d), 100).select("pos", "step", "kind")


@query("best_so_far", "SELECT event_id, coalesce(value > m, true) AS improves, round(greatest(value, m), 6) AS best FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)")
def _(spark, d):
    made = report.best_so_far(_events(spark, d), "user_id", "value", "event_id")
    return rounded(made.select("event_id", "improves", "best"))


@query("best_checkpoint", "SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return rounded(report.select_checkpoint(_events(spark, d), "user_id", "value", "event_id"))


@query("consumed_counts", "SELECT event_type AS dataset, max(event_id) AS n FROM events GROUP BY 1")
def _(spark, d):
    log = _events(spark, d).select(F.col("event_id").alias("pos"), F.create_map("event_type", "event_id").alias("consumed"))
    return report.consumed_counts(log)


@query("resume_pending", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    e = _events(spark, d)
    return compare.already_scored(e.select("event_id", "user_id"), e.where("event_id % 3 = 0"), "event_id").select("event_id")


@query("flatten_metrics", "SELECT event_id, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(spark, d):
    parsed = _events(spark, d).withColumn("m", F.from_json("props", "map<string,double>"))
    return report.flatten_metrics(parsed, "m", "event_id")


@query("prefixed_fields", "SELECT event_id, user_id AS memory_user, round(value, 6) AS memory_value FROM events")
def _(spark, d):
    nested = _events(spark, d).select("event_id", F.struct(F.col("user_id").alias("user"), "value").alias("memory"))
    return rounded(report.prefixed(nested, "memory", "event_id"))


@query("chart_rows", "WITH m AS (SELECT event_type AS task, avg(value) AS mean, CAST(max(value) AS DOUBLE) AS most FROM events GROUP BY 1) SELECT 'latency' AS figure, task, metric, round(value, 6) AS value FROM (SELECT task, 'mean' AS metric, mean AS value FROM m UNION ALL SELECT task, 'most', most FROM m)")
def _(spark, d):
    wide = _events(spark, d).groupBy(F.col("event_type").alias("task")).agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return rounded(report.chart_rows(wide, "latency", ["task"], ["mean", "most"]).select("figure", "task", "metric", "value"))


_RUN = "SELECT event_type AS dataset, avg(CAST({p} AS INT)) AS accuracy, avg(value) AS nll FROM events GROUP BY 1"


@query("budget_deltas", f"SELECT dataset, round(a.accuracy, 6) AS accuracy_before, round(b.accuracy, 6) AS accuracy_after, round(a.nll, 6) AS nll_before, round(b.nll, 6) AS nll_after, round(100 * (b.accuracy - a.accuracy), 6) AS accuracy_points FROM ({_RUN.format(p='user_id % 2 = 0')}) a JOIN ({_RUN.format(p='user_id % 3 = 0')}) b USING (dataset)")
def _(spark, d):
    side = lambda m: _events(spark, d).groupBy(F.col("event_type").alias("dataset")).agg(F.avg((F.col("user_id") % m == 0).cast("double")).alias("accuracy"), F.avg("value").alias("nll"), F.count("*").alias("print"))
    made = report.budget_deltas(side(2), side(3), ["accuracy", "nll"], fingerprint="print")
    return rounded(made.select("dataset", "accuracy_before", "accuracy_after", "nll_before", "nll_after", "accuracy_points"))
