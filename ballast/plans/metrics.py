"""Queries over prediction tables: row metrics, aggregates, calibration, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions.durable import cut
from ballast.operators import calibrate, compare, metrics, prompts, rowmetrics
from ballast.operators.rowmetrics import row_metrics
from ballast.plans.fixtures import PRED, predictions, sql_bucket, sql_dot, sql_rows, sql_softmax, table
from ballast.plans.registry import query


def rounded(df, *keep):
    """``df`` with all doubles but ``keep`` rounded to six places, the precision that engines agree on."""
    return df.select(*((F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c)) for c, t in df.dtypes))


ROWS = f"{PRED}, {sql_rows()}"
OTHER = f"{PRED}, {sql_rows()}, {sql_rows('other_logits', '1.0', 'pred', 'ot')}"
_MEANS = "round(avg(accuracy), 6) AS accuracy, round(avg(soft_accuracy), 6) AS soft_accuracy, round(avg(nll), 6) AS nll, round(avg(brier_sum), 6) AS brier_sum, round(avg(brier_per_candidate), 6) AS brier_per_candidate, 1.0::DOUBLE AS schema_pass, round(avg(score_mae), 6) AS score_mae, round(avg(rps), 6) AS rps, count(*) AS n"
_BIN = "CAST(list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i / 15.0::DOUBLE < confidence THEN 1 ELSE 0 END)) - 1 AS INT)"


def _ece(by: str, source: str = "rm") -> str:
    return f"(SELECT {by}, sum(n * abs(c - a)) / sum(n) AS e FROM (SELECT {by}, {_BIN} AS bin, count(*) AS n, avg(confidence) AS c, avg(accuracy) AS a FROM {source} GROUP BY ALL) GROUP BY ALL)"


@query("array_maths", f"WITH {PRED} SELECT id, list_position(logits, list_max(logits)) - 1 AS first_max, round({sql_dot('logits', 'other_logits')}, 6) AS dot, round(list_max(list_transform(list_zip(logits, other_logits), lambda z: abs(z[1] - z[2]))), 6) AS far, round(sqrt({sql_dot('logits', 'logits')}), 6) AS norm, round(list_sum(list_slice(logits, 1, 2)), 6) AS first_two FROM pred")
def _(spark, d):
    a, b = F.col("logits"), F.col("other_logits")
    return rounded(predictions(spark, d).select("id", A.argmax(a).alias("first_max"), A.dot(a, b).alias("dot"), A.linf(a, b).alias("far"), A.l2(a).alias("norm"), F.get(A.cumulative(a), F.lit(1)).alias("first_two")))


@query("row_metrics", f"WITH {ROWS} SELECT id, CAST(guess AS INT) AS guess, accuracy, soft_accuracy, round(confidence, 6) AS confidence, round(nll, 6) AS nll, round(brier_sum, 6) AS brier_sum, round(brier_per_candidate, 6) AS brier_per_candidate, round(score_mae, 6) AS score_mae, round(rps, 6) AS rps FROM rm")
def _(spark, d):
    return rounded(row_metrics(predictions(spark, d)).select("id", "guess", "accuracy", "soft_accuracy", "confidence", "nll", "brier_sum", "brier_per_candidate", "score_mae", "rps"))


@query("metric_means", f"WITH {ROWS} SELECT type, {_MEANS} FROM rm GROUP BY type")
def _(spark, d):
    return rounded(metrics.metric_means(row_metrics(predictions(spark, d)), "type"))


@query("reliability", f"""WITH {ROWS}, b AS (SELECT dataset, {_BIN} AS bin, count(*) AS n, avg(confidence) AS c, avg(accuracy) AS a FROM rm GROUP BY ALL)
SELECT g.dataset, CAST(i AS INT) AS bin, round(i / 15.0, 6) AS lower, round((i + 1) / 15.0, 6) AS upper, coalesce(n, 0) AS n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM (SELECT DISTINCT dataset FROM pred) g, range(0, 15) r(i) LEFT JOIN b ON b.dataset = g.dataset AND b.bin = i""")
def _(spark, d):
    return rounded(metrics.reliability(row_metrics(predictions(spark, d)), "dataset"))


@query("ece_15", f"WITH {ROWS} SELECT dataset, round(e, 6) AS ece_15 FROM {_ece('dataset')}")
def _(spark, d):
    return rounded(metrics.ece(row_metrics(predictions(spark, d)), "dataset"))


_F1 = """f1 AS (SELECT dataset, avg(f) AS macro_f1 FROM (SELECT dataset, c, coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(w), 0), 0) AS f FROM (
  SELECT dataset, gold AS c, CAST(guess = gold AS INT) AS tp, CAST(guess <> gold AS INT) AS w FROM rm UNION ALL SELECT dataset, guess, 0, CAST(guess <> gold AS INT) FROM rm) GROUP BY ALL) GROUP BY ALL)"""


@query("macro_f1", f"WITH {ROWS}, {_F1} SELECT dataset, round(macro_f1, 6) AS macro_f1 FROM f1")
def _(spark, d):
    return rounded(metrics.macro_f1(row_metrics(predictions(spark, d)), "dataset"))


@query("metrics_by_dataset", f"WITH {ROWS}, {_F1}, m AS (SELECT dataset, {_MEANS} FROM rm GROUP BY dataset) SELECT m.*, round(e, 6) AS ece_15, round(macro_f1, 6) AS macro_f1 FROM m JOIN {_ece('dataset')} x USING (dataset) JOIN f1 USING (dataset)")
def _(spark, d):
    return rounded(metrics.metrics_by_dataset(cut(row_metrics(predictions(spark, d)))))


@query("macro_accuracy", f"WITH {ROWS} SELECT round(avg(a), 6) AS macro_accuracy FROM (SELECT avg(accuracy) AS a FROM rm GROUP BY dataset)")
def _(spark, d):
    return rounded(metrics.macro_accuracy(metrics.metric_means(row_metrics(predictions(spark, d)), "dataset")))


@query("metrics_by_primitive", f"WITH {ROWS}, m AS (SELECT type, CAST(k AS INT) AS candidates, {_MEANS} FROM rm GROUP BY ALL) SELECT m.*, round(e, 6) AS ece_15 FROM m JOIN {_ece('type')} x USING (type)")
def _(spark, d):
    return rounded(metrics.metrics_by_primitive_candidates(row_metrics(predictions(spark, d))))


@query("answers_from_logits", f"""WITH {PRED}, q AS (SELECT *, {sql_softmax('logits')} AS p FROM pred)
SELECT id, round(CASE WHEN type = 'noul' THEN list_max(p) ELSE least(1.0, greatest(0.0, 1 + list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(k))) END, 6) AS confidence,
  CASE WHEN type = 'noul' THEN round(p[2], 6) END AS noul, CASE WHEN type = 'choice' THEN 'c' || (list_position(p, list_max(p)) - 1) END AS choice,
  CASE WHEN type = 'score' THEN round(list_sum(list_transform(list_zip(p, range(0, k)), lambda z: z[1] * z[2])), 6) END AS score FROM q""")
def _(spark, d):
    labelled = predictions(spark, d).withColumn("labels", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    return rounded(rowmetrics.answers_from_logits(labelled).select("id", "confidence", "noul", "choice", "score"))


@query("proper_score_reward", f"""WITH {ROWS} SELECT id, round(greatest(ln(greatest(p[gold + 1], 1e-12)), -9.21) + 0.75 * p[gold + 1] / greatest(sqrt({sql_dot('p', 'p')}), 1e-9) - coalesce(rps, 0), 6) AS reward FROM rm""")
def _(spark, d):
    return rounded(rowmetrics.proper_score_reward(predictions(spark, d).withColumn("ordinal", F.col("type") == "score")).select("id", "reward"))


@query("valid_distributions", f"WITH {PRED} SELECT id FROM pred WHERE id % 4 <> 0")
def _(spark, d):
    p = A.softmax(F.col("logits"))
    broken = F.when(F.col("id") % 4 == 0, F.transform(p, lambda x: x * 1.5)).otherwise(p)
    return predictions(spark, d).withColumn("q", broken).where(A.valid_distribution(F.col("q"))).select("id")


def sql_fitted(by: str, source: str = "pred", before: str = PRED, least: int = 10) -> str:
    """``fitted(by..., n, temperature)`` by halving the range of the inverse temperature by the sign of the loss's slope, fifty times."""
    p = "list_transform(logits, lambda z: exp((z - list_max(logits)) * beta))"
    slope = f"(list_sum(list_transform(list_zip({p}, logits), lambda z: z[1] * z[2])) / list_sum({p}) - {sql_dot('target', 'logits')})"
    return f"""RECURSIVE {before},
halve AS (SELECT {by}, count(*) AS n, 0.1::DOUBLE AS low, 10.0::DOUBLE AS high, 0 AS round FROM {source} GROUP BY ALL
  UNION ALL SELECT {by}, n, CASE WHEN avg({slope}) < 0 THEN beta ELSE low END, CASE WHEN avg({slope}) < 0 THEN high ELSE beta END, round + 1
  FROM (SELECT *, (low + high) / 2 AS beta FROM halve WHERE round < 50) s JOIN {source} USING ({by}) GROUP BY {by}, n, low, high, beta, round),
fitted AS (SELECT {by}, n, CASE WHEN n < {least} THEN 1.0 ELSE 2 / (low + high) END AS temperature FROM halve WHERE round = 50)"""


@query("temperature_fit", f"WITH {sql_fitted('type')} SELECT type, n, round(temperature, 5) AS temperature FROM fitted")
def _(spark, d):
    return calibrate.fit_temperatures(predictions(spark, d), "type").withColumn("temperature", F.round("temperature", 5))


@query("temperature_lookup", f"WITH {PRED} SELECT id, CASE WHEN k = 10 THEN 1.5::DOUBLE WHEN type = 'noul' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS temperature FROM pred")
def _(spark, d):
    fine = spark.createDataFrame([("choice", 10, 1.5)], "type string, candidates int, temperature double")
    rough = spark.createDataFrame([("choice", 9.0), ("noul", 0.5)], "type string, temperature double")
    return calibrate.temperature_lookup(predictions(spark, d).withColumn("candidates", F.col("k")), fine, rough).select("id", "temperature")


@query("half_rank", f"WITH {PRED} SELECT id, row_number() OVER (PARTITION BY dataset ORDER BY id) <= floor(count(*) OVER (PARTITION BY dataset) / 2.0) AS in_first_half FROM pred")
def _(spark, d):
    return calibrate.half_rank(predictions(spark, d), "dataset", "id").select("id", "in_first_half")


def _halves(spark, d):
    return calibrate.half_split_calibration(predictions(spark, d).select(F.col("dataset").alias("suite"), F.col("id").alias("case"), "type", "logits", "target"))


_FIT = sql_fitted("dataset, type, k", "firsts", f"{PRED}, h AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) > floor(count(*) OVER (PARTITION BY dataset) / 2.0) AS second, count(*) OVER (PARTITION BY dataset) AS valid FROM pred), firsts AS (SELECT * FROM h WHERE NOT second AND valid >= 60)")
_HALF = f"""{_FIT}, hs AS (SELECT h.*, mode, CASE WHEN mode = 'refit' THEN coalesce(CASE WHEN n >= 25 THEN temperature END, 1.0) ELSE 1.0 END AS t FROM h LEFT JOIN fitted USING (dataset, type, k), (VALUES ('shipped'), ('refit')) v(mode) WHERE second AND valid >= 60),
{sql_rows('logits', 't', 'hs')}"""


@query("half_split_calibration", f"WITH {_HALF} SELECT dataset AS suite, mode, count(*) AS n_heldout, round(avg(nll), 5) AS nll, round(avg(accuracy), 5) AS accuracy, round(max(e), 5) AS ece_15 FROM rm JOIN {_ece('dataset, mode')} x USING (dataset, mode) GROUP BY dataset, mode")
def _(spark, d):
    h = _halves(spark, d)
    return h.select("suite", "mode", "n_heldout", *(F.round(c, 5).alias(c) for c in ("nll", "accuracy", "ece_15")))


@query("mean_calibration", f"WITH {_HALF} SELECT mode, round(avg(e), 5) AS mean_ece, round(avg(e) FILTER (dataset IN ('d0', 'd1')), 5) AS mean_ece_published, count(*) AS suites FROM {_ece('dataset, mode')} GROUP BY mode")
def _(spark, d):
    m = calibrate.mean_calibration(_halves(spark, d), ["d0", "d1"])
    return m.select("mode", F.round("mean_ece", 5).alias("mean_ece"), F.round("mean_ece_published", 5).alias("mean_ece_published"), "suites")


# Comparison of two systems
def _two(spark, d):
    p = predictions(spark, d)
    ours = row_metrics(p).select("id", "dataset", "p", "guess", (F.col("accuracy") == 1).alias("correct"))
    other = row_metrics(p.where("id % 10 <> 3"), logits="other_logits").select("id", "p", "guess", (F.col("accuracy") == 1).alias("correct"))
    return ours, other


_BOTH = f"{OTHER}, two AS (SELECT rm.id, rm.dataset, rm.p, ot.p AS ref_p, rm.guess, ot.guess AS ref_guess, rm.accuracy = 1 AS correct, ot.accuracy = 1 AS ref_correct FROM rm JOIN ot ON rm.id = ot.id WHERE rm.id % 10 <> 3)"


@query("same_id_join", f"WITH {PRED} SELECT id FROM pred WHERE id % 10 <> 3")
def _(spark, d):
    return compare.same_id_join(*_two(spark, d))[0].select("id")


@query("same_id_missing", f"WITH {PRED} SELECT id FROM pred WHERE id % 10 = 3")
def _(spark, d):
    ours, other = _two(spark, d)
    return compare.same_id_join(other, ours)[1]


@query("paired_join", f"WITH {_BOTH} SELECT id, CAST(guess AS INT) AS guess, CAST(ref_guess AS INT) AS ref_guess, correct, ref_correct FROM two")
def _(spark, d):
    return compare.paired(*_two(spark, d)).select("id", "guess", "ref_guess", "correct", "ref_correct")


@query("contingency", f"WITH {_BOTH} SELECT dataset, count(*) FILTER (correct AND ref_correct) AS both_correct, count(*) FILTER (correct AND NOT ref_correct) AS ours_only, count(*) FILTER (NOT correct AND ref_correct) AS reference_only, count(*) FILTER (NOT correct AND NOT ref_correct) AS both_wrong, count(*) FILTER (guess = ref_guess) AS same_answer, count(*) AS n, count(*) FILTER (correct = ref_correct) AS same_correctness FROM two GROUP BY dataset")
def _(spark, d):
    return compare.contingency(compare.paired(*_two(spark, d)), "dataset")


_GAP = "list_max(list_transform(list_zip(p, ref_p), lambda z: abs(z[1] - z[2])))"


@query("paired_delta", f"WITH {_BOTH} SELECT dataset, round(avg(CAST(guess = ref_guess AS INT)), 6) AS agreement, round(avg(CAST(correct AS INT) - CAST(ref_correct AS INT)), 6) AS accuracy_delta, round(max({_GAP}), 6) AS max_difference, round(avg({_GAP}), 6) AS mean_difference, count(*) AS n FROM two GROUP BY dataset")
def _(spark, d):
    return rounded(compare.paired_delta(compare.paired(*_two(spark, d)), "dataset"))


@query("bootstrap_interval", f"WITH {_BOTH} SELECT dataset, count(*) AS n, round(avg(CAST(correct AS INT) - CAST(ref_correct AS INT)), 6) AS mean_delta, true AS covers FROM two GROUP BY dataset")
def _(spark, d):
    deltas = compare.paired(*_two(spark, d)).select("dataset", (F.col("correct").cast("int") - F.col("ref_correct").cast("int")).alias("delta"))
    made = calibrate.paired_bootstrap(deltas, "dataset")
    return rounded(made.select("dataset", "n", "mean_delta", F.col("mean_delta").between(F.col("low"), F.col("high")).alias("covers")))


@query("saved_target_check", f"WITH {PRED} SELECT id, CASE WHEN id % 50 = 1 THEN 'duplicate' WHEN id % 50 = 2 THEN 'target' ELSE 'unknown' END AS reason FROM (SELECT id FROM pred WHERE id % 50 IN (1, 2) UNION ALL SELECT -1 - id FROM pred WHERE id % 50 = 3)")
def _(spark, d):
    p = predictions(spark, d).select("id", "target")
    broken = p.withColumn("target", F.when(F.col("id") % 50 == 2, F.transform("target", lambda x: x / 2)).otherwise(F.col("target")))
    saved = broken.unionByName(p.where("id % 50 = 1")).unionByName(p.where("id % 50 = 3").withColumn("id", -1 - F.col("id")))
    return compare.saved_target_check(saved, p)


@query("engine_datasets", f"WITH {PRED} SELECT id, dataset FROM pred WHERE dataset IN ('d1', 'd4')")
def _(spark, d):
    return compare.engine_datasets(predictions(spark, d), ["d1", "d4"]).select("id", "dataset")


# Suites: datasets as suites, every seventh row an error
def _suites(spark, d):
    p = row_metrics(predictions(spark, d))
    return p.select(F.concat(F.when(F.col("id") % 2 == 0, "apps/").otherwise("colab/"), F.col("dataset")).alias("suite"), F.col("id").alias("case"), (F.col("id") % 7 != 0).alias("valid"), F.col("p").alias("probabilities"), "gold", "type")


_SUITES = f"{ROWS}, s AS (SELECT CASE WHEN id % 2 = 0 THEN 'apps/' ELSE 'colab/' END || dataset AS suite, id, id % 7 <> 0 AS valid, p, guess, gold, type, k FROM rm)"


_HARD = "log_p AS (SELECT suite AS dataset, type, k, gold, list_transform(p, lambda x: ln(greatest(x, 1e-12))) AS logits, list_transform(range(0, k), lambda i: CASE WHEN i = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target FROM s WHERE valid)"


@query("suite_metrics", f"""WITH {_SUITES}, {_HARD}, {sql_rows(source='log_p', name='hm')}, {_F1.replace('rm', 'hm')},
m AS (SELECT dataset AS suite, {', '.join(f'avg({x}) AS {x}' for x in ('nll', 'brier_sum', 'brier_per_candidate', 'soft_accuracy', 'score_mae', 'rps'))} FROM hm GROUP BY dataset)
SELECT s.suite, count(*) AS n_planned, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS failures, round(count(*) FILTER (valid AND guess = gold) / count(*), 6) AS accuracy,
  {', '.join(f'round(max(m.{x}), 6) AS {x}' for x in ('nll', 'brier_sum', 'brier_per_candidate', 'soft_accuracy', 'score_mae', 'rps'))}, round(max(e), 6) AS ece_15, round(max(macro_f1), 6) AS macro_f1
FROM s LEFT JOIN m USING (suite) LEFT JOIN {_ece('dataset', 'hm')} x ON x.dataset = s.suite LEFT JOIN f1 ON f1.dataset = s.suite GROUP BY s.suite""")
def _(spark, d):
    return rounded(compare.suite_metrics(_suites(spark, d)))


@query("class_balance", f"""WITH {_SUITES}, c AS (SELECT suite, gold, count(*) AS n, count(*) FILTER (valid AND guess = gold) AS hit FROM s GROUP BY ALL)
SELECT suite, count(*) AS classes, round(max(n) / sum(n), 6) AS majority_accuracy, round(avg(hit / n), 6) AS balanced_accuracy,
  string_agg(gold || ':' || n, ',' ORDER BY gold) AS class_counts, list(round(hit / n, 6) ORDER BY gold) AS class_recall FROM c GROUP BY suite""")
def _(spark, d):
    made = rounded(compare.class_balance(_suites(spark, d)))
    counts = F.array_join(F.transform(F.map_entries("class_counts"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return made.withColumn("class_counts", counts).withColumn("class_recall", F.transform(F.map_values("class_recall"), lambda x: F.round(x, 6)))


@query("soft_gold", f"""WITH {OTHER}, s AS (SELECT rm.dataset, rm.type, rm.p, ot.p AS g, CASE WHEN rm.type = 'score' THEN rm.gold END AS gold_score, rm.k FROM rm JOIN ot ON rm.id = ot.id)
SELECT dataset, round(avg({sql_dot('p', 'g')}), 6) AS soft_accuracy, round(avg(list_sum(list_transform(list_zip(p, g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS brier_vs_soft,
  round(avg(abs(list_sum(list_transform(list_zip(p, range(0, k)), lambda z: z[1] * z[2])) - gold_score)), 6) AS score_mae, count(*) AS n FROM s GROUP BY dataset""")
def _(spark, d):
    p = row_metrics(predictions(spark, d)).withColumn("soft", F.transform(A.softmax(F.col("other_logits")), lambda x: x * 3))
    made = p.select("dataset", F.col("p").alias("probabilities"), "soft", F.when(F.col("type") == "score", F.col("gold")).alias("gold_score"))
    return rounded(compare.soft_gold_metrics(made, "dataset"))


@query("tvd", f"""WITH {OTHER} SELECT rm.dataset, round(avg(list_sum(list_transform(list_zip(rm.p, ot.p), lambda z: abs(z[1] - z[2]))) / 2), 6) AS mean_tvd, count(*) AS n FROM rm JOIN ot ON rm.id = ot.id WHERE rm.id % 7 <> 0 GROUP BY rm.dataset""")
def _(spark, d):
    named = lambda p: F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i.cast("string")), p)
    p = row_metrics(predictions(spark, d)).withColumn("q", A.softmax(F.col("other_logits")))
    made = p.select("dataset", named(F.col("p")).alias("probs"), named(F.col("q")).alias("gold_probs"), (F.col("id") % 7 != 0).alias("valid"))
    return rounded(compare.mean_tvd(made, "dataset"))


_LANG = "l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'intent' ELSE 'xnli' END || '/' || lang AS suite, CAST(doc_id % 3 = 0 AS INT) * 1.0 AS accuracy, (doc_id % 11) / 11.0 AS ece_15 FROM documents), s AS (SELECT suite, avg(accuracy) AS accuracy, avg(ece_15) AS ece_15 FROM l GROUP BY suite)"


@query("language_macro", f"WITH {_LANG} SELECT string_split(suite, '/')[1] AS family, round(avg(accuracy), 6) AS macro_accuracy, round(avg(ece_15), 6) AS macro_ece, count(*) FILTER (accuracy > 0.15) AS above_floor, round(max(accuracy) FILTER (suite LIKE '%/en'), 6) AS english, round(avg(accuracy) FILTER (suite NOT LIKE '%/en'), 6) AS other_languages FROM s GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "intent").otherwise("xnli"), F.lit("/"), "lang").alias("suite"), (F.col("doc_id") % 3 == 0).cast("double").alias("accuracy"), (F.col("doc_id") % 11 / 11.0).alias("ece_15"))
    return rounded(compare.language_macro(rows.groupBy("suite").agg(F.avg("accuracy").alias("accuracy"), F.avg("ece_15").alias("ece_15"))))


# Outcomes: tasks from labels, systems a and b; a code where the system attempted the task
def _outcomes(spark, d):
    tasks = table(spark, d, "labels").select(F.col("doc_id").alias("task_id"), F.when(F.col("quality") == 1, "standard").otherwise("hard").alias("tier"))
    systems = spark.createDataFrame([("a", 3), ("b", 4)], "system string, m int")
    code = F.when(F.col("task_id") % F.col("m") == 0, "c").when(F.col("task_id") % 5 == 1, "f")
    outcomes = tasks.join(F.broadcast(systems)).select("system", "task_id", code.alias("code")).where("code is not null")
    return compare.outcome_join(tasks, systems.select("system"), outcomes)


_OUT = "o AS (SELECT system, doc_id AS task_id, CASE WHEN quality = 1 THEN 'standard' ELSE 'hard' END AS tier, CASE WHEN doc_id % m = 0 THEN 'c' WHEN doc_id % 5 = 1 THEN 'f' ELSE 'n' END AS code FROM labels, (VALUES ('a', 3), ('b', 4)) s(system, m))"


@query("outcome_join", f"WITH {_OUT} SELECT system, task_id, tier, code FROM o")
def _(spark, d):
    return _outcomes(spark, d).select("system", "task_id", "tier", "code")


@query("tier_accuracy", f"WITH {_OUT} SELECT system, tier, count(*) AS planned, count(*) FILTER (code <> 'n') AS attempted, count(*) FILTER (code = 'c') AS correct, count(*) FILTER (code = 'f') AS failed, round(count(*) FILTER (code = 'c') / count(*), 6) AS accuracy FROM o GROUP BY ALL")
def _(spark, d):
    return rounded(compare.tier_accuracy(_outcomes(spark, d)))


@query("published_reference_join", f"WITH {ROWS}, m AS (SELECT dataset, round(avg(accuracy), 6) AS accuracy FROM rm GROUP BY dataset) SELECT dataset, accuracy, CAST(v AS DOUBLE) AS published FROM m JOIN (VALUES ('d0', 0.5), ('d3', 0.7), ('d9', 0.1)) p(dataset, v) USING (dataset)")
def _(spark, d):
    published = spark.createDataFrame([("d0", 0.5), ("d3", 0.7), ("d9", 0.1)], "dataset string, published double")
    ours = row_metrics(predictions(spark, d)).groupBy("dataset").agg(F.avg("accuracy").alias("accuracy"))
    return rounded(compare.published_join(ours, published, "dataset"))


# Images: pages as images, their host as the group
_IMG = "i AS (SELECT page_id AS id, 'd' || page_id % 2 AS dataset, 1 + page_id % 3 AS tokens, 'g' || page_id % 17 AS grp FROM pages)"


def _images(spark, d):
    n = F.col("page_id")
    return table(spark, d, "pages").select(n.alias("id"), F.concat(F.lit("d"), (n % 2).cast("string")).alias("dataset"), (1 + n % 3).alias("tokens"), F.concat(F.lit("g"), (n % 17).cast("string")).alias("group"))


@query("mismatched_image_pairs", f"""WITH {_IMG}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, tokens ORDER BY {sql_bucket('grp', 4096)}, grp, {sql_bucket('CAST(id AS VARCHAR)', 4096)}, id) - 1 AS rk FROM i),
lists AS (SELECT r.id, r.dataset, r.tokens, list(o.id ORDER BY o.rk) AS others FROM r JOIN r o ON o.dataset = r.dataset AND o.tokens = r.tokens AND o.grp <> r.grp GROUP BY ALL)
SELECT i.id, others[1 + CAST('0x' || substr(sha256(CAST(i.id AS VARCHAR)), 1, 8) AS BIGINT) % len(others)] AS other_id FROM i LEFT JOIN lists USING (id)""")
def _(spark, d):
    return compare.mismatched_image_pairs(_images(spark, d)).select("id", "other_id")


@query("ablate_image", "SELECT page_id AS id, CAST(NULL AS VARCHAR) AS image FROM pages WHERE page_id % 3 <> 0")
def _(spark, d):
    image = F.when(F.col("page_id") % 3 == 0, "same.png").otherwise(F.col("url"))
    df = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("dataset"), image.alias("image"))
    return prompts.ablate_image(df).select("id", "image")


@query("option_order_join", f"WITH {PRED} SELECT id AS \"case\", 'c' || (list_position(logits, list_max(logits)) - 1) AS base_answer FROM pred WHERE type = 'choice' AND id % 9 <> 0")
def _(spark, d):
    permuted, base = _orders(spark, d)
    return compare.option_order_join(permuted, base).select("case", "base_answer")


def _orders(spark, d):
    p = predictions(spark, d).where("type = 'choice'")
    label = lambda c: F.concat(F.lit("c"), A.argmax(F.col(c)).cast("string"))
    base = p.select(F.lit("base").alias("suite"), F.col("id").alias("case"), F.when(F.col("id") % 9 == 0, "timeout").alias("error"), label("logits").alias("answer"))
    permuted = p.select(F.lit("order/base").alias("suite"), F.lit("base").alias("base"), F.col("id").alias("case"), F.lit(None).cast("string").alias("error"), label("other_logits").alias("answer"))
    return permuted, base


@query("flip_rate", f"WITH {PRED} SELECT 'order/base' AS suite, count(*) AS n, count(*) FILTER (a <> b) AS flips, round(count(*) FILTER (a <> b) / count(*), 6) AS flip_rate FROM (SELECT list_position(logits, list_max(logits)) AS a, list_position(other_logits, list_max(other_logits)) AS b FROM pred WHERE type = 'choice' AND id % 9 <> 0)")
def _(spark, d):
    return rounded(compare.option_flip_rate(compare.option_order_join(*_orders(spark, d))))


_TURNED = "list_slice(logits || logits, s % k + 1, s % k + k)"


@query("rotation_spread", f"WITH {PRED}, r AS (SELECT s, k, gold, list_transform(list_zip({_TURNED}, range(0, k)), lambda z: z[1] + CASE WHEN z[2] = 0 THEN 1.0 ELSE 0.0 END) AS z FROM pred, range(0, 4) t(s)), a AS (SELECT s, avg(CAST((list_position(z, list_max(z)) - 1 + s) % k = gold AS INT)) AS a FROM r GROUP BY s) SELECT round(min(a), 6) AS lowest, round(max(a), 6) AS highest, round(max(a) - min(a), 6) AS spread FROM a")
def _(spark, d):
    """A system that favours whatever stands first, asked with four rotations of its candidates."""
    p = predictions(spark, d)
    parts = []
    for s in range(4):
        favoured = F.transform(prompts.rotate(F.col("logits"), s), lambda x, i: x + F.when(i == 0, 1.0).otherwise(0.0))
        right = A.argmax(favoured) == A.argmax(prompts.rotate(F.col("target"), s))
        parts.append(p.select(F.lit(s).alias("shift"), right.cast("double").alias("accuracy")))
    return rounded(compare.rotation_spread(parts[0].union(parts[1]).union(parts[2]).union(parts[3])))


@query("uniqueness_checks", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, count(*) = count(DISTINCT o_custkey) AS \"unique\" FROM orders GROUP BY 1")
def _(spark, d):
    return compare.uniqueness_checks(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("suite_decision_counts", "SELECT CAST(conv_id % 5 AS BIGINT) AS suite, count(*) AS decisions FROM conversations GROUP BY 1")
def _(spark, d):
    cases = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("questions"))
    return compare.suite_decision_counts(cases.withColumn("suite", F.col("conv_id") % 5))


_LAT = "e AS (SELECT event_id AS task_id, value > 0 AS valid, event_id % 2 = 0 AS correct, CAST(event_id % 5000 AS INT) AS tokens, value AS latency_s, CASE WHEN event_id % 97 = 0 THEN 422 ELSE 200 END AS status_code, event_type AS error FROM events)"


def _served(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(n.alias("task_id"), (F.col("value") > 0).alias("valid"), (n % 2 == 0).alias("correct"), (n % 5000).cast("int").alias("tokens"), F.col("value").alias("latency_s"), F.when(n % 97 == 0, 422).otherwise(200).alias("status_code"), F.col("event_type").alias("error"))


@query("long_inputs", f"WITH {_LAT} SELECT count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (correct) AS correct, max(tokens) AS max_tokens, round(avg(latency_s), 6) AS mean_latency_s FROM e WHERE tokens > 2048")
def _(spark, d):
    return rounded(compare.long_inputs(_served(spark, d), 2048))


@query("input_rejections", f"WITH {_LAT} SELECT task_id, error FROM e WHERE status_code = 422")
def _(spark, d):
    return compare.input_rejections(_served(spark, d))


# Candidates
@query("permute_candidates", f"""WITH {PRED}, o AS (SELECT id, type, k, target, CASE WHEN type = 'choice' THEN list_transform(list_sort(list_transform(range(0, k), lambda i: sha256('7:' || id || ':' || i) || ':' || i)), lambda s: CAST(string_split(s, ':')[2] AS INT)) ELSE list_transform(range(0, k), lambda i: CAST(i AS INT)) END AS ord FROM pred)
SELECT id, ord AS "order", list_transform(ord, lambda i: target[i + 1]) AS target FROM o""")
def _(spark, d):
    p = predictions(spark, d).withColumn("criteria", F.col("logits"))
    return prompts.permute_candidates(p, 7).select("id", "order", "target")


@query("rotate_candidates", f"WITH {PRED} SELECT id, list_slice(target || target, 2, k + 1) AS target FROM pred")
def _(spark, d):
    return predictions(spark, d).select("id", prompts.rotate(F.col("target"), 1).alias("target"))


@query("restore_order", f"WITH {PRED} SELECT id, target FROM pred")
def _(spark, d):
    shuffled = prompts.permute_candidates(predictions(spark, d).withColumn("criteria", F.col("logits")), 7)
    return shuffled.select("id", prompts.restore_order(F.col("target"), F.col("order")).alias("target"))


@query("one_hot_targets", f"WITH {PRED} SELECT id, target FROM pred")
def _(spark, d):
    return predictions(spark, d).select("id", "target")


@query("normalize_targets", f"WITH {PRED} SELECT id, CASE WHEN id % 5 <> 0 THEN list_transform(target, lambda x: round(x, 6)) END AS target FROM pred")
def _(spark, d):
    t = F.when(F.col("id") % 5 == 0, F.transform("target", lambda x: -x)).otherwise(F.transform("target", lambda x: x * 1.00001))
    return predictions(spark, d).select("id", F.transform(A.normalize(t), lambda x: F.round(x, 6)).alias("target"))
