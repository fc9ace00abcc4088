"""Comparing systems on identical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import keys as K
from ballast.operators import metrics
from ballast.operators.rowmetrics import row_metrics
from ballast.operators.sample import group_ranks

# Suites whose rows differ in their candidates.
VARYING_SUITES = "^(massive51/|colab/massive)|^colab/typed_decisions$"


def same_id_join(ours: DataFrame, reference: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``(ours on the reference's ids, reference ids that we lack)``; the second must be empty."""
    ids = reference.select(key).distinct()
    return ours.join(ids, key, "left_semi"), ids.join(ours, key, "left_anti")


def paired(ours: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """Inner join of two runs on the id; the reference's columns get the prefix ``ref_``."""
    named = reference.select(key, *(F.col(c).alias(f"ref_{c}") for c in reference.columns if c != key))
    return ours.join(named, key)


def already_scored(pending: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What is left to score."""
    return pending.join(done.select(*key).distinct(), list(key), "left_anti")


def outcome_join(tasks: DataFrame, systems: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every task under every system, with the code ``n`` where it was not attempted."""
    every = tasks.join(systems)  # each task under each system is what is asked for
    return every.join(outcomes, ["system", "task_id"], "left").withColumn("code", F.coalesce("code", F.lit("n")))


def tier_accuracy(joined: DataFrame) -> DataFrame:
    """Planned, attempted, correct, failed and accuracy by system and tier."""
    made = joined.groupBy("system", "tier").agg(F.count("*").alias("planned"), F.count_if(F.col("code") != "n").alias("attempted"), F.count_if(F.col("code") == "c").alias("correct"), F.count_if(F.col("code") == "f").alias("failed"))
    return made.withColumn("accuracy", F.col("correct") / F.col("planned"))


def mismatched_image_pairs(df: DataFrame) -> DataFrame:
    """``df`` with the id of another group's image of the same dataset and size, picked by hash; null where there is none.

    Images of a (dataset, size) bucket are ranked by group, so a group is one range of ranks, and the pick skips it by arithmetic: no pairs are formed. Ranks of
    groups come from running sums over runs of groups by hash, so no task sees a whole bucket's groups.
    """
    bucket = ["dataset", "tokens"]
    one = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in bucket))
    groups = df.groupBy(*bucket, "group").agg(F.count("*").alias("own")).withColumn("__run", K.hash_bucket(F.col("group"), 4096))
    runs = groups.groupBy(*bucket, "__run").agg(F.sum("own").alias("__n"))
    before = W.partitionBy(*bucket).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)  # 4096 rows a bucket at most
    starts = runs.select(*bucket, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*bucket, "__run").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("__in", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(starts, [*bucket, "__run"]).withColumn("start", F.col("__in") + F.col("__start"))
    totals = groups.groupBy(*bucket).agg(F.sum("own").alias("total"))
    member = F.concat_ws("\x1f", one, F.col("group"))
    placed = group_ranks(df.withColumn("__group", member).withColumn("__hash", K.hash_bucket(F.col("id").cast("string"), 4096)), "__group", "__hash", "id").drop("__group", "__hash")
    ranked = placed.join(groups.select(*bucket, "group", "own", "start"), [*bucket, "group"]).join(totals, bucket).withColumn("rank", F.col("start") + F.col("rank"))
    others = F.col("total") - F.col("own")
    pick = F.when(others > 0, K.hash_bucket(F.col("id").cast("string"), F.greatest(others, F.lit(1))))
    asked = ranked.withColumn("pick", F.when(pick < F.col("start"), pick).otherwise(pick + F.col("own")))
    offered = ranked.select(*bucket, F.col("rank").alias("pick"), F.col("id").alias("other_id"))
    return asked.join(offered, [*bucket, "pick"], "left").select(*df.columns, "other_id")


def option_order_join(permuted: DataFrame, base: DataFrame) -> DataFrame:
    """Cases of a permuted suite beside those of its base, where neither has an error."""
    ours = permuted.where("error is null").select("suite", "base", "case", F.col("answer").alias("answer"))
    theirs = base.where("error is null").select(F.col("suite").alias("base"), "case", F.col("answer").alias("base_answer"))
    return ours.join(theirs, ["base", "case"])


def option_flip_rate(joined: DataFrame) -> DataFrame:
    """Share of cases whose winning label changed, by suite."""
    return joined.groupBy("suite").agg(F.count("*").alias("n"), F.count_if(F.col("answer") != F.col("base_answer")).alias("flips")).withColumn("flip_rate", F.col("flips") / F.col("n"))


def run_comparison(before: DataFrame, after: DataFrame, before_prints: DataFrame, after_prints: DataFrame, metrics: list[str], key: str = "dataset") -> DataFrame:
    """Metrics of two runs side by side with their changes; runs over different partitions (``split, digest``) are refused."""
    differing = before_prints.select("split", "digest").exceptAll(after_prints.select("split", "digest"))
    if differing.take(1):
        raise ValueError("the partitions of the two runs differ")
    joined = before.select(key, *(F.col(m).alias(f"{m}_before") for m in metrics)).join(after.select(key, *(F.col(m).alias(f"{m}_after") for m in metrics)), key)
    return joined.select("*", *((F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change") for m in metrics))


def published_join(ours: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Our metrics beside published ones, which are few."""
    return ours.join(published, key)


def saved_target_check(saved: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids that break the contract of a saved run, with the first ``reason``: duplicate, unknown or another target."""
    counted = saved.groupBy("id").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    joined = counted.join(expected.select("id", F.col("target").alias("expected")), "id", "left")
    reason = F.when(F.col("n") > 1, "duplicate").when(F.col("expected").isNull(), "unknown").when(F.col("target") != F.col("expected"), "target")
    return joined.select("id", reason.alias("reason")).where("reason is not null")


def long_inputs(df: DataFrame, most: int) -> DataFrame:
    """Outcomes over the token budget: how many, how many valid and correct, the longest, and their latency."""
    return df.where(F.col("tokens") > most).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if("correct").alias("correct"), F.max("tokens").alias("max_tokens"), F.avg("latency_s").alias("mean_latency_s"))


def input_rejections(df: DataFrame) -> DataFrame:
    """Outcomes that the service refused; they count as wrong and stay listed."""
    return df.where("status_code = 422").select("task_id", "error")


def engine_datasets(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the datasets that a system supports."""
    return df.where(F.col("dataset").isin(names))


def suite_metrics(df: DataFrame) -> DataFrame:
    """By suite: planned, valid, failures and accuracy over all planned rows; over valid ones the mean log loss, Brier scores, probability of the gold class,
    error of the score, ranked probability score, calibration error and macro F1. Suites whose candidates differ from row to row have no F1.

    df: ``(suite, valid, probabilities, gold, type)``.
    """
    p, right = F.col("probabilities"), F.col("valid") & (A.argmax(F.col("probabilities")) == F.col("gold"))
    planned = df.groupBy("suite").agg(F.count("*").alias("n_planned"), F.count_if("valid").alias("n_valid"), F.count_if(right).alias("correct"))
    hard = row_metrics(df.where("valid").select("suite", "type", F.transform(p, lambda x: F.log(F.greatest(x, F.lit(A.FLOOR)))).alias("logits"), A.one_hot(F.col("gold"), F.size(p)).alias("target")))
    means = hard.groupBy("suite").agg(*(F.avg(m).alias(m) for m in ("nll", "brier_sum", "brier_per_candidate", "soft_accuracy", "score_mae", "rps")))
    classes = hard.select("suite", A.argmax(F.col("target")).alias("label"), "guess")
    rest = metrics.ece(hard, "suite").join(metrics.macro_f1(classes, "suite"), "suite")
    joined = planned.join(means, "suite", "left").join(rest, "suite", "left")
    f1 = F.when(~F.col("suite").rlike(VARYING_SUITES), F.col("macro_f1"))
    return joined.select("suite", "n_planned", "n_valid", (F.col("n_planned") - F.col("n_valid")).alias("failures"), (F.col("correct") / F.col("n_planned")).alias("accuracy"), *means.columns[1:], "ece_15", f1.alias("macro_f1"))


def class_balance(df: DataFrame) -> DataFrame:
    """By suite: its classes, the majority class's share, the mean recall, and maps of each class's count and recall; errors count as wrong."""
    right = F.col("valid") & (A.argmax(F.col("probabilities")) == F.col("gold"))
    each = df.groupBy("suite", "gold").agg(F.count("*").alias("n"), F.count_if(right).alias("hit")).withColumn("recall", F.col("hit") / F.col("n"))
    by_class = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("gold", v))))  # noqa: E731  a row per class
    return each.groupBy("suite").agg(F.count("*").alias("classes"), (F.max("n") / F.sum("n")).alias("majority_accuracy"), F.avg("recall").alias("balanced_accuracy"), by_class("n").alias("class_counts"), by_class("recall").alias("class_recall"))


def soft_gold_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Against soft gold ``soft`` (normalized here) and ``gold_score``: soft accuracy, Brier score, error of the score."""
    made = df.withColumn("__g", A.let(F.struct(F.col("soft").alias("g"), A.total(F.col("soft")).alias("s")), lambda q: F.transform(q["g"], lambda x: x / q["s"])))
    p, g = F.col("probabilities"), F.col("__g")
    return made.groupBy(*by).agg(
        F.avg(A.dot(p, g)).alias("soft_accuracy"),
        F.avg(A.total(F.zip_with(p, g, lambda x, y: (x - y) * (x - y)))).alias("brier_vs_soft"),
        F.avg(F.when(F.col("gold_score").isNotNull(), F.abs(A.expected_index(p) - F.col("gold_score")))).alias("score_mae"),
        F.count("*").alias("n"),
    )


def language_macro(metrics: DataFrame, least: float = 0.15) -> DataFrame:
    """Over suites ``family/language``: mean accuracy and error by family, languages above a floor, English and the others."""
    parts = F.split("suite", "/")
    named = metrics.withColumn("family", F.get(parts, F.lit(0))).withColumn("language", F.get(parts, F.lit(1)))
    english = F.col("language") == "en"
    return named.groupBy("family").agg(F.avg("accuracy").alias("macro_accuracy"), F.avg("ece_15").alias("macro_ece"), F.count_if(F.col("accuracy") > least).alias("above_floor"), F.max(F.when(english, F.col("accuracy"))).alias("english"), F.avg(F.when(~english, F.col("accuracy"))).alias("other_languages"))


def mean_tvd(df: DataFrame, *by: str) -> DataFrame:
    """Mean total variation between label maps ``probs`` and ``gold_probs`` over valid rows; absent labels have none."""
    at = lambda m, x: F.coalesce(F.try_element_at(F.col(m), x), F.lit(0.0))
    labels = F.array_union(F.map_keys("probs"), F.map_keys("gold_probs"))
    distance = A.total(F.transform(labels, lambda x: F.abs(at("probs", x) - at("gold_probs", x)))) / 2
    return df.where("valid").groupBy(*by).agg(F.avg(distance).alias("mean_tvd"), F.count("*").alias("n"))


def contingency(joined: DataFrame, *by: str) -> DataFrame:
    """Who is right on the same rows (``correct``, ``ref_correct``), and how often the answers agree."""
    a, b = F.col("correct"), F.col("ref_correct")
    made = joined.groupBy(*by).agg(F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("ours_only"), F.count_if(~a & b).alias("reference_only"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(F.col("guess") == F.col("ref_guess")).alias("same_answer"), F.count("*").alias("n"))
    return made.withColumn("same_correctness", F.col("both_correct") + F.col("both_wrong"))


def paired_delta(joined: DataFrame, *by: str) -> DataFrame:
    """Agreement, change of accuracy, and the largest and mean difference of the probabilities ``p`` and ``ref_p``."""
    gap = A.linf(F.col("p"), F.col("ref_p"))
    return joined.groupBy(*by).agg(F.avg((F.col("guess") == F.col("ref_guess")).cast("double")).alias("agreement"), F.avg(F.col("correct").cast("double") - F.col("ref_correct").cast("double")).alias("accuracy_delta"), F.max(gap).alias("max_difference"), F.avg(gap).alias("mean_difference"), F.count("*").alias("n"))


def rotation_spread(df: DataFrame) -> DataFrame:
    """Accuracy by rotation, and the spread between the best and the worst."""
    each = df.groupBy("shift").agg(F.avg("accuracy").alias("accuracy"))
    return each.agg(F.min("accuracy").alias("lowest"), F.max("accuracy").alias("highest"), (F.max("accuracy") - F.min("accuracy")).alias("spread"))


def uniqueness_checks(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows, distinct keys, and whether these agree, exactly."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct")).withColumn("unique", F.col("n") == F.col("n_distinct"))


def suite_decision_counts(df: DataFrame) -> DataFrame:
    """Questions per suite: the sum over its cases."""
    return df.groupBy("suite").agg(F.sum(F.size("questions")).alias("decisions"))
