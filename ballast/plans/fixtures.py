"""How the given tables stand in for annotated sources: each as DataFrame code and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import keys as K

# SQL of the key functions
WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def sql_fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '{WHITE}', ' ', 'g'))"


def sql_print(x: str) -> str:
    return rf"sha256(array_to_string(regexp_extract_all({sql_fold(x)}, '[\p{{L}}\p{{N}}_]+'), ' '))"


def sql_bucket(x: str, n: int | str = 100) -> str:
    return f"(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) % {n})"


def sql_train_split(g: str, has_dev: str) -> str:
    b = sql_bucket(f"'doh-split-2026:' || {g}")
    return f"CASE WHEN {b} < 5 THEN 'calibration' WHEN {b} < 10 AND NOT {has_dev} THEN 'dev' ELSE 'train' END"


def sql_family(x: str) -> str:
    masked = rf"regexp_replace(regexp_replace({x}, 'https?://\S+', 'X', 'g'), '\b\d+\b', 'X', 'g')"
    return sql_print(masked)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents as utterances: grouped by normalized text, aliased by first line and exact text, split by doc_id % 10.
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central row form over ``documents``: two decisions per document would share group and aliases; one is enough here."""
    d = table(spark, sf_dir, "documents")
    group = F.concat(F.lit("utterance:"), K.digest(K.normalized(F.col("text"))))
    named = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "validation").otherwise("test")
    return d.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("dataset"),
        group.alias("group"),
        F.array(F.concat(F.lit("line:"), K.fingerprint(F.split("text", "\n")[0])), F.concat(F.lit("text:"), K.digest(F.col("text")))).alias("aliases"),
        K.official_split(named, {"train": "train", "validation": "dev", "test": "test"}, group, True).alias("split"),
        F.col("text").alias("state"),
        F.lit("choice").alias("question"),
        F.col("doc_id").alias("input_pos"),
    )


EX = f"""ex0 AS (SELECT *, 'utterance:' || sha256({sql_norm('text')}) AS grp, string_split(text, chr(10))[1] AS first_line FROM documents),
ex AS (SELECT 'doc:' || doc_id AS id, source AS dataset, grp AS "group", ['line:' || {sql_print('first_line')}, 'text:' || sha256(text)] AS aliases,
  CASE WHEN doc_id % 10 < 7 THEN {sql_train_split('grp', 'true')} WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split,
  text AS state, doc_id AS input_pos FROM ex0)"""


# Embeddings as predictions of two systems: a type by vec_id % 3, a dataset by vec_id % 5, gold by label.
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    kind = F.col("vec_id") % 3
    k = F.when(kind == 0, 10).when(kind == 1, 2).otherwise(5)
    scaled = lambda at: F.transform(F.slice("embedding", F.lit(at), k), lambda x: x.cast("double") * 4)
    gold = (F.col("label") % k).cast("int")
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("d"), (F.col("vec_id") % 5).cast("string")).alias("dataset"),
        F.when(kind == 0, "choice").when(kind == 1, "noul").otherwise("score").alias("type"),
        k.alias("k"),
        gold.alias("gold"),
        A.one_hot(gold, k).alias("target"),
        scaled(1).alias("logits"),
        scaled(11).alias("other_logits"),
    )


PRED = """pred0 AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 5 END AS k FROM embeddings),
pred AS (SELECT vec_id AS id, 'd' || (vec_id % 5) AS dataset, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS type, k, CAST(label % k AS INT) AS gold,
  list_transform(range(0, k), lambda i: CASE WHEN i = label % k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target,
  list_transform(list_slice(embedding, 1, k), lambda x: x::DOUBLE * 4) AS logits,
  list_transform(list_slice(embedding, 11, 10 + k), lambda x: x::DOUBLE * 4) AS other_logits FROM pred0)"""


def sql_softmax(x: str, t: str = "1.0") -> str:
    e = f"list_transform({x}, lambda v: exp((v - list_max({x})) / {t}))"
    return f"list_transform({e}, lambda w: w / list_sum({e}))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


# Row metrics of predictions, as A4 defines them, for a logits column and a temperature expression.
def sql_rows(logits: str = "logits", t: str = "1.0", source: str = "pred", name: str = "rm") -> str:
    return f"""{name}_p AS (SELECT *, {sql_softmax(logits, t)} AS p FROM {source}),
{name}_q AS (SELECT *, list_position(p, list_max(p)) - 1 AS guess, list_max(p) AS confidence, list_position(target, list_max(target)) - 1 AS best FROM {name}_p),
{name} AS (SELECT *, CASE WHEN guess = best THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, target[guess + 1] AS soft_accuracy,
  -list_sum(list_transform(list_zip(target, p), lambda z: z[1] * ln(greatest(z[2], 1e-12)))) AS nll,
  list_sum(list_transform(list_zip(target, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS brier_sum,
  list_sum(list_transform(list_zip(target, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(p) AS brier_per_candidate,
  CASE WHEN type = 'score' THEN abs(list_sum(list_transform(list_zip(p, range(0, len(p))), lambda z: z[1] * z[2])) - list_sum(list_transform(list_zip(target, range(0, len(p))), lambda z: z[1] * z[2]))) END AS score_mae,
  CASE WHEN type = 'score' THEN list_avg(list_transform(range(1, len(p)), lambda i: pow(list_sum(list_slice(p, 1, i)) - list_sum(list_slice(target, 1, i)), 2))) END AS rps
  FROM {name}_q)"""
