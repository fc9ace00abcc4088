"""Per-row scoring of predictions ``(type, logits, target)`` in array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import arrays as A

MEANS = ["accuracy", "soft_accuracy", "nll", "brier_sum", "brier_per_candidate", "schema_pass", "score_mae", "rps"]


def row_metrics(df: DataFrame, temperature: Column | float = 1.0, logits: str = "logits") -> DataFrame:
    """``df`` with probabilities ``p``, ``guess``, ``label``, ``confidence`` and each proper score of its row.

    Ordinal scores are null but for rows of type ``score``.
    """
    named = df.withColumn("p", A.softmax(F.col(logits), temperature))
    named = named.withColumns({"guess": A.argmax(F.col("p")), "label": A.argmax(F.col("target")), "confidence": F.array_max("p")})
    p, t = F.col("p"), F.col("target")
    gaps = A.total(F.zip_with(t, p, lambda x, y: (x - y) * (x - y)))
    ordinal = F.col("type") == "score"
    steps = F.slice(F.zip_with(A.cumulative(p), A.cumulative(t), lambda x, y: (x - y) * (x - y)), F.lit(1), F.size(p) - 1)
    return named.withColumns(
        {
            "accuracy": (F.col("guess") == F.col("label")).cast("double"),
            "soft_accuracy": F.get(t, F.col("guess")),
            "nll": -A.total(F.zip_with(t, p, lambda x, y: x * F.log(F.greatest(y, F.lit(A.FLOOR))))),
            "brier_sum": gaps,
            "brier_per_candidate": gaps / F.size(p),
            "schema_pass": A.valid_distribution(p).cast("double"),
            "score_mae": F.when(ordinal, F.abs(A.expected_index(p) - A.expected_index(t))),
            "rps": F.when(ordinal, A.total(steps) / (F.size(p) - 1)),
        }
    )


def answers_from_logits(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """``df`` with its answer: probabilities, confidence, and the ``choice``, ``noul`` or ``score`` of its type.

    ``labels`` names the candidates. Confidence is the larger probability for noul, else one minus the share of the largest entropy.
    """
    named = df.withColumn("probabilities", A.softmax(F.col("logits"), temperature))
    p = F.col("probabilities")
    certain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - A.entropy(p) / F.log(F.size(p).cast("double"))))
    kind = F.col("type")
    return named.withColumns(
        {
            "confidence": F.when(kind == "noul", F.array_max(p)).otherwise(certain),
            "noul": F.when(kind == "noul", F.get(p, F.lit(1))),
            "choice": F.when(kind == "choice", F.get("labels", A.argmax(p))),
            "score": F.when(kind == "score", A.expected_index(p)),
        }
    )


# Fixed values of the reward: weights, and the floor of the log score.
LOG_WEIGHT, SPHERICAL_WEIGHT, ORDINAL_WEIGHT, LOG_FLOOR = 1.0, 0.75, 1.0, -9.21


def proper_score_reward(df: DataFrame) -> DataFrame:
    """``df`` with ``reward``: floored log score plus weighted spherical score, less the ranked score of ordinal rows."""
    p, t = F.col("__p"), F.col("target")
    log_score = A.total(F.zip_with(t, p, lambda x, y: x * F.greatest(F.log(F.greatest(y, F.lit(A.FLOOR))), F.lit(LOG_FLOOR))))
    spherical = A.dot(t, p) / F.greatest(A.l2(p), F.lit(1e-9))
    steps = F.slice(F.zip_with(A.cumulative(p), A.cumulative(t), lambda x, y: (x - y) * (x - y)), F.lit(1), F.size(p) - 1)
    rps = A.total(steps) / F.greatest(F.size(p) - 1, F.lit(1))
    made = df.withColumn("__p", A.softmax(F.col("logits")))
    return made.withColumn("reward", LOG_WEIGHT * log_score + SPHERICAL_WEIGHT * spherical - ORDINAL_WEIGHT * F.when(F.col("ordinal"), rps).otherwise(0.0)).drop("__p")
