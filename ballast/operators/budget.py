"""Token budgets and validity filters, with what they exclude."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import helpers

MAX_TOKENS = 2048


def count_pieces(text: Column) -> Column:
    """The default token counter: runs of letters, single digits, single other marks."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"), F.lit(0)))


def vocabulary_tokens(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """The tokens of a byte-level vocabulary: ``vocabulary`` is a file of ranks that the driver can read, a few MB, which is broadcast."""
    return helpers.token_counts(text, spark.sparkContext.broadcast(Path(vocabulary).read_bytes()))


def image_token_count(width: Column, height: Column, factor: int = 32, pixels: int = 512 * 512) -> Column:
    """Visual tokens after a resize to multiples of ``factor`` that keeps the aspect near a fixed number of pixels."""
    scale = F.sqrt(F.lit(float(pixels)) / (width * height))
    side = lambda x: F.greatest(F.lit(factor), F.floor(x * scale / factor) * factor)
    return ((side(width) / factor) * (side(height) / factor)).cast("long")


def token_budget(df: DataFrame, tokens: Column, most: int = MAX_TOKENS) -> DataFrame:
    """``df`` with its ``tokens`` and the ``reason`` ``token_budget`` where they are too many."""
    return df.withColumn("tokens", tokens.cast("int")).withColumn("reason", F.when(F.col("tokens") > most, "token_budget"))


def valid_rows(df: DataFrame, text: str | None = None, distribution: str | None = None) -> DataFrame:
    """Rows whose text is not blank and whose distribution is finite and sums to one."""
    out = df
    if text:
        out = out.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    if distribution:
        out = out.where(A.valid_distribution(F.col(distribution)))
    return out
