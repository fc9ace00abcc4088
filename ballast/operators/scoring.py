"""Hosting a user's scorer over prompts; no model comes with this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def score_batches(df: DataFrame, scorer: Callable[[list[str]], list[list[float]]], prompt: str = "prompt", size: int = 256) -> DataFrame:
    """``df`` with ``logits``: the scorer's answer to each prompt, asked for in batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield part.assign(logits=scorer(part[prompt].tolist()))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))]))
