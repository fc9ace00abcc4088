"""Candidates and prompts: labels, texts, order, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker before each option, the prefix of image prompts, and the permitted numbers of candidates.
MARKER, IMAGE_PREFIX, FEWEST, MOST = "<|option|>", "<|image|>\n", 2, 128


def render_state(state: Column, is_json: Column) -> Column:
    """A text as it is; structured states as compact JSON."""
    return F.when(is_json, F.to_json(F.try_parse_json(state))).otherwise(state)


def option_labels(kind: Column, criteria: Column) -> Column:
    """Labels by position: false and true for noul, levels for score, names for choice."""
    n = F.size(criteria)
    names = F.transform(criteria, lambda c: c["label"])
    return (
        F.when((kind == "noul") & (n == 0), F.array(F.lit("false"), F.lit("true")))
        .when(kind == "score", F.transform(criteria, lambda c, i: i.cast("string")))
        .otherwise(names)
    )


def option_texts(kind: Column, criteria: Column) -> Column:
    """What is shown for each label; a description follows its label, levels are numbered."""
    described = lambda c: F.coalesce(c["description"], F.lit("")) != ""
    shown = F.transform(criteria, lambda c: F.when(described(c), F.concat(c["label"], F.lit(": "), c["description"])).otherwise(c["label"]))
    levels = F.transform(criteria, lambda c, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), F.when(described(c), c["description"]).otherwise(c["label"])))
    return F.when((kind == "noul") & (F.size(criteria) == 0), F.array(F.lit("false"), F.lit("true"))).when(kind == "score", levels).otherwise(shown)


def valid_options(labels: Column) -> Column:
    """Distinct labels, 2 to 128 of them."""
    return (F.size(F.array_distinct(labels)) == F.size(labels)) & F.size(labels).between(FEWEST, MOST)


def render_prompt(kind: Column, state: Column, instructions: Column, texts: Column, has_image: Column) -> Column:
    """The prompt of a decision; null where a part holds the reserved marker."""
    listed = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t, F.lit(MARKER))), "\n")
    clean = ~(F.contains(state, F.lit(MARKER)) | F.contains(instructions, F.lit(MARKER)) | F.exists(texts, lambda t: F.contains(t, F.lit(MARKER))))
    body = F.concat(F.lit("State: "), state, F.lit("\n"), kind, F.lit(" question: "), instructions, F.lit("\nOptions:\n"), listed)
    return F.when(clean, F.when(has_image, F.concat(F.lit(IMAGE_PREFIX), body)).otherwise(body))


def permutation(row_id: Column, n: Column, seed: int) -> Column:
    """A hash-keyed order of ``n`` positions, another for each row and seed."""
    keyed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), row_id, i.cast("string")), 256).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def take(a: Column, order: Column) -> Column:
    """``a`` in another order."""
    return F.transform(order, lambda i: F.get(a, i))


def permute_candidates(df: DataFrame, seed: int, criteria: str = "criteria", target: str = "target", row_id: str = "id") -> DataFrame:
    """``df`` with criteria and target shuffled together, and the ``order``; only choices are shuffled."""
    n = F.size(target)
    order = F.when(F.col("type") == "choice", permutation(F.col(row_id).cast("string"), n, seed)).otherwise(F.sequence(F.lit(0), n - 1))
    made = df.withColumn("order", order)
    return made.withColumn(criteria, take(F.col(criteria), F.col("order"))).withColumn(target, take(F.col(target), F.col("order")))


def rotate(a: Column, shift: int) -> Column:
    """Cyclic rotation to the left."""
    k = F.size(a)
    s = F.pmod(F.lit(shift), k)
    return F.concat(F.slice(a, s + 1, k - s), F.slice(a, F.lit(1), s))


def restore_order(a: Column, order: Column) -> Column:
    """The inverse of :func:`take`."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.get(a, (F.array_position(order, i) - 1).cast("int")))


def ablate_image(df: DataFrame, by: str = "dataset", image: str = "image") -> DataFrame:
    """Rows of datasets with at least two distinct images, without their image."""
    rich = df.groupBy(by).agg(F.count_distinct(image).alias("n")).where("n >= 2").select(by)
    return df.join(rich, by, "left_semi").withColumn(image, F.lit(None).cast("string"))
