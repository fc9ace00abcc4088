"""Keeping evaluation text out: blocked leaves and their fingerprints, overlap flags, whole components.

Fingerprints fold a whole text and split it into words, which is dear. Texts of one fingerprint have the same first words, so a
64-bit key of these, which takes a look at a text's beginning only, tells almost all texts apart. Each side is asked for
the keys of the other through a membership filter, and only what passes on both sides gets its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import keys as K
from ballast.functions.durable import apart, cut
from ballast.operators import membership

LEAST_CHARS, HEAD_CHARS = 80, 3000
#: Words that a key is made of.
KEY_WORDS = 8


def first_words_key(s: Column) -> Column:
    """A 64-bit key that is equal for texts of equal fingerprints: of the first folded words, found without reading on.

    Folding never joins words, so as many unfolded ones hold at least as many folded ones; the text is cut behind a whole word.
    """
    inside = K.WORD.rstrip("+")
    start = F.regexp_extract(s, rf"^(?:[^{inside[1:-1]}]*+{inside}++){{0,{KEY_WORDS}}}", 0)
    ws = F.regexp_extract_all(K.casefold(start), F.lit(K.WORD), F.lit(0))
    return F.xxhash64(F.array_join(F.slice(ws, 1, KEY_WORDS), " "))


def long_leaves(df: DataFrame, *keep: str, leaves: str = "state_leaves", heads: bool = False) -> DataFrame:
    """``(keep..., leaf, key)`` of each leaf of at least 80 stripped characters; with ``heads`` also of its first 3000."""
    leaf = F.col("leaf")
    each = df.select(*keep, F.explode(leaves).alias("leaf"))
    variants = each.select(*keep, F.explode(F.array_distinct(F.array(leaf, K.head(leaf, HEAD_CHARS)))).alias("leaf")) if heads else each
    return variants.where(K.stripped_length(leaf) >= LEAST_CHARS).select(*keep, "leaf", first_words_key(leaf).alias("key"))


def printed(leaves: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., fingerprint)`` of leaves, each once."""
    # never null, so that no join has to test it for null by computing it once more
    return leaves.select(*keep, F.coalesce(K.fingerprint(F.col("leaf")), F.lit("")).alias("fingerprint")).distinct()


def blocked_leaves(base: DataFrame, sampled_train: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """``(leaf, key)`` of all held-out rows of ``base`` and of its sampled training rows, and of frozen texts ``(text)``."""
    own = long_leaves(base.where("split <> 'train'")).unionByName(long_leaves(sampled_train))
    return own if frozen is None else own.unionByName(frozen_leaves(frozen))


def frozen_leaves(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(leaf, key)`` of texts of any length; a null one is empty."""
    return texts.select(F.coalesce(text, F.lit("")).alias("leaf")).withColumn("key", first_words_key(F.col("leaf")))


def blocked_fingerprints(base: DataFrame, sampled_train: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Fingerprints of the blocked leaves."""
    return printed(blocked_leaves(base, sampled_train, frozen))


def benchmark_overlap(df: DataFrame, blocked: DataFrame, *, leaves: str = "state_leaves") -> DataFrame:
    """Ids of rows with a blocked leaf; ``blocked``: ``(leaf, key)`` of :func:`blocked_leaves`, or stored fingerprints, against which each leaf's is held.

    A null or empty leaf is too short to be flagged. A blocked text that a third of all rows repeat is one key, one fingerprint, and one row of the other side.
    """
    own = long_leaves(df, "id", leaves=leaves, heads=True)
    if "key" in blocked.columns:
        own = cut(membership.maybe(own, "key", membership.build(cut(blocked.select("key").distinct()), "key")))  # few rows
        blocked = printed(membership.maybe(blocked, "key", membership.build(own, "key")))
    else:
        blocked = blocked.select("fingerprint").distinct()
    return printed(own, "id").join(apart(blocked, "fingerprint"), "fingerprint", "left_semi").select("id").distinct()


def reject_overlap_groups(df: DataFrame, flagged_ids: DataFrame, group: str = "group") -> DataFrame:
    """``df`` without any row of a group that has a flagged row; the groups are component roots by now."""
    bad = df.select("id", group).join(apart(flagged_ids, "id"), "id", "left_semi").select(group).distinct()
    return df.join(apart(bad, group), group, "left_anti")
