"""An approximate membership filter: which of many rows may hold one of a set of 64-bit keys.

A Bloom filter in blocks: a key's bits all lie in the one block that its hash picks. The filter is built by two aggregations (bits by word, words by
block) and is a table of blocks, so asking it is an equi-join on the block number with the bits as a further condition. Its size is
known from the number of keys; it is broadcast if that is small enough, and joined by shuffles of keys alone if not.

A null key is in no set. An empty set lets nothing pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block; bits for each key; bits set by each key: about one stranger in two hundred passes.
WORDS, BITS_PER_KEY, PROBES = 64, 12, 5
#: The largest filter that is broadcast, in bytes.
MOST_BYTES = 64_000_000


@dataclass
class Filter:
    """A table ``(__block, __words)`` and the number of blocks."""

    table: DataFrame
    blocks: int

    @property
    def bytes(self) -> int:
        return self.blocks * (8 * WORDS + 24)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def _probe(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * WORDS))


def build(keys: DataFrame, key: str) -> Filter:
    """The filter of a table's keys, which are counted once to size it; best given distinct and cut."""
    known = keys.select(F.col(key).alias("__k")).where("__k is not null")
    blocks = max(1, -(-known.count() * BITS_PER_KEY // (64 * WORDS)))
    k = F.col("__k")
    spots = known.select(_block(k, blocks).alias("__block"), F.explode(F.array(*(_probe(k, i + 1) for i in range(PROBES)))).alias("__p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("__p") % 64).cast("int"))
    words = spots.groupBy("__block", F.floor(F.col("__p") / 64).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    held = words.groupBy("__block").agg(F.map_from_entries(F.collect_list(F.struct("__w", "__bits"))).alias("__m"))  # at most WORDS entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("__m", w.cast("bigint")), F.lit(0).cast("bigint")))
    return Filter(held.select("__block", dense.alias("__words")), blocks)


def maybe(df: DataFrame, key: str, known: Filter) -> DataFrame:
    """The rows of ``df`` whose key may be in the set: all that are, and few others."""
    if df.schema[key].dataType.simpleString() != "bigint":
        raise ValueError("keys are bigints")
    asked = F.col(key).isNotNull() & (_block(F.col(key), known.blocks) == F.col("__block"))
    for i in range(PROBES):
        p = _probe(F.col(key), i + 1)
        word = F.get("__words", F.floor(p / 64).cast("int"))
        asked = asked & (F.call_function("getbit", word, (p % 64).cast("int")) == 1)
    small = known.bytes <= MOST_BYTES  # checked: else Spark shuffles both sides by block
    return df.join(F.broadcast(known.table) if small else known.table, asked, "left_semi")
