"""Best-fit packing into bins of several permitted lengths.

Texts longer than the largest bin are cut into full pieces and a rest, so nothing is lost. Pieces go in falling length
into the open bin that they leave the least room in; where none has room, a bin is opened. Which size to open is optimised
jointly: each permitted size is tried as the least one to open, and so is the size that costs least per token that it can still get; of these plans
the cheapest is taken. At the end each bin shrinks to the smallest permitted size that holds its contents, and plans are compared after that.

Pieces are dealt by a hash of their row's number into blocks of about ``block_rows``, whatever ids they share or lack, packed independently of each other: what is
lost is part of one bin of each size per block.

Nulls and empties: a null or empty text has no words and is one piece that holds only the end mark. Equal lengths are placed
by doc_id and piece, those without an id last. Repeated rows are packed as often as they occur; doc_ids come back as they were. Other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import cut
from ballast.llm.text import as_bytes, words

SIZES = (512, 1024, 2048, 4096)
BLOCK_ROWS = 20_000


def padded_cost(size: int) -> float:
    """Cost of a bin: its tokens, plus attention that grows with the square of its length."""
    return size * (1 + size / 16384)


def lengths(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, length)``: the words of each whole text and one end mark."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words(t)) + 1 for t in as_bytes(batch.column(1))], pa.int64())], names=["doc_id", "length"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, length long")


def plan(sizes: list[int], order: list[int], opening: Callable[[int, int], int]) -> list[list[int]]:
    """Bins of indices into ``sizes``, which is read in ``order``; ``opening(length, tokens left)`` gives a new bin's size."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # room and number, in order
    left = sum(sizes)
    for i in order:
        need = sizes[i]
        k = bisect_left(open_bins, (need, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            room, b = opening(need, left), len(bins)
            bins.append([])
        bins[b].append(i)
        left -= need
        if room > need:
            insort(open_bins, (room - need, b))
    return bins


def pack_block(lens: list[int], keys: list, permitted: tuple[int, ...], cost: Callable[[int], float]) -> list[tuple[int, list[int]]]:
    """``(size, indices)`` of the cheapest plan's bins; every length is at most the largest permitted size."""
    permitted = tuple(sorted(permitted))
    order = sorted(range(len(lens)), key=lambda i: (-lens[i], keys[i]))
    fits = lambda n: permitted[bisect_left(permitted, n)]
    openings: list[Callable[[int, int], int]] = [lambda n, left, c=c: fits(max(n, c)) for c in permitted]
    openings.append(lambda n, left: min((c for c in permitted if c >= n), key=lambda c: (cost(c) / min(c, max(n, left)), c)))
    best, least = None, float("inf")
    for opening in openings:
        bins = [(fits(sum(lens[i] for i in b)), b) for b in plan(lens, order, opening)]
        total = sum(cost(size) for size, _ in bins)
        if total < least:
            best, least = bins, total
    return best or []


def pack(measured: DataFrame, permitted: tuple[int, ...] = SIZES, cost: Callable[[int], float] = padded_cost, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, piece, start, length, bin, size, offset)`` for each piece of ``measured``: ``(doc_id, length)``.

    ``start`` counts tokens of the text, ``offset`` those of the bin before the piece.
    """
    measured = cut(measured.select("doc_id", "length")).withColumn("__row", F.monotonically_increasing_id())  # texts are read once
    most = max(permitted)
    last = F.greatest(F.ceil(F.col("length") / most).cast("long") - 1, F.lit(0).cast("long"))
    pieces = measured.select("doc_id", "__row", F.col("length").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "__row", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).alias("length"))
    total = measured.agg(F.sum(last + 1)).first()[0] or 0
    blocks = max(1, -(-total // block_rows))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("__row", "piece"), F.lit(blocks))).drop("__row")
    kind = measured.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "bin", "size", "offset"]

    def run(block: pa.Table) -> pa.Table:
        ids, piece, lens = (block[c].to_pylist() for c in ("doc_id", "piece", "length"))
        keys = [(d is None, d if d is not None else 0, p) for d, p in zip(ids, piece)]
        number, size, offset = (np.zeros(len(lens), np.int64) for _ in range(3))
        for k, (fit, members) in enumerate(pack_block(lens, keys, permitted, cost)):
            at = 0
            for i in members:
                number[i], size[i], offset[i] = k, fit, at
                at += lens[i]
        bins = block["block"][0].as_py() * 2**32 + number
        return pa.table([*(block[c] for c in names[:4]), pa.array(bins), pa.array(size), pa.array(offset)], names=names)

    return dealt.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece long, start long, length long, bin long, size long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin."""
    return pack(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
