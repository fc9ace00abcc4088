"""Questions of document blocks to hash shards, and their answers.

Documents are dealt into blocks by the hash of their id. A block asks about the sorted hashes of what its texts hold, packed
into one array per shard; each shard sees the same hash from all blocks, and answers each block with arrays of its own. A
hash crosses the network once per block that holds it, however often it occurs there, so no frequent word or
passage makes a task large, and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import width

ASKS = "shard int, block int, blob binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])


#: Bytes of text that a block holds on average, at most.
BLOCK_BYTES = 64_000_000


def number(docs: DataFrame, text: str) -> int:
    """How many blocks (and shards) to deal: the session's width, or more where blocks would be too large for a worker's memory."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(width(docs.sparkSession), -(-size // BLOCK_BYTES))


def block_of(doc_id: str, text: str, n: int) -> Column:
    """The block of a document; those without an id are dealt by their text."""
    return F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(n)).cast("int")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; byte planes apart, as the high bytes of sorted numbers compress well."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize, ord(a.dtype.kind)))], "<i8").tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays that :func:`pack` was given."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist(), 8 + 24 * n, []
    for length, size, kind in head:
        planes = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{chr(kind)}{size}") if length else np.empty(0, f"<{chr(kind)}{size}"))
        at += length * size
    return out


def by_shard(shard: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(shard, its part of each array)`` of every shard that has any; parts keep their order."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(n + 1))
    sorted_arrays = [a[order] for a in arrays]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, [a[edges[k] : edges[k + 1]] for a in sorted_arrays]


def rows(made: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Record batches of ``(shard, block, blob)``, a few at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in made:
        held.append(row)
        size += len(row[2])
        if size > 4_000_000 or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)


def ask(docs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """What ``fn`` asks, over whatever partitions ``docs`` has."""
    return docs.mapInArrow(lambda it: rows(fn(it)), ASKS)


def answer(asks: DataFrame, n: int, fn: Callable[[list[tuple[int, list[np.ndarray]]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """``fn`` of all that was asked of a shard, as ``(block, arrays)``, for each of ``n`` shards."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(b, unpack(x)) for batch in it for b, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return rows(fn(asked)) if asked else iter(())

    return asks.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "block").mapInArrow(run, ASKS)


def dealt(docs: DataFrame, n: int, block: Column, answers: DataFrame | None = None) -> DataFrame:
    """``docs`` by blocks, one to a partition, each preceded by its answers in the columns ``__block, __shard, __blob``."""
    out = docs.withColumn("__block", block)
    if answers is not None:
        out = answers.select(F.col("block").alias("__block"), F.col("shard").alias("__shard"), F.col("blob").alias("__blob")).unionByName(out, allowMissingColumns=True)
        return out.repartitionById(n, F.col("__block")).sortWithinPartitions(F.asc_nulls_last("__shard"))
    return out.repartitionById(n, F.col("__block"))


def answers_first(it: Iterator[pa.RecordBatch]) -> tuple[list[list[np.ndarray]], Iterator[pa.RecordBatch]]:
    """The answers of a block in order of their shards, and batches of its documents without those columns."""
    answers: list[list[np.ndarray]] = []
    first = None
    for batch in it:
        blobs = batch.column(batch.schema.get_field_index("__blob"))
        n = len(blobs) - blobs.null_count
        answers += [unpack(x) for x in blobs.slice(0, n).to_pylist()]
        if n < len(batch):
            first = batch.slice(n)
            break

    def documents() -> Iterator[pa.RecordBatch]:
        if first is not None:
            yield first
            yield from it

    return answers, documents()


class Coder(dict):
    """64-bit codes of words, remembered until there are too many."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, 7)
        return code

    def codes(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
