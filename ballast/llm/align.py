"""Alignment of two tokenizers over a corpus: which tokens of one share bytes with which of the other, and in how many documents.

Both tokenizers cut the same bytes. Between two neighbouring ends, of either one's tokens, lies one stretch that belongs to one token of
each: that is a link. Counting pairs of linked ids over documents is an external count by spilled runs:

* A task keeps (pair, document) records, each pair once a document, in a buffer. A full buffer is a segment: its pairs are
  radix-partitioned by the first tokenizer's id, sorted by pair and spilled as zstd runs of chunks, one for each partition, with
  the number of the segment's documents that hold each pair. So a pair that fills every document is one entry of a run. What is left of a document is the places of its pairs in its segment's list.
* A partition's runs meet in one task, which merges them through a heap, a chunk of each run in memory at a time, and sums
  each pair. The order is by the first tokenizer's id, so as a side's pairs pass its highest count is known. The contributions
  stream back run by run: each segment gets its pairs' counts and whether they are their side's highest, and adds them up for its documents.
* No merge meets many more than ``fan`` segments: beyond, groups of about ``fan`` segments are merged into runs of their own first, which are counted alike, and answer
  their segments in turn. So the work of a task stays bounded at any number of documents: a merge holds compressed runs of a group and the pairs of one partition.

Texts are read and cut once, where they are scanned, and never shuffled.

Nulls and empties: texts that are null, empty, or not spelled by either tokenizer's tokens byte for byte have no tokens: zeros and an empty
digest. Very long texts are cut whole. Repeated rows are a document each, rows that share a doc_id or have none too. Ties for a
side's highest count are all highest. Other columns play no part. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.durable import cut, width
from ballast.llm import blocks

#: Where the vocabularies are: a byte-level BPE as JSON, and a piece model.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Records in a task's buffer; entries in a chunk of a run; segments that meet in one merge.
BUFFER, CHUNK, FAN = 2_000_000, 32_768, 256
_RUN = 50_000
# Fixed value: how the byte-level vocabulary's own pre-tokenizer splits text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _spelled() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Cutter:
    """Both tokenizers, and how their tokens of a text match."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        made, byte = json.loads(byte_level), _spelled()
        special = {x["content"] for x in made["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): k for t, k in made["model"]["vocab"].items() if t not in special}
        self._json, self._whole = byte_level, None
        self._a = tiktoken.Encoding("side", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.width = self._b.get_piece_size()
        names = [self._b.id_to_piece(k) for k in range(self.width)]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self._a_size, self._b_size = np.zeros(1 + max(ranks.values()), np.int64), np.fromiter(map(len, self._b_bytes), np.int64)
        self._a_size[list(ranks.values())] = [len(t) for t in ranks]
        # what a token writes into the list of groups, by its id, and by whether its side's part of the group ends with it
        self._written = [x for k in range(len(self._a_size)) for x in (f"{k},", f"{k}|")] + [x for k in range(self.width) for x in (f"{k},", f"{k};")]

    def _first(self, text: str) -> np.ndarray:
        if len(text) > _RUN and re.search(rf"\s{{{_RUN}}}", text):  # the quick splitter runs out of stack on millions of spaces in a row
            if self._whole is None:
                self._whole = tokenizers.Tokenizer.from_str(self._json.decode())
                self._whole.encode_special_tokens = True
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int64)
        return self._a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def cut(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, np.ndarray, str] | None]:
        """``(tokens, tokens, groups, pairs of links, digest of groups)`` of ``space + text`` for each text, None if it has no tokens."""
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            for t, ids in zip(some, self._b.encode([t or "" for t in some], num_threads=1)):
                whole = f" {t}".encode() if t else None
                if whole is None or b"".join(map(self._b_bytes.__getitem__, ids)) != whole:
                    yield None
                    continue
                a, b = self._first(f" {t}"), np.array(ids, np.int64)
                a_ends = np.cumsum(self._a_size[a])
                yield self._matched(a, b, a_ends, np.cumsum(self._b_size[b])) if a_ends[-1] == len(whole) else None

    def _matched(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[int, int, int, np.ndarray, str]:
        mark = np.zeros(a_ends[-1] + 1, np.uint8)
        mark[a_ends] = 1
        mark[b_ends] += 2
        kind = mark[np.flatnonzero(mark)]  # of each stretch's end: a token of the first side, of the second, or of both
        a_end, b_end, both = kind & 1, kind >> 1, kind == 3
        a_seen, b_seen = np.cumsum(a_end, dtype=np.int64), np.cumsum(b_end, dtype=np.int64)
        links = a[a_seen - a_end] * self.width + b[b_seen - b_end]
        # tokens in the order of the list: of each group the first side's, then the second's
        a_through, b_through = a_seen[both], b_seen[both]
        group = np.cumsum(both) - both
        a_group, b_group = group[a_end == 1], group[b_end == 1]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, b_through)[a_group]] = a * 2 + np.append(a_group[1:] != a_group[:-1], True)
        order[np.arange(len(b)) + a_through[b_group]] = (b + len(self._a_size)) * 2 + np.append(b_group[1:] != b_group[:-1], True)
        listed = "".join(map(self._written.__getitem__, order.tolist()))[:-1]
        return len(a), len(b), len(a_through), links, hashlib.sha256(listed.encode()).hexdigest()


_CUTTERS: dict[tuple[int, int], Cutter] = {}


def _cutter(held) -> Cutter:
    """This worker's tokenizers, made once."""
    key = tuple(map(xxhash.xxh64_intdigest, held.value))
    if key not in _CUTTERS:
        _CUTTERS.clear()
        _CUTTERS[key] = Cutter(*held.value)
    return _CUTTERS[key]


def run_of(pairs: np.ndarray, *counts: np.ndarray) -> bytes:
    """A run: chunks of sorted pairs and what belongs to each, compressed one by one."""
    made = []
    for at in range(0, len(pairs), CHUNK):
        part = pairs[at : at + CHUNK]
        made.append(blocks.pack(np.diff(part, prepend=0), *(c[at : at + CHUNK] for c in counts)))
    head = np.array([len(made), *map(len, made)], "<u4").tobytes()
    return head + b"".join(made)


def chunks(run: bytes) -> Iterator[list[np.ndarray]]:
    """The chunks of a run in order, each decompressed when it is asked for."""
    n = int(np.frombuffer(run, "<u4", 1)[0])
    at = 4 + 4 * n
    for size in np.frombuffer(run, "<u4", n, 4).tolist():
        pairs, *counts = blocks.unpack(run[at : at + size])
        at += size
        yield [np.cumsum(pairs), *counts]


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of the runs once, in order, with the sum of its counts; holds a chunk of each run."""
    left = [chunks(r) for r in runs]
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # by the next pair of each run

    def push(k: int, pairs: np.ndarray, counts: np.ndarray) -> None:
        if not len(pairs):
            pairs, counts = next(left[k], (pairs, counts))
        if len(pairs):
            heapq.heappush(heap, (int(pairs[0]), k, pairs, counts))

    none = np.empty(0, np.int64)
    for k in range(len(runs)):
        push(k, none, none)
    while heap:
        bound = min(int(x[2][-1]) for x in heap)  # up to here, all runs' chunks are in memory
        found = []
        while heap and heap[0][0] <= bound:
            _, k, pairs, counts = heapq.heappop(heap)
            n = int(np.searchsorted(pairs, bound, "right"))
            found.append((pairs[:n], counts[:n]))
            push(k, pairs[n:], counts[n:])
        yield summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))


def summed(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sums of their counts (None: one each)."""
    if counts is None:
        return np.unique(pairs, return_counts=True)
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _spill(held, shards: int, text: int, names: list[str], buffer: int):
    """A row for each document, and rows of the runs of each segment, by partition of the first side's ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task, number = _cutter(held), TaskContext.get().partitionId(), 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # pairs and how often, of documents of this segment
        made: list[tuple] = []
        ids: list[pa.Array] = []
        size = 0

        def segment() -> Iterator[pa.RecordBatch]:
            name = task << 32 | number
            empty = np.empty(0, np.int64)
            pairs, places, counts = np.unique(np.concatenate([k[0] for k in kept] or [empty]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(k[0]) for k in kept])
            blobs = [blocks.pack(np.diff(p.astype(np.uint32), prepend=np.uint32(0)), k[1].astype(np.uint32)) if len(p) else None for k, p in zip(kept, np.split(places, ends[:-1]))]
            columns = [pa.array([name] * len(made), pa.int64()), pa.nulls(len(made), pa.int32()), pa.array(blobs, pa.binary()), pa.concat_arrays(ids)]
            columns += [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*made))]
            for a in range(0, len(made), 4096):
                yield pa.RecordBatch.from_arrays([c[a : a + 4096] for c in columns], names=names)
            for k, (p, c) in blocks.by_shard((pairs // cutter.width) % shards, shards, pairs, counts.astype(np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([k], pa.int32()), pa.array([run_of(p, c)], pa.binary()), *(pa.nulls(1, c.type) for c in columns[3:])], names=names)

        for batch in it:
            at = 0  # rows of this batch that are in a segment
            for row, of in enumerate(cutter.cut(batch.column(text).to_pylist())):
                if of:
                    a, b, n, links, digest = of
                    kept.append(np.unique(links, return_counts=True))
                    made.append((a, b, n, len(links), digest))
                    size += len(kept[-1][0])
                else:
                    kept.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                    made.append((0, 0, 0, 0, ""))
                if size + len(made) > buffer:
                    ids.append(batch.column(0)[at : row + 1])
                    yield from segment()
                    at, number, size = row + 1, number + 1, 0
                    kept.clear(), made.clear(), ids.clear()
            ids.append(batch.column(0)[at:])
        if made:
            yield from segment()

    return run


def _by_part(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, int | None, bytes]]]]:
    """``((shard, part), rows)`` of batches sorted so; rows are ``(shard, block, blob)``, block None for an answer."""
    rows = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, found in groupby(rows, key=lambda r: (r[0], r[1])):
        yield key, [(r[0], r[2], r[3]) for r in found]


def _parts(runs: DataFrame, group: F.Column, tasks: int) -> DataFrame:
    return runs.select("shard", group.alias("part"), "block", "blob").repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", F.asc_nulls_first("block"))


def _answer_rows(made: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for row in made:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ANSWER_TYPE)], schema=_ANSWER_TYPE)


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run for each partition and group."""

    def made() -> Iterator[tuple[int, int, bytes]]:
        for (shard, part), found in _by_part(it):
            got = list(merged([r[2] for r in found]))
            yield shard, part, run_of(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))

    return _answer_rows(made())


def _judge(width: int):
    """Counts each pair of a partition, marks each side's highest, and answers every run."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, int, bytes]]:
            for (shard, _), found in _by_part(it):
                got = list(merged([r[2] for r in found]))
                pairs, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                side = pairs // width
                first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
                most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(pairs))))
                yield from _answers(shard, found, pairs, counts, (counts == most).astype(np.uint8))

        return _answer_rows(made())

    return run


def _answers(shard: int, runs: list[tuple[int, int | None, bytes]], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for _, block, blob in runs:
        asked = np.concatenate([c[0] for c in chunks(blob)])
        at = np.searchsorted(pairs, asked)
        yield shard, block, run_of(asked, counts[at], best[at])


def _pass_on(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers a group's blocks from the group's own answer, which comes first."""

    def made() -> Iterator[tuple[int, int, bytes]]:
        for (shard, _), (said, *runs) in _by_part(it):
            pairs, counts, best = (np.concatenate(x) for x in zip(*chunks(said[2])))
            yield from _answers(shard, runs, pairs, counts, best)

    return _answer_rows(made())


_ANSWERS = "shard int, block long, blob binary"
_ANSWER_TYPE = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def answered(runs: DataFrame, n: int, shards: int, width: int, fan: int) -> DataFrame:
    """Each of the runs' pairs with its count over all runs and whether it is its side's highest; ``n`` segments (``block``) made the runs."""
    if n <= fan:
        return _parts(runs, F.lit(0).cast("long"), shards).mapInArrow(_judge(width), _ANSWERS)
    runs, groups = cut(runs), -(-n // fan)
    group = F.pmod(F.xxhash64(F.lit(n), "block"), F.lit(groups))
    above = answered(_parts(runs, group, shards * groups).mapInArrow(_merge, _ANSWERS), groups, shards, width, fan)
    both = runs.select("shard", group.alias("part"), "block", "blob").unionByName(above.select("shard", F.col("block").alias("part"), F.lit(None).cast("long").alias("block"), "blob"))
    return _parts(both, F.col("part"), shards * groups).mapInArrow(_pass_on, _ANSWERS)


def _added_up(names: list[str]):
    """Adds up the answers for each document; of each segment the answers come first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, counts, best = None, [], None, None
        for batch in it:
            documents, n_best, sums = [], [], []
            for row, (segment, shard, blob) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if segment != own:
                    own, found, counts = segment, [], None
                if shard is not None:
                    found += chunks(blob)
                    continue
                documents.append(row)
                if blob is None:
                    n_best.append(0), sums.append(0)
                    continue
                if counts is None:  # in order of the pairs, as places were given
                    pairs, counts, best = (np.concatenate(x) for x in zip(*found))
                    order, found = np.argsort(pairs, kind="stable"), []
                    counts, best = counts[order], best[order]
                steps, often = blocks.unpack(blob)
                places = np.cumsum(steps, dtype=np.int64)
                n_best.append(int(often @ best[places].astype(np.int64)))
                sums.append(int(often @ counts[places]))
            kept = batch.take(pa.array(documents, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(3, 8)), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), kept.column(8)], names=names)

    return run


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES, shards: int | None = None, fan: int = FAN, buffer: int = BUFFER) -> DataFrame:
    """A row for each of ``docs``: its id, tokens of both sides, groups, links, links that are their first side's most frequent, and the sum of the links' counts.

    ``shards``: radix partitions of the first side's ids, 256 at most if not given.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((Path(byte_level).read_bytes(), Path(pieces).read_bytes()))  # the two vocabularies, 2 MB
    sides = sentencepiece.SentencePieceProcessor(model_proto=held.value[1]).get_piece_size()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shards = shards or min(256, width(spark))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links"))]
    digest = T.StructField("groups_sha256", T.StringType())
    spilled = T.StructType([T.StructField("segment", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("blob", T.BinaryType()), *fields, digest])
    made = cut(docs.mapInArrow(_spill(held, shards, 1, spilled.names, buffer), spilled))
    runs = made.where("shard is not null").select("shard", F.col("segment").alias("block"), "blob")
    n = runs.select("block").distinct().count()
    answers = answered(runs, n, shards, sides, fan).select(F.col("block").alias("segment"), "shard", "blob")
    both = made.where("shard is null").unionByName(answers, allowMissingColumns=True).repartition(max(width(spark), -(-n // 16)), "segment").sortWithinPartitions("segment", F.asc_nulls_last("shard"))
    out = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), digest])
    return both.mapInArrow(_added_up(out.names), out)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Each document's alignment between a byte-level vocabulary and a vocabulary of pieces."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
