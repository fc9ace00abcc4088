"""Substring dedup with difference-cover anchors.

A word is removed if it lies in a window of ``window`` consecutive words whose sequence also starts in a document with a smaller
id. Windows are found in two steps. Short anchors of ``anchor`` words are hashed only at positions whose remainder by a
period belongs to a difference cover: for any two positions there is one shift below the period that brings both onto the
cover, so wherever two windows match, both hold a matching anchor at the same offset (``anchor + period - 1 <= window``). The windows around
shared anchors are then compared as wholes, by 96 bits of hash, and each word sequence's least document is found.
Both steps ask hash shards from blocks of documents (see ``blocks``; more of them where texts would make one too large), so a passage that many documents share is one hash
per block. Texts are shuffled once per later step.

Windows are judged on the input: what is removed elsewhere makes no difference. Null and empty texts and texts shorter than a window
stay whole. Rows with the same doc_id do not remove each other, nor do parts of one text. A row with a null doc_id stays whole and
removes nothing, as no id is smaller or larger. doc_id must be integral.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ballast.functions.durable import cut
from ballast.llm import blocks
from ballast.llm.text import as_bytes, mix, spans_of, words

#: A perfect difference set: each remainder by 31 but zero is one difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW, ANCHOR = 50, 20
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of all windows of a word sequence, for two multipliers."""

    def __init__(self):
        self.power = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def windows(self, codes: np.ndarray, length: int, k: int = 0) -> np.ndarray:
        n = len(codes)
        if len(self.power[k]) < n:
            size = 2 * n
            inv = np.uint64(pow(int(_M[k]), -1, 2**64))
            self.power[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _M[k]))))
            self.inverse[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, inv))))
        own = codes if k == 0 else mix(codes, 5)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * self.power[k][:n])))
        return mix((sums[length:] - sums[:-length]) * self.inverse[k][: n - length + 1], k)


def cover_positions(n: int) -> np.ndarray:
    """Positions below ``n`` on the cover, in order."""
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def _ids(batch: pa.RecordBatch, doc_id: str) -> list:
    return batch.column(batch.schema.get_field_index(doc_id)).to_pylist()


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    return as_bytes(batch.column(batch.schema.get_field_index(text)))


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(n)


def _ask_anchors(n: int, doc_id: str, text: str):
    """Anchors with the block that wants to know, and whether several of its documents have it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        coder, rolling = blocks.Coder(), Rolling()
        for batch in it:
            own, to = [], []
            for d, t, b in zip(_ids(batch, doc_id), _texts(batch, text), _ids(batch, "__block")):
                ws = words(t)
                if d is None or len(ws) < WINDOW:
                    continue
                h = np.unique(rolling.windows(coder.codes(ws), ANCHOR)[cover_positions(len(ws) - ANCHOR + 1)])
                own.append(h)
                to.append(np.full(len(h), b, np.int32))
            if own:
                h, b = np.concatenate(own), np.concatenate(to)
                order = np.lexsort((b, h))
                h, b = h[order], b[order]
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
                many = np.diff(np.concatenate((np.flatnonzero(first), [len(h)]))) > 1
                h, b = h[first], b[first]
                for k, (x, y, z) in blocks.by_shard(_shard(h, n), n, h, b, many.astype(np.uint8)):
                    yield k, 0, blocks.pack(x, y, z)

    return run


def _shared_anchors(n: int):
    def run(asked: list[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, int, bytes]]:
        shard = int(_shard(asked[0][1][0][:1], n)[0])
        h, b, many = (np.concatenate([x[1][k] for x in asked]) for k in range(3))
        order = np.argsort(h, kind="stable")
        h, b, many = h[order], b[order], many[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(h)])))
        shared = np.repeat((sizes > 1) | (np.add.reduceat(many.astype(np.int64), starts) > 0), sizes)
        for block, (x,) in blocks.by_shard(b[shared].astype(np.uint64), n, h[shared]):
            yield shard, block, blocks.pack(np.unique(x))

    return run


def _within(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of ``h`` is in sorted ``known``; -1 where it isn't."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _found(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where each ``(x, y)`` is in the sorted ``(a, b)``, -1 if it is not; those of one ``a`` are gone through one by one, being few."""
    at = _within(a, x)
    out, open_ = np.full(len(x), -1, np.int64), np.flatnonzero(at >= 0)
    while len(open_):
        right = b[at[open_]] == y[open_]
        out[open_[right]] = at[open_[right]]
        open_ = open_[~right]
        at[open_] += 1
        open_ = open_[at[open_] < len(a)]
        open_ = open_[a[at[open_]] == x[open_]]
    return out


def _ask_windows(n: int, doc_id: str, text: str):
    """Windows around shared anchors, with the least document of each in the block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        answers, batches = blocks.answers_first(it)
        known = np.sort(np.concatenate([x[0] for x in answers])) if answers else np.empty(0, np.uint64)
        coder, rolling, block = blocks.Coder(), Rolling(), None
        one, two, docs = [], [], []
        for batch in batches if len(known) else ():
            for d, t, block in zip(_ids(batch, doc_id), _texts(batch, text), _ids(batch, "__block")):
                ws = words(t)
                if d is None or len(ws) < WINDOW:
                    continue
                codes, at = coder.codes(ws), cover_positions(len(ws) - ANCHOR + 1)
                hit = at[_within(known, rolling.windows(codes, ANCHOR)[at]) >= 0]
                if not len(hit):
                    continue
                last = len(ws) - WINDOW
                edge = np.zeros(last + 2, np.int64)
                np.add.at(edge, np.minimum(np.maximum(hit - (WINDOW - ANCHOR), 0), last + 1), 1)
                np.add.at(edge, np.minimum(hit + 1, last + 1), -1)
                starts = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
                one.append(rolling.windows(codes, WINDOW)[starts])
                two.append((rolling.windows(codes, WINDOW, 1)[starts] >> np.uint64(32)).astype(np.uint32))
                docs.append(np.full(len(starts), d, np.int64))
        if one:
            a, b, d = np.concatenate(one), np.concatenate(two), np.concatenate(docs)
            a, b, d, many = _least(a, b, d)
            for k, parts in blocks.by_shard(_shard(a, n), n, a, b, d, many):
                yield k, block, blocks.pack(*parts)

    return run


def _least(a: np.ndarray, b: np.ndarray, d: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct ``(a, b)`` in order, the least ``d`` of each, and whether it has several."""
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    ends = np.concatenate((starts[1:], [len(a)])) - 1
    several = d[ends] != d[starts]
    if many is not None:
        several |= np.add.reduceat(many[order].astype(np.int64), starts) > 0
    return a[starts], b[starts], d[starts], several.astype(np.uint8)


def _least_documents(n: int):
    """To each block, its windows that start in a smaller document than any of its own; then those that only documents of its own share.

    The first need no more than their hashes, as all of them go; the others come with their least document.
    """

    def run(asked: list[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, int, bytes]]:
        shard = int(_shard(asked[0][1][0][:1], n)[0])
        a, b, d, many = _least(*(np.concatenate([x[1][k] for x in asked]) for k in range(4)))
        a, b, d = a[many > 0], b[many > 0], d[many > 0]
        for block, (x, y, own, several) in asked:
            at = _found(a, b, x, y)
            hit = np.flatnonzero(at >= 0)
            least = d[at[hit]]
            elsewhere, here = hit[least < own[hit]], hit[(least == own[hit]) & (several[hit] > 0)]
            if len(elsewhere) or len(here):
                yield shard, block, blocks.pack(x[elsewhere], y[elsewhere], x[here], y[here], own[here])

    return run


def _judge(doc_id: str, text: str, each: Callable, assemble: Callable):
    """``assemble(batch, [each(text, words, removed flags or None)])`` for the documents of a block; words live no longer than their text's turn."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, batches = blocks.answers_first(it)
        if answers:
            gone, gone2, a, b, least = (np.concatenate([x[k] for x in answers]) for k in range(5))
            a, b, least = np.concatenate((a, gone)), np.concatenate((b, gone2)), np.concatenate((least, np.full(len(gone), np.iinfo(np.int64).min)))
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
        coder, rolling = blocks.Coder(), Rolling()
        for batch in batches:
            if not len(batch):
                continue
            made = []
            for d, t in zip(_ids(batch, doc_id), _texts(batch, text)):
                ws, removed = words(t), None
                if answers and d is not None and len(ws) >= WINDOW:
                    codes = coder.codes(ws)
                    one = rolling.windows(codes, WINDOW)
                    some = np.flatnonzero(_within(a, one) >= 0)
                    if len(some):  # the second hash tells for sure
                        two = (rolling.windows(codes, WINDOW, 1)[some] >> np.uint64(32)).astype(np.uint32)
                        at = _found(a, b, one[some], two)
                        starts = some[(at >= 0) & (least[at] < d)]
                    else:
                        starts = some
                    if len(starts):
                        edge = np.zeros(len(ws) + 1, np.int64)
                        edge[starts] += 1
                        edge[starts + WINDOW] -= 1
                        removed = np.cumsum(edge)[: len(ws)] > 0
                made.append(each(t, ws, removed))
            yield assemble(batch, made)

    return run


def _through(docs: DataFrame, doc_id: str, text: str, each: Callable, assemble: Callable, schema) -> DataFrame:
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} is not of an integral type")
    n = blocks.number(docs, text)
    block = blocks.block_of(doc_id, text, n)
    light = docs.select(doc_id, text)
    shared = blocks.answer(blocks.ask(light.withColumn("__block", block), _ask_anchors(n, doc_id, text)), n, _shared_anchors(n))
    windows = blocks.ask(blocks.dealt(light, n, block, shared), _ask_windows(n, doc_id, text))
    least = cut(blocks.answer(windows, n, _least_documents(n)))
    return blocks.dealt(docs, n, block, least).mapInArrow(_judge(doc_id, text, each, assemble), schema)


def judge_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each row; the digest is of the kept words, space-joined."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def each(_: bytes | None, ws: list[bytes], removed: np.ndarray | None) -> tuple[int, int, str]:
        kept = ws if removed is None else [w for w, x in zip(ws, removed.tolist()) if not x]
        return len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    def assemble(batch: pa.RecordBatch, made: list) -> pa.RecordBatch:
        n, gone, digests = zip(*made)
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _through(docs, doc_id, text, each, assemble, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated words; what else a text holds stays, and so do the columns.

    A document of which no word is left goes as a whole.
    """
    names = docs.columns

    def each(t: bytes | None, _: list[bytes], removed: np.ndarray | None) -> tuple[bytes | None, bool]:
        if removed is None:
            return t, True
        starts, ends = spans_of(t)
        cuts = np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])).astype(np.int8)))
        out, at = [], 0
        for x, y in cuts.reshape(-1, 2).tolist():
            out.append(t[at : starts[x]])
            at = ends[y - 1]
        return b"".join([*out, t[at:]]), not removed.all()

    def assemble(batch: pa.RecordBatch, made: list) -> pa.RecordBatch:
        texts, keep = zip(*made)
        columns = [pa.array(texts, pa.binary()).cast(batch.column(batch.schema.get_field_index(c)).type) if c == text else batch.column(batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return _through(docs, doc_id, text, each, assemble, T.StructType(docs.schema.fields))


def op10_substring(spark, sf_dir: str) -> DataFrame:
    """What is left of each document without words that earlier documents' windows cover."""
    return judge_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, hash(list_slice(ws, i, i + 49)) AS h, list_slice(ws, i, i + 49) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
firsts AS (SELECT h, win, min(doc_id) AS least FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)) GROUP BY h, win),
dup AS (SELECT w.doc_id, w.i FROM w JOIN firsts f ON w.h = f.h AND w.win = f.win WHERE f.least < w.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM dup, range(0, 50) r(j)),
each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.w, ' ' ORDER BY e.i) AS s FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
