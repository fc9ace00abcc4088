"""SimHash near-duplicates linked through BK-trees.

Fingerprints are made without a shuffle. Equal fingerprints are one node, whatever the number of their documents.
Distinct fingerprints are dealt to bands (equal values of chosen bits), so that only fingerprints that can be
near each other meet, and each band's fingerprints form a BK-tree: children are keyed by their
Hamming distance to the parent, and a search follows only the edges within the radius of its own distance.
A band with more than ``max_tree`` fingerprints is split into shard trees, and its fingerprints are also searched for
in the shards other than their own, but for those near one pivot (see ``spread``). Trees travel by shuffle, never through the driver: fingerprints grow
with the corpus, so a broadcast of all shards has no size bound.

Within a tree only spanning links are kept (a subtree already linked as a whole is not entered again), so a group of n near
copies gives n links, not n squared. Components come from star rounds over these links.

Nulls and empties: a null or empty text has no words and fingerprint zero, linked like any other. Texts of fewer words than
a shingle have one shingle. Very long texts are read whole. Repeated rows keep their number; rows that share a doc_id have a fingerprint each; a null doc_id is never the component's name
unless all are null. Other columns play no part. No rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut
from ballast.llm.spread import linked
from ballast.llm.text import as_bytes, lower_words, mix
from ballast.operators.components import connected_components

MAX_TREE = 20_000


def shingles(ws: list[bytes], shingle: int) -> np.ndarray:
    """The hash of each shingle of the words, repeated ones as often as they are there."""
    if not ws:
        return np.zeros(0, np.uint64)
    text, k = b" ".join(ws), min(shingle, len(ws))
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = np.concatenate(([0], ends[: len(ws) - k])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(ws: list[bytes], shingle: int, bits: int) -> bytes:
    """The SimHash of the words' shingles, big-endian."""
    return print_of(shingles(ws, shingle), bits)


def print_of(h: np.ndarray, bits: int) -> bytes:
    """The SimHash of hashed shingles, big-endian; zero if there are none."""
    if not len(h):
        return bytes(bits // 8)
    out = []
    for salt in range(bits // 64):
        own, ones = h if salt == 0 else mix(h, salt), np.zeros(64, np.int64)
        for at in range(0, len(own), 16384):
            part = own[at : at + 16384].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(h), bitorder="little")[::-1].tobytes())
    return b"".join(out)


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """``(doc_id, fingerprint binary)`` for each row; 64 bits or a multiple of them."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = pa.array([fingerprint(lower_words(t), shingle, bits) for t in as_bytes(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fingerprint"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def exact_bands(bits: int, radius: int) -> list[list[int]]:
    """Bit positions by band such that any two fingerprints within the radius agree on a whole band.

    The bits are cut into ``radius + 2`` blocks; at least two of them have no differing bit.
    """
    n = radius + 2
    blocks = [list(range(k * bits // n, (k + 1) * bits // n)) for k in range(n)]
    return [a + b for a, b in itertools.combinations(blocks, 2)]


def sampled_bands(bits: int, band_bits: int, bands: int, seed: int = 42) -> list[list[int]]:
    """Bands of randomly chosen bits, for radii too large for :func:`exact_bands`.

    Fingerprints that differ in a share p of their bits meet with probability
    ``1 - (1 - (1 - p) ** band_bits) ** bands``.
    """
    draw = Random(seed)
    return [sorted(draw.sample(range(bits), band_bits)) for _ in range(bands)]


class Forest:
    """BK-trees over fingerprints with the components of what was linked so far."""

    def __init__(self, radius: int):
        self.radius = radius
        self.value: list[int] = []
        self.below: list[dict[int, int]] = []
        self.parent: list[int] = []  # union-find
        self.whole: list[int | None] = []  # a node of the one component that the subtree belongs to

    def find(self, n: int) -> int:
        up = self.parent
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    def search(self, x: int) -> list[int]:
        """Nodes near ``x``, one at least of each component that has any."""
        near, stack, joined = [], [0] if self.value else [], set()
        while stack:
            n = stack.pop()
            d = (self.value[n] ^ x).bit_count()
            if d <= self.radius and (r := self.find(n)) not in joined:
                near.append(n)
                joined.add(r)
            low, high = d - self.radius, d + self.radius
            for k, c in self.below[n].items():
                if low <= k <= high and ((w := self.whole[c]) is None or self.find(w) not in joined):
                    stack.append(c)
        return near

    def add(self, x: int) -> list[int]:
        """Puts ``x`` into the tree; returns the nodes it is linked to."""
        near, new = self.search(x), len(self.value)
        self.parent.append(new)
        for n in near:
            self.parent[self.find(n)] = new
        self.value.append(x)
        self.below.append({})
        self.whole.append(new)
        n = 0
        while n != new:
            if (w := self.whole[n]) is not None and self.find(w) != new:
                self.whole[n] = None
            d = (self.value[n] ^ x).bit_count()
            n = self.below[n].setdefault(d, new)
        return near


def near_links(distinct: DataFrame, bands: list[list[int]], radius: int, max_tree: int = MAX_TREE) -> DataFrame:
    """Links ``(a, b)`` between fingerprints within the radius that share a band; distinct: ``(fingerprint)``."""
    dealt = distinct.select("fingerprint").mapInArrow(_dealer(bands), "band int, key long, fingerprint binary")
    return links_within(dealt.select(F.xxhash64("band", "key").alias("grp"), F.col("fingerprint").alias("id")), radius, max_tree)


def links_within(dealt: DataFrame, radius: int, max_tree: int = MAX_TREE) -> DataFrame:
    """Links ``(a, b)`` between fingerprints within the radius that share a group; dealt: ``(grp long, id binary)``."""
    return linked(dealt, F.lit(1), max_tree, _linker(radius), _pivoter(radius))


def _dealer(bands: list[list[int]]):
    schema = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("fingerprint", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = batch.column(0)
            if not len(prints):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1), axis=1)
            for k, chosen in enumerate(bands):
                weights = np.left_shift(np.uint64(1), np.arange(len(chosen), dtype=np.uint64))
                key = (bits[:, chosen].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), prints.cast(pa.binary())], schema=schema)

    return run


def _linker(radius: int):
    """A shard's tree, made when there is a second fingerprint, as most shards hold one."""

    def make():
        forest, prints = Forest(radius), []

        def find(late: bool, fp: bytes) -> list[bytes]:
            if late:
                if prints and not forest.value:
                    forest.add(int.from_bytes(prints[0]))
                return [prints[n] for n in forest.search(int.from_bytes(fp))]
            prints.append(fp)
            if len(prints) == 1:
                return []
            if not forest.value:
                forest.add(int.from_bytes(prints[0]))
            return [prints[n] for n in forest.add(int.from_bytes(fp))]

        return find

    return make


def _pivoter(radius: int):
    def make():
        pivots: list[tuple[int, bytes]] = []

        def find(late: bool, fp: bytes) -> list[bytes]:
            x = int.from_bytes(fp)
            if late:
                return [p for y, p in pivots if (x ^ y).bit_count() <= radius]
            pivots.append((x, fp))
            return []

        return find

    return make


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2, bands: list[list[int]] | None = None, max_tree: int = MAX_TREE) -> DataFrame:
    """``(doc_id, fingerprint binary, component_id)`` for each row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits. With
    ``bands`` unset no link is missed; :func:`sampled_bands` serves larger radii.
    """
    signed = cut(signatures(docs, doc_id=doc_id, text=text, shingle=shingle, bits=bits))
    distinct = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    links = near_links(distinct, bands or exact_bands(bits, radius), radius, max_tree)
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "fingerprint")
    named = roots.join(distinct, "fingerprint").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(named, "root").select("fingerprint", "component")
    each = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component_id"))
    return signed.join(apart(each, "fingerprint"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document, linked at two differing bits or fewer."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
