"""Near duplicates by the exact Jaccard similarity of their sets of word shingles.

Every pair at the threshold or above is found and every link is verified; a SimHash only narrows the search. Three steps:

1. Candidates. In any one order of all shingles, two sets at the threshold share one of the first ``n - ceil(threshold * n) + 1`` shingles
   of each (n: its size). Texts meet by those. The order puts shingles last that are common in a sample of bounded size, so that a common
   line seldom makes texts meet; any order gives the same links.
2. Of texts that meet, those whose fingerprints of 256 bits (over distinct shingles) are within ``RADIUS`` are linked through BK-trees, by
   spanning links only. Two sets at 0.8 differ in 39 bits on average, with a standard deviation of 5.7, in tiny texts in 48 with 6.2: 80 bits are five
   deviations off or more, so fewer than one pair in a million is lost here. What these links join is a group of candidates, not yet of near duplicates.
3. The texts of a group are compared by their shingle sets, and linked where the similarity is at the threshold. Groups with more than
   ``max_group_bytes`` of text are split into shards (see ``spread``). Components come from star rounds.

Exact up to collisions of 64-bit hashes. Within a group, as in a tree, one link to each component already linked is enough, so n near copies give
n links. Nulls and empties: a null or empty text has no shingles and is a copy of any other such. Texts of fewer words than a shingle
have one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut, width
from ballast.llm.simhash import MAX_TREE, links_within, print_of, shingles
from ballast.llm.spread import linked
from ballast.llm.text import as_bytes, batches, lower_words
from ballast.operators.components import connected_components

BITS, RADIUS = 256, 80
MAX_GROUP_BYTES = 2_000_000
#: Shingles that so many of about so many sampled texts have come last in the order; at most so many are kept.
SAMPLE_TEXTS, COMMON_TEXTS, MOST_COMMON = 4_000, 5, 200_000


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingles(lower_words(text), shingle))


def least_common(n: int, threshold: float) -> int:
    """How many of ``n`` shingles another set must share to be at the threshold, at least."""
    return math.ceil(threshold * n - 1e-9)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the sets' Jaccard similarity is at the threshold."""
    few, many = sorted((len(a), len(b)))
    if few < least_common(many, threshold):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (few + many - common) - 1e-9


class Order:
    """Shingles by their number of sampled texts, then by hash."""

    def __init__(self, common: dict[int, int]):
        self.hash = np.array(sorted(common), np.uint64)
        self.count = np.array([common[h] for h in sorted(common)], np.int64)

    def first(self, own: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the set by which it meets all that are similar."""
        k = len(own) - least_common(len(own), threshold) + 1 if len(own) else 0
        if not len(self.hash):
            return own[:k]
        at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        return own[np.argsort(np.where(self.hash[at] == own, self.count[at], 0), kind="stable")[:k]]


class Group:
    """Shingle sets with the components of what was linked so far."""

    def __init__(self, threshold: float, order: Order | None = None):
        self.threshold, self.order = threshold, order or Order({})
        self.sets: list[np.ndarray] = []
        self.parent: list[int] = []
        self.size: dict[int, int] = {}  # by component, which its first set names
        self.at: dict[int, list[int]] = {}  # sets by the shingles that they meet by

    def find(self, n: int) -> int:
        up = self.parent
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    def search(self, own: np.ndarray) -> list[int]:
        """Similar sets, one at least of each component that has any."""
        near, joined, left, tried = [], set(), len(self.sets), set()
        for root in sorted(self.size, key=lambda r: (-self.size[r], r))[:4]:  # so that a large group of copies needs one comparison
            tried.add(root)
            if alike(self.sets[root], own, self.threshold):
                near.append(root)
                joined.add(root)
                left -= self.size[root]
        if not left:
            return near
        for h in self.key(own):
            for n in self.at.get(h, ()):
                if n not in tried:
                    tried.add(n)
                    if (r := self.find(n)) not in joined and alike(self.sets[n], own, self.threshold):
                        near.append(n)
                        joined.add(r)
        return near

    def key(self, own: np.ndarray) -> list[int]:
        return self.order.first(own, self.threshold).tolist() if len(own) else [-1]  # rare ones first, so that near copies do not all meet

    def add(self, own: np.ndarray) -> list[int]:
        """Adds a set; returns those it is linked to."""
        near, new = self.search(own), len(self.sets)
        self.sets.append(own)
        self.parent.append(new)
        roots = {self.find(n) for n in near} | {new}
        root = min(roots)
        for r in roots:
            self.parent[r] = root
        self.size[root] = sum(self.size.pop(r, 1) for r in roots)
        for h in self.key(own):
            self.at.setdefault(h, []).append(new)
        return near


def _common(texts: DataFrame, shingle: int) -> dict[int, int]:
    """Shingles of more than a few texts of a sample with their number of texts; of bounded size."""
    every = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("nid"), F.lit(every)) == 0).dropDuplicates(["nid"]).select("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t in as_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["h"])

    got = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_TEXTS).orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    return dict(zip(got["h"].to_numpy().view(np.uint64).tolist(), got["count"].to_pylist()))


def _signer(known, shingle: int, threshold: float):
    """Fingerprint and keys of each text; of copies in a task, one has keys."""
    names = ["doc_id", "nid", "fingerprint", "keys"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = known.value, {}
        for batch in it:
            prints, keys = [], []
            for nid, t in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if nid in done:
                    prints.append(done[nid])
                    keys.append(None)
                    continue
                own = shingle_set(t, shingle)
                prints.append(print_of(own, BITS))
                keys.append(order.first(own, threshold).view(np.int64))
                done[nid] = prints[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return run


def _meeting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(key, nid)`` in order, each once, those whose key has others."""
    schema = pa.schema([("key", pa.int64()), ("nid", pa.int64())])

    def rows() -> Iterator[tuple[int, int]]:
        at, last, first = None, None, False
        for batch in it:
            for key, nid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    at, last, first = key, nid, True
                elif nid != last:
                    if first:
                        yield key, last
                    yield key, nid
                    last, first = nid, False

    return batches(rows(), schema)


def _linker(known, shingle: int, threshold: float):
    def make():
        group, nids = Group(threshold, known.value), []

        def find(late: bool, nid: int, text: str | None) -> list[int]:
            own = shingle_set(text.encode() if text is not None else None, shingle)
            near = group.search(own) if late else group.add(own)
            if not late:
                nids.append(nid)
            return [nids[k] for k in near]

        return find

    return make


def _pivoter(shingle: int, threshold: float):
    def make():
        pivots: list[tuple[np.ndarray, int]] = []

        def find(late: bool, nid: int, text: str | None) -> list[int]:
            own = shingle_set(text.encode() if text is not None else None, shingle)
            if late:
                return [p for x, p in pivots if alike(x, own, threshold)]
            pivots.append((own, nid))
            return []

        return find

    return make


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, max_tree: int = MAX_TREE, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: that of the smallest doc_id.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``threshold`` or more. Where texts of one component share the smallest
    doc_id, the one of the least text hash stays. Columns stay. Rows with a null doc_id take no part and stay as they are.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(doc_id).isNotNull()).withColumn("__nid", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    own = named.select(F.col(doc_id).alias("doc_id"), F.col("__nid").alias("nid"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(Order(_common(own, shingle)))
    signed = own.mapInArrow(_signer(order, shingle, threshold), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, nid long, fingerprint binary, keys array<long>")
    held = cut(signed.groupBy("nid").agg(F.min("doc_id").alias("least"), F.min("fingerprint").alias("fingerprint"), F.max("keys").alias("keys")))
    distinct = held.drop("keys")
    dealt = held.select(F.explode("keys").alias("key"), "nid")
    met = cut(dealt.repartition(width(spark), "key").sortWithinPartitions("key", "nid").mapInArrow(_meeting, "key long, nid long"))
    prints = cut(met.join(apart(distinct.select("nid", "fingerprint"), "nid"), "nid").select(F.col("key").alias("grp"), F.col("fingerprint").alias("id")).distinct())
    roots = connected_components(links_within(prints, RADIUS, max_tree), "a", "b").withColumnRenamed("node", "fingerprint")

    grouped = distinct.join(apart(roots, "fingerprint"), "fingerprint", "left").withColumn("whole", F.coalesce("root", "fingerprint"))
    several = grouped.groupBy("whole").count().where("count > 1").select("whole")
    members = cut(grouped.join(apart(several, "whole"), "whole").select("nid", "least", F.xxhash64("whole").alias("grp")))
    texts = own.join(apart(members.withColumnRenamed("least", "doc_id"), "doc_id"), ["doc_id", "nid"]).groupBy(F.col("nid").alias("id")).agg(F.first("grp").alias("grp"), F.first("text").alias("text"))
    links = linked(cut(texts.select("grp", "id", "text")), F.coalesce(F.octet_length("text"), F.lit(0)), max_group_bytes, _linker(order, shingle, threshold), _pivoter(shingle, threshold))

    joined = connected_components(links, "a", "b").join(members.select(F.col("nid").alias("node"), "least"), "node")
    kept = joined.groupBy("root").agg(F.min(F.struct("least", "node")).alias("kept"))
    gone = joined.join(apart(kept, "root"), "root").where("node <> kept.node").select(F.col("node").alias("__nid"))
    # copies of one text: the row of the smallest doc_id, once
    stays = cut(distinct.join(gone, distinct["nid"] == gone["__nid"], "left_anti").select(F.col("least").alias("__least"), F.col("nid").alias("__kept")))
    one = named.join(stays, (named[doc_id] == stays["__least"]) & (named["__nid"] == stays["__kept"]), "left_semi").dropDuplicates([doc_id, "__nid"]).drop("__nid")
    return one.unionByName(docs.where(F.col(doc_id).isNull()))
