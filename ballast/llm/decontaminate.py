"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every substring of the items' word sequences. A document's words are
streamed through it while the length of the longest match that ends at each word is tracked: a
match of ``window`` words or more marks those words as hit, and so does a whole item
that is shorter than a window.

The automaton is built on the driver and broadcast, so its size is bounded: the items are dealt
into blocks of at most ``max_block_bytes`` of text (measured by Spark beforehand), each with an
automaton of its own, and the documents are streamed past one block after the other. With one block nothing is
shuffled at all; with more, the matches of hit texts are kept, and are joined back by the text's SHA-256, so that
all blocks see the whole text. Copies of an item text are one text with several ids.

Nulls and empties: a null text has no words and is never hit; an item without words is never found;
a null item_id takes no part in ``items`` but its words still count as hit. Rows are handled one
by one, so ties and repeated rows keep their number. Other columns are carried along.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut
from ballast.llm.text import alnum_words, as_bytes, lower_alnum, spans_of

MAX_BLOCK_BYTES = 2_000_000


class SuffixAutomaton:
    """All substrings of several word sequences."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [self._add(ws) for _, ws in items]
        self.link[0] = 0
        #: items by the state of a window, and by the state of a whole short item
        self.found: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for (item, ws), end in zip(items, ends):
            if 0 < len(ws) < window:
                self.short.setdefault(end, set()).add(item)
            elif ws:
                state = 0
                for i, w in enumerate(ws):
                    state = self.next[state][w]
                    if i + 1 >= window:
                        self.found.setdefault(self.up(state), set()).add(item)
        self.least = min([window, *(len(ws) for _, ws in items if ws)])

    def _add(self, ws: list[bytes]) -> int:
        last = 0
        for w in ws:
            last = self._extend(last, w)
        return last

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def up(self, state: int) -> int:
        """The state of the last ``window`` words of a match of at least as many."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of words, merged and in order, and the items found."""
        nxt, link, length, window, least, short = self.next, self.link, self.length, self.window, self.least, self.short
        spans: list[tuple[int, int]] = []
        items: set = set()
        s = n = i = 0
        for w in ws:
            i += 1
            t = nxt[s].get(w)
            if t is None:
                while s:
                    s = link[s]
                    t = nxt[s].get(w)
                    if t is not None:
                        break
                else:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= least:
                if n >= window:
                    items |= self.found[self.up(s)]
                    spans.append((i - n, i))
                if short:
                    v = s
                    while v:
                        if v in short and length[v] <= n:
                            items |= short[v]
                            spans.append((i - length[v], i))
                        v = link[v]
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_id: str, text: str, max_block_bytes: int) -> Iterator[list[tuple]]:
    """Distinct item texts with their ids, by blocks; no block is collected whose size was not measured."""
    ids = F.collect_set("item")  # without nulls
    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").groupBy("text").agg(ids.alias("ids"))
    size = F.octet_length("text") + F.octet_length(F.array_join("ids", ","))
    total = named.agg(F.sum(size)).first()[0] or 0
    n = -(-total // max_block_bytes) or 1
    while n > 1:  # until the deal by hash leaves no block over the bound, or each text has its own
        dealt = named.groupBy(F.pmod(F.xxhash64("text"), F.lit(n)).alias("k")).agg(F.sum(size).alias("b"), F.max(size).alias("m"))
        if not dealt.where(f"b > {max_block_bytes} and b > m").take(1):
            break
        n *= 2
    for k in range(n):
        part = named if n == 1 else named.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        if (got := part.collect()) or n == 1:
            yield [(i, r.text) for r in got for i in r.ids or [None]]


def _first(blocks: Iterator[list[tuple]]) -> tuple[list[tuple], Iterator[list[tuple]] | None]:
    """The first block, and if there are more, all of them."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else itertools.chain([first, second], blocks)


def _automaton(spark, block: list[tuple], window: int):
    """The broadcast automaton of a block of items."""
    return spark.sparkContext.broadcast(SuffixAutomaton([(i, alnum_words(t.encode())) for i, t in block], window))


SPANS = "array<struct<a:long,b:long>>"


def _merged(spans: Column) -> Column:
    """:func:`merge` of an array of spans."""

    def one(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(out) > 0) & (s["a"] <= F.try_element_at(out, F.lit(-1))["b"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), one)


def _hits(texts: DataFrame, blocks: Iterator[list[tuple]], window: int) -> DataFrame:
    """``(key, spans, items)`` of each distinct text that any block hits, all blocks matched to the whole text; texts: ``(key, text)``.

    What a text matches depends on nothing but the text, so rows need no name of their own. One automaton is held at a time.
    """
    parts = []
    for k, block in enumerate(blocks):
        known = _automaton(texts.sparkSession, block, window)
        found = texts.mapInArrow(_matcher(known, only_hits=True), f"key string, n_words long, spans {SPANS}, items array<string>")
        parts.append(cut(found.withColumn("block", F.lit(k))))
        known.destroy()
    once = reduce(DataFrame.unionByName, parts).groupBy("key", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    return once.groupBy("key").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def match_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``(row of docs' doc_id, n_words, spans, items)`` for each document.

    ``spans`` are hit words as ``[from, to)`` pairs, merged and in order; ``items`` the ids of the items found,
    as strings, sorted.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    first, rest = _first(_blocks(items, item_id, item_text, max_block_bytes))
    if not rest:
        return own.mapInArrow(_matcher(_automaton(docs.sparkSession, first, window)), f"doc_id {kind}, n_words long, spans {SPANS}, items array<string>")
    keyed = own.withColumn("key", F.sha2("text", 256))
    hits = _hits(keyed.select("key", "text"), rest, window)
    counted = keyed.select("doc_id", "text", "key").mapInArrow(_counter, f"doc_id {kind}, n_words long, key string")
    return counted.join(apart(hits, "key"), "key", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n = pa.array([len(alnum_words(t)) for t in as_bytes(batch.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(2)], names=["doc_id", "n_words", "key"])


def _matcher(known, only_hits: bool = False):
    """Matches of ``(name, text)``; the name stays."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = known.value
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in it:
            n, spans, items = [], [], []
            for t in as_bytes(batch.column(1)):
                ws = alnum_words(t)
                hit, found = automaton.match(ws)
                n.append(len(ws))
                spans.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(str(x) for x in found if x is not None))
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[batch.schema.names[0], "n_words", "spans", "items"])
            yield made.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else made

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` without the spans that match items; columns as before.

    A document of whose words more than ``max_coverage`` are hit goes as a whole. Of the others
    each hit span is cut out of the text, from its first word to its last. Texts without a hit, null and
    empty ones among them, stay as they are. However many blocks the items make, all are matched to the text as it was.
    """
    at = docs.columns.index(text)
    first, rest = _first(_blocks(items, item_id, item_text, max_block_bytes))
    if not rest:
        return docs.mapInArrow(_cleaner(at, max_coverage, _automaton(docs.sparkSession, first, window)), docs.schema)
    keyed = docs.withColumn("__key", F.sha2(text, 256))
    hits = _hits(keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")), rest, window).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    return keyed.join(apart(hits, "__key"), "__key", "left").select(*docs.columns, "__spans").mapInArrow(_cleaner(at, max_coverage), docs.schema)


def _cleaner(at: int, max_coverage: float, known=None):
    """Cuts what an automaton finds, or else the spans of the last column, which goes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = known.value if known else None
        for batch in it:
            texts, keep, changed = as_bytes(batch.column(at)), [], False
            given = None if known else batch.column(batch.num_columns - 1).to_pylist()
            if not known:
                batch = batch.select(list(range(batch.num_columns - 1)))
            for k, t in enumerate(texts):
                if given is not None and not given[k]:
                    keep.append(True)
                    continue
                ws = alnum_words(t)
                hit = automaton.match(ws)[0] if known else [(x["a"], x["b"]) for x in given[k]]
                keep.append(sum(b - a for a, b in hit) <= max_coverage * len(ws))
                if hit:
                    texts[k], changed = cut_spans(t, hit), True
            if changed:
                column = pa.array(texts, pa.binary()).cast(batch.column(at).type)
                batch = pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans``, counted by :func:`alnum_words`."""
    starts, ends = spans_of(lower_alnum(text))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: how many words the windows of ``benchmark`` hit, and by which items."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = match_items(docs, items, window=10)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return got.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents))),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, win FROM (
    SELECT item_id, least(len(ws), 10) AS k, list_slice(ws, s, s + least(len(ws), 10) - 1) AS win
    FROM iw, range(1, 5000) r(s) WHERE len(ws) > 0 AND s <= len(ws) - least(len(ws), 10) + 1)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
firsts AS (SELECT DISTINCT win[1] AS w, k FROM win),
starts AS (SELECT dw.doc_id, dw.i, f.k FROM dw JOIN firsts f ON dw.w = f.w),
hits AS (
  SELECT s.doc_id, s.i, s.k, win.item_id FROM starts s JOIN doc d ON d.doc_id = s.doc_id
  JOIN win ON win.k = s.k AND win.win = list_slice(d.ws, s.i, s.i + s.k - 1)),
hw AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(0, 10) r(j) WHERE j < k GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
