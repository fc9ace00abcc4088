"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read from sorted hash arrays.

Tokens are words and one end mark per text; a begin mark is the first token's context. Counting is a question of document blocks to
hash shards (see ``blocks``): a block sends each distinct bigram of its texts once, with its count in training texts; bigram shards
add these up and pass partial sums of each word as context and as continuation on to word shards. So nothing is pruned, no
frequent word makes a task large (a context's bigrams are spread over a twenty-fourth of the shards), and only counts of counts, a few numbers,
reach the driver.

A model can be stored (:func:`fit`) and asked by any texts later (:func:`score`). Where the texts to score are those that are counted (:func:`score_all`), shards answer at once.
For scoring, each block gets back the slice of the model that its own texts need, in hash order. A worker writes its slice to an
unlinked temporary file and maps it into memory: sorted 64-bit hashes beside their log probabilities, found by
binary search. A slice is bounded by its block, so no worker ever needs the whole model.

Nulls and empties: a null or empty text has no words, and is scored as the end mark after the begin mark. A null doc_id counts as
training. Repeated rows are counted and scored each, rows that share a doc_id too. Very long texts are whole in their block, whose size is bounded on average only. Without any
training text all probability is uniform. Other columns play no part. No rows give no rows.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import cut, written
from ballast.llm import blocks
from ballast.llm.text import as_bytes, lower_words, mix

BEGIN, END = b"\n<s>", b"\n</s>"  # no words, as they hold white space
PAIRS, CONTEXTS, ENDINGS, WORDS, FACTS, PAIR_MODEL, WORD_MODEL = range(7)  # kinds of rows between the steps
_ROWS = "kind int, shard int, block int, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])


def _batches(made: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for row in made:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA)], schema=_SCHEMA)


def _pair_shard(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    spread = np.uint64(max(1, n // 24))
    return ((u >> np.uint64(33)) + (v >> np.uint64(33)) % spread) % np.uint64(n)


def _pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + v)


def _word_shard(w: np.ndarray, n: int) -> np.ndarray:
    return (w >> np.uint64(33)) % np.uint64(n)


class Block:
    """The tokens of a block's texts as codes, with its distinct words and bigrams in order."""

    def __init__(self, n: int):
        self.n, self.coder, self.texts, self.held = n, blocks.Coder(), [], []
        self.begin, self.end = (np.array([self.coder[x]], np.uint64) for x in (BEGIN, END))

    def add(self, text: bytes | None, held_out: bool) -> None:
        self.texts.append(np.concatenate((self.begin, self.coder.codes(lower_words(text)), self.end)))
        self.held.append(held_out)

    def index(self, counts: bool = True) -> None:
        """Finds what is distinct; ``counts``: also how often it occurs in training."""
        flat = np.concatenate(self.texts)
        self.sizes = np.array([len(x) - 1 for x in self.texts])  # tokens, without begin marks
        self.texts = None
        self.words, rank = np.unique(flat, return_inverse=True)
        first = np.zeros(len(flat), bool)
        first[np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1]))] = True
        at = np.flatnonzero(~first)  # tokens; the one before is the context
        size = np.int64(len(self.words))
        self.tokens = rank[at]
        self.token_pairs = rank[at - 1] * size + self.tokens
        del flat
        if counts:
            trained = np.repeat(~np.array(self.held, bool), self.sizes)
            self.pairs, where = np.unique(self.token_pairs, return_inverse=True)
            self.pair_counts = np.bincount(where[trained], minlength=len(self.pairs)).astype(np.uint32)
            self.word_counts = np.bincount(self.tokens[trained], minlength=len(self.words)).astype(np.uint32)
        else:
            self.pairs, self.pair_counts, self.word_counts = np.unique(self.token_pairs), None, np.zeros(len(self.words), np.uint32)
        self.u, self.v = self.pairs // size, self.pairs % size
        self.shard = _pair_shard(self.words[self.u], self.words[self.v], self.n).astype(np.int64)

    def asks(self, block: int) -> Iterator[tuple[int, int, int, bytes]]:
        counts = self.pair_counts if self.pair_counts is not None else np.zeros(len(self.pairs), np.uint32)
        for k, (u, v, c) in blocks.by_shard(self.shard, self.n, self.words[self.u], self.words[self.v], counts):
            starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            yield PAIRS, k, block, blocks.pack(u[starts], np.diff(np.concatenate((starts, [len(u)]))).astype(np.uint32), v, c)
        for k, (w, c) in blocks.by_shard(_word_shard(self.words, self.n), self.n, self.words, self.word_counts):
            yield WORDS, k, block, blocks.pack(w, c)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], *(np.add.reduceat(x[order].astype(np.int64), starts) for x in values)


def _levels(c: np.ndarray) -> np.ndarray:
    """How many of ``c`` are 1, 2, 3, 4 and more than 2; then how many are not 0, and their sum."""
    return np.array([*((c == k).sum() for k in (1, 2, 3, 4)), (c > 2).sum(), (c > 0).sum(), c.sum()], np.int64)


def _count_pairs(n: int, keep: bool = False):
    """Totals of the bigrams of a shard, on to word shards and back to the blocks that hold them; ``keep``: as part of a stored model instead."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        us, vs, cs, asked, shard = [], [], [], [], 0
        for batch in it:
            for kind, shard, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == WORDS:
                    yield kind, shard, block, blob
                    continue
                u, runs, v, c = blocks.unpack(blob)
                us.append(np.repeat(u, runs))
                vs.append(v)
                cs.append(c)
                asked.append((block, len(v)))
        if not asked:
            return
        u, v, c = np.concatenate(us), np.concatenate(vs), np.concatenate(cs).astype(np.int64)
        us.clear(), vs.clear(), cs.clear()
        order = np.lexsort((v, u))
        su, sv = u[order], v[order]
        first = np.concatenate(([True], (su[1:] != su[:-1]) | (sv[1:] != sv[:-1])))
        starts = np.flatnonzero(first)
        total = np.add.reduceat(c[order], starts)
        back = np.empty(len(c), np.uint32)
        back[order] = total[np.cumsum(first) - 1]
        at = 0
        for block, size in asked if not keep else ():
            yield PAIRS, shard, block, blocks.pack(back[at : at + size])
            at += size
        seen = total > 0
        su, sv, total = su[starts][seen], sv[starts][seen], total[seen]
        if keep:
            h = _pair_hash(su, sv)
            order = np.argsort(h)
            yield PAIR_MODEL, shard, 0, blocks.pack(h[order], total[order].astype(np.uint32))
        yield FACTS, shard, 0, blocks.pack(_levels(total))
        if len(total):
            words, *parts = _sums(su, total, total == 1, total == 2, total > 2)
            for k, own in blocks.by_shard(_word_shard(words, n), n, words, *parts):
                yield CONTEXTS, k, shard, blocks.pack(own[0], *(x.astype(np.uint32) for x in own[1:]))
            words, number = _sums(sv, np.ones(len(sv), np.int64))
            for k, own in blocks.by_shard(_word_shard(words, n), n, words, number):
                yield ENDINGS, k, shard, blocks.pack(own[0], own[1].astype(np.uint32))

    return lambda it: _batches(made(it))


def _count_words(keep: bool = False):
    """Counts of each word as token, context and continuation, back to the blocks that hold it; ``keep``: as part of a stored model instead."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        got: dict[int, list] = {CONTEXTS: [], ENDINGS: [], WORDS: []}
        asked, shard = [], 0
        for batch in it:
            for kind, shard, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                arrays = blocks.unpack(blob)
                got[kind].append(arrays)
                if kind == WORDS:
                    asked.append((block, arrays[0]))
        if not asked:
            return
        words, tokens = _sums(*(np.concatenate([x[k] for x in got[WORDS]]) for k in range(2)))
        table = np.zeros((6, len(words)), np.int64)  # token, continuation, context and its bigrams counted 1, 2, more
        table[0] = tokens
        for kind, rows in ((ENDINGS, slice(1, 2)), (CONTEXTS, slice(2, 6))):
            if got[kind]:
                own, *sums = _sums(*(np.concatenate([x[k] for x in got[kind]]) for k in range(len(got[kind][0]))))
                table[rows, np.searchsorted(words, own)] = sums
        for block, w in asked if not keep else ():
            yield WORDS, shard, block, blocks.pack(*table[:, np.searchsorted(words, w)].astype(np.uint64))
        if keep:
            yield WORD_MODEL, shard, 0, blocks.pack(words, *table.astype(np.uint64))
        yield FACTS, shard, 0, blocks.pack(_levels(table[0]), _levels(table[1]))

    return lambda it: _batches(made(it))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; those that these leave open are halves."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.01), k) for d, k in zip(raw, (1, 2, 3)))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)], 0)


def _mapped(array: np.ndarray) -> np.ndarray:
    """``array`` in an unlinked file, mapped into memory."""
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


class Slice:
    """The part of the model that a block needs: bigrams in hash order beside their log probabilities, and its words."""

    def __init__(self, block: Block, answers: list[tuple[int, list[np.ndarray]]], facts: dict):
        counts = np.empty(len(block.pairs), np.int64)
        counts[np.argsort(block.shard, kind="stable")] = np.concatenate([x[0] for kind, x in answers if kind == PAIRS])  # answers come by shard
        words = np.empty((6, len(block.words)), np.int64)
        words[:, np.argsort(_word_shard(block.words, block.n), kind="stable")] = np.concatenate([np.stack(x) for kind, x in answers if kind == WORDS], axis=1)
        token, ending, context, once, twice, more = words
        n, v = facts["tokens"], facts["types"]
        d, e = facts["pair_discounts"], facts["ending_discounts"]
        lower = np.full(len(token), 1 / (v + 1))
        if facts["endings"]:
            spare = e[0] * facts["ending_levels"][0] + e[1] * facts["ending_levels"][1] + e[2] * facts["ending_levels"][4]
            lower = (_discounted(ending, e) + spare / (v + 1)) / facts["endings"]
        gamma, base = (d[0] * once + d[1] * twice + d[2] * more)[block.u], context[block.u]
        p = np.where(base > 0, (_discounted(counts, d) + gamma * lower[block.v]) / np.maximum(base, 1), lower[block.v])
        self.pairs, self.log_p = _mapped(block.pairs), _mapped(np.log10(p))
        self.known, self.log_base = _mapped((token > 0).astype(np.int64)), _mapped(np.log10((token + 0.5) / (n + 0.5 * (v + 1))))

    def score(self, pairs: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Known tokens, base score and score of texts that begin at ``starts``."""
        found = self.log_p[np.searchsorted(self.pairs, pairs)]
        return tuple(np.add.reduceat(x, starts) for x in (self.known[tokens], self.log_base[tokens], found))


def _look_up():
    """What a stored model knows of the bigrams and words that blocks ask for; its rows come first in each shard, and their arrays are mapped."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        known: dict[int, list[np.ndarray]] = {}
        for batch in it:
            for kind, shard, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                arrays = blocks.unpack(blob)
                if kind in (PAIR_MODEL, WORD_MODEL):
                    known[kind] = [_mapped(x) for x in arrays] if len(arrays[0]) else []
                elif kind == PAIRS:
                    u, runs, v, _ = arrays
                    yield PAIRS, shard, block, blocks.pack(*_found(known.get(PAIR_MODEL), _pair_hash(np.repeat(u, runs), v), 1))
                else:
                    yield WORDS, shard, block, blocks.pack(*_found(known.get(WORD_MODEL), arrays[0], 6))

    return lambda it: _batches(made(it))


def _found(table: list[np.ndarray] | None, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """The columns beside each key in a table of sorted keys; zeros where there is none."""
    if not table:
        return [np.zeros(len(keys), np.uint64)] * columns
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    hit = table[0][at] == keys
    return [np.where(hit, x[at], 0).astype(np.uint64) for x in table[1:]]


def _asks(texts: DataFrame, n: int, m: int, counts: bool) -> DataFrame:
    """What ``m`` blocks of ``(doc_id, text, held_out)`` ask ``n`` shards."""

    def asks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(n), None
        for batch in it:
            for t, h in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                block.add(t, h)
            number = batch.column(3)[0].as_py() if len(batch) else number
        if number is not None:
            block.index(counts)
            yield from _batches(block.asks(number))

    return blocks.dealt(texts, m, blocks.block_of("doc_id", "text", m)).mapInArrow(asks, _ROWS)


def _by_shard(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, F.col("shard")).sortWithinPartitions("kind", "block")


def _texts(docs: DataFrame, held_out: Column, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))


def _count(own: DataFrame, n: int, keep: bool) -> tuple[DataFrame, DataFrame, dict]:
    """Bigram and word rows of a corpus, and the few numbers that hold for all."""
    pairs = cut(_by_shard(_asks(own, n, n, True), n).mapInArrow(_count_pairs(n, keep), _ROWS))
    words = cut(_by_shard(pairs.where(F.col("kind").isin(CONTEXTS, ENDINGS, WORDS)), n).mapInArrow(_count_words(keep), _ROWS))
    levels = np.sum([np.zeros(7, np.int64), *(blocks.unpack(r["blob"])[0] for r in pairs.where(F.col("kind") == FACTS).select("blob").collect())], axis=0)
    told = [blocks.unpack(r["blob"]) for r in words.where(F.col("kind") == FACTS).select("blob").collect()]
    tokens, endings = (np.sum([np.zeros(7, np.int64), *(x[k] for x in told)], axis=0) for k in range(2))
    facts = {"shards": n, "tokens": int(tokens[6]), "types": int(tokens[5]), "endings": int(endings[6]), "ending_levels": endings.tolist(), "pair_discounts": discounts(*levels[:4].tolist()), "ending_discounts": discounts(*endings[:4].tolist())}
    return pairs, words, facts


def fit(docs: DataFrame, held_out: Column, path: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Stores a model of the rows of ``docs`` that are not held out under ``path``: for each shard sorted hash arrays of its bigrams and words beside their counts."""
    own = _texts(docs, held_out, doc_id, text)
    pairs, words, facts = _count(own, blocks.number(own, "text"), True)
    written(pairs.where(F.col("kind") == PAIR_MODEL).unionByName(words.where(F.col("kind") == WORD_MODEL)), f"{path}/shards")
    written(docs.sparkSession.createDataFrame([(json.dumps(facts),)], "facts string"), f"{path}/facts")


def score(docs: DataFrame, path: str, held_out: Column | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What :func:`score_all` gives, for any texts by the model stored under ``path``: workers map a shard's arrays and answer the blocks that ask for them."""
    own = _texts(docs, F.lit(True) if held_out is None else held_out, doc_id, text)
    stored, facts = own.sparkSession.read.parquet(f"{path}/shards"), json.loads(own.sparkSession.read.parquet(f"{path}/facts").first()["facts"])
    n, m = facts["shards"], blocks.number(own, "text")
    asked = _asks(own, n, m, False).unionByName(stored)
    answers = cut(asked.repartitionById(n, F.col("shard")).sortWithinPartitions(F.desc("kind"), "block").mapInArrow(_look_up(), _ROWS))
    return _score(own, answers, facts, m)


def score_all(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, with a model of the rows not held out.

    As the texts to score are those that are counted, blocks ask once: shards answer with totals as soon as they have them.
    """
    own = _texts(docs, held_out, doc_id, text)
    n = blocks.number(own, "text")
    pairs, words, facts = _count(own, n, False)
    return _score(own, pairs.where(F.col("kind") == PAIRS).unionByName(words.where(F.col("kind") == WORDS)), facts, n)


def _score(own: DataFrame, answers: DataFrame, facts: dict, m: int) -> DataFrame:
    """Scores of texts in ``m`` blocks, from the answers of the shards."""
    n = facts["shards"]
    asked = answers.select(F.col("block").alias("__block"), "kind", "shard", "blob")
    both = asked.unionByName(own.withColumn("__block", blocks.block_of("doc_id", "text", m)), allowMissingColumns=True)
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answered, ids = Block(n), [], []
        for batch in it:
            got = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            blobs = len(batch) - got["blob"].null_count
            answered += [(k, blocks.unpack(x)) for k, x in zip(got["kind"].slice(0, blobs).to_pylist(), got["blob"].slice(0, blobs).to_pylist())]
            for d, t, h in zip(got["doc_id"].slice(blobs), as_bytes(got["text"].slice(blobs)), got["held_out"].slice(blobs).to_pylist()):
                block.add(t, h)
                ids.append(d)
        if not ids:
            return
        block.index(counts=False)
        part, edges = Slice(block, answered, facts), np.concatenate(([0], np.cumsum(block.sizes)))
        block.pairs = block.u = block.v = block.shard = answered = None
        for at in range(0, len(ids), 1024):
            to = min(at + 1024, len(ids))
            span = slice(edges[at], edges[to])
            known, base, score = part.score(block.token_pairs[span], block.tokens[span], edges[at:to] - edges[at])
            columns = [pa.array([x.as_py() for x in ids[at:to]], ids[0].type), pa.array(block.held[at:to], pa.bool_()), pa.array(block.sizes[at:to]), pa.array(known), pa.array(np.full(to - at, facts["tokens"], np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.repartitionById(m, F.col("__block")).sortWithinPartitions(F.asc_nulls_last("kind"), "shard").mapInArrow(scores, schema)


def op7_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Base score and model score of each document; a fifth is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_all(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
