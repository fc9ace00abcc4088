"""A quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or nothing on each text, for two faults: junk and abuse. For each
fault, expectation-maximisation over the vote patterns estimates how often each labeller is right, without taking any for
true (annotators are one more labeller, heard where they said something); the posterior of a text being bad on either count then labels it for a hashed linear scorer (logistic regression on
hashed words, hashed form features and the votes themselves), which scores every text and also learns words that no labeller lists.

Fitting takes a bounded sample of documents that annotators named, filled up with others, chosen by hash; every row is scored. The sample stays in Spark: the driver
gets how often each vote pattern occurs, the features that tell bad texts from good ones (each with two counts), and of the sample's texts the distinct
sets of these features. Sums are of integers, so a fit does not depend on the order in which tasks end. The scorer is an array of ``2 ** bits`` weights, a fixed size for any input.

Nulls and empties: a null text is an empty one, which has no fault that a labeller could see. Repeated rows get equal scores; in the sample, rows of one text are one. Very long texts are
read whole; a text counts each of its features once. Of several annotations of a document the worst counts. Features that tie at the bound are taken by number. No rows give no rows; no
labels, or none of a document that is there, leave the labellers alone. Other columns are carried along; :func:`score` replaces a column of the name that it adds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.durable import cut
from ballast.llm.rules import Text
from ballast.llm.text import alnum_words, as_bytes

SAMPLE_ROWS = 20_000
BITS = 20
#: A feature has a weight if that many texts of the sample have it, and if its share of bad texts
#: is that many standard errors away from the sample's, and that many times as large or as small.
LEAST_TEXTS, LEAST_Z, LEAST_LIFT = 4, 5.0, 1.5
#: Bytes of feature sets that the regression is solved on, at most: of more, an even share by hash is taken.
SAMPLE_BYTES = 64_000_000
#: Texts without an annotation count fully up to so many annotated ones, and the less the more there are.
FEW = 200
BAD, GOOD, NOTHING = 1, 0, 2

MILD = frozenset(b"stupid dumb clown loser fool lame pathetic worthless useless trash garbage ridiculous".split())
ENGLISH = frozenset(b"the of and to a in is that for with".split())
HARSH = frozenset(b"idiot moron imbecile scum vermin disgusting filthy creep bastard retard jerk freak".split())


class Form:
    """What a text looks like, apart from its words."""

    def __init__(self, raw: bytes | None):
        t = Text(raw)
        n = max(1, len(t.words))
        self.symbols = t.n_symbols / n
        self.upper = t.n_upper / max(1, t.n_upper + t.n_lower)
        self.shouts = t.text.count(b"!") / n
        self.bare = sum(not w.translate(None, _MARKS) for w in t.words) / n
        self.again = sum(a == b for a, b in zip(t.words, t.words[1:])) / n
        self.n = n


_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def votes(form: Form, ws: list[bytes], quality: int | None, toxic: int | None) -> tuple[int, ...]:
    """Votes on junk, then on abuse. In each, the first vote is an annotator's, where there is one."""
    distinct = set(ws)
    knows = GOOD if 10 * sum(w in ENGLISH for w in ws) > len(ws) else NOTHING  # the lists are English: elsewhere, finding nothing says nothing
    split = lambda x, good, bad: BAD if x > bad else GOOD if x <= good else NOTHING
    return (
        NOTHING if quality is None else GOOD if quality else BAD,
        split(form.symbols, 0.05, 0.2),
        split(form.upper, 0.15, 0.4),
        split(form.shouts, 0.05, 0.2),
        split(form.bare, 0.05, 0.2),
        split(form.again, 0.05, 0.3),
        split(form.symbols + form.shouts + form.again, 0.1, 0.4),
        NOTHING if toxic is None else BAD if toxic else GOOD,
        knows if distinct.isdisjoint(MILD) else BAD,
        knows if distinct.isdisjoint(HARSH) else BAD,
    )


FAULTS = {"junk": slice(0, 7), "abuse": slice(7, 10)}


def features(form: Form, ws: list[bytes], bits: int) -> np.ndarray:
    """Distinct hashed features of a text, in order: words, how words begin, form, and the labellers' votes without annotators'."""
    said = [b"\x00vote %d %d" % (k, v) for k, v in enumerate(votes(form, ws, None, None)) if v == BAD]
    mask, crc, distinct = (1 << bits) - 1, zlib.crc32, set(ws)
    measures = ((b"symbols", form.symbols), (b"upper", form.upper), (b"shouts", form.shouts), (b"bare", form.bare), (b"again", form.again))
    shape = [b"\x00%s %d" % (name, k) for name, x in measures for k in range(1, min(9, int(10 * x)) + 1)]  # each level reached
    begins = {w[:4] for w in distinct} | {w[:5] for w in distinct}
    return np.unique(np.fromiter((x & mask for x in (*map(crc, distinct), *(crc(w, 1) for w in begins), *map(crc, shape), *map(crc, said))), np.int32))


def fit_labellers(patterns: dict[tuple[int, ...], int], prior: float = 0.1, rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The posterior of bad for each vote pattern.

    The model: a text is bad with some probability, and given that, each labeller votes on its own, by its own
    rates of bad and of good; silence is no evidence, and where all are silent the prior stays. Starts from the share of bad votes.
    """
    out = dict.fromkeys(patterns, prior)
    keys = [k for k in patterns if any(v != NOTHING for v in k)]
    if not keys:
        return out
    x, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    bad, good = (x == BAD).sum(axis=1), (x == GOOD).sum(axis=1)
    p = (bad + prior) / (bad + good + 1)
    for _ in range(rounds):
        share = np.clip((n * p).sum() / n.sum(), 1e-3, 0.5)
        score = np.full(len(keys), math.log(share / (1 - share)))
        for k in range(x.shape[1]):
            for v in (BAD, GOOD):
                seen = x[:, k] == v
                score += seen * (np.log((n * p)[seen].sum() + 0.1) - np.log((n * p).sum() + 0.3) - np.log((n * (1 - p))[seen].sum() + 0.1) + np.log((n * (1 - p)).sum() + 0.3))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done, p = float(np.abs(new - p).max()) < 1e-6, new
        if done:
            break
    return out | dict(zip(keys, p.tolist()))


def fit_scorer(rows: list[tuple[np.ndarray, float, float]], used: np.ndarray, bits: int, rounds: int = 300, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary features, by full-batch adaptive gradient steps.

    rows: sets of features as indices into ``used``, each with how many texts have it and the sum of their targets. Other features than those used get no weight, so long texts do not drift.
    """
    weights, bias = np.zeros(1 << bits, np.float32), -1.0
    if not rows:
        return weights, bias
    n, bad = (np.array([r[k] for r in rows]) for k in (1, 2))
    share = float(np.clip(bad.sum() / n.sum(), 1e-3, 0.999))
    at, col = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows])
    w, grown, grown_bias, bias = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8, math.log(share / (1 - share))
    for _ in range(rounds):
        error = n / (1 + np.exp(-np.clip(bias + np.bincount(at, w[col], len(rows)), -30, 30))) - bad
        slope = np.bincount(col, error[at], len(used)) + ridge * w
        grown += slope**2
        w -= 0.5 * slope / np.sqrt(grown)
        grown_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(grown_bias)
    weights[used] = w
    return weights, float(bias)


def _sample(own: DataFrame, labels: DataFrame | None, sample_rows: int) -> DataFrame:
    """``(text, quality, toxic)`` of about ``sample_rows`` annotated documents and half as many of all."""
    chosen = lambda rows, most, *key: rows.where(F.pmod(F.xxhash64(*key), F.lit(2**31)) < int(min(1.0, most / max(1, rows.count())) * 2**31))
    if labels is None:
        return chosen(own, sample_rows, "doc_id", "text").select("text", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    said = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    named = own.join(F.broadcast(chosen(said, sample_rows, "doc_id").limit(2 * sample_rows)), "doc_id")
    return named.unionByName(chosen(own, sample_rows // 2, "doc_id", "text").join(said, "doc_id", "left")).select("text", "quality", "toxic")


def _voter(bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vs, fs = [], []
            for raw, quality, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                form, ws = Form(raw), alnum_words(raw)
                vs.append(bytes(votes(form, ws, quality, toxic)))
                fs.append(features(form, ws, bits))
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.binary()), pa.array(fs, pa.list_(pa.int32()))], names=["votes", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, few: int = FEW, bits: int = BITS) -> tuple[np.ndarray, float]:
    """The scorer for ``docs``, from the weak labels of a sample of them.

    labels: ``(doc_id, quality, toxic)`` of some documents, one more labeller of each fault. The more texts they speak of (their sampled ids are broadcast, at most twice ``sample_rows``),
    beyond ``few``, the less count others, whatever the labellers say of them: silence is no sign of a clean text in a language that the lists do not cover.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = _sample(own, labels, sample_rows).groupBy("text").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    seen = cut(sample.mapInArrow(_voter(bits), "votes binary, features array<int>"))

    patterns = {bytes(r["votes"]): r["count"] for r in seen.groupBy("votes").count().collect()}
    good = dict.fromkeys(patterns, 1.0)
    for part in FAULTS.values():
        counted: dict[tuple[int, ...], int] = {}
        for v in sorted(patterns):
            counted[tuple(v[part])] = counted.get(tuple(v[part]), 0) + patterns[v]
        posterior = fit_labellers(counted)
        for v in patterns:
            good[v] *= 1 - posterior[tuple(v[part])]
    annotated = sum(n for v, n in patterns.items() if v[FAULTS["abuse"].start] != NOTHING)
    weight = {v: 1.0 if v[FAULTS["abuse"].start] != NOTHING else min(1.0, few / max(1, annotated)) for v in patterns}
    #: by pattern: a text's weight and its weighted target, in millionths
    told = [(v, round(weight[v] * 1e6), round(weight[v] * (1 - good[v]) * 1e6)) for v in sorted(patterns)]
    rows = seen.join(F.broadcast(spark.createDataFrame(told, "votes binary, w long, b long")), "votes").where("w > 0")

    total = rows.agg(F.sum("w"), F.sum("b")).first()
    share = float(np.clip((total[1] or 0) / max(1, total[0] or 0), 1e-3, 0.999))
    counts = rows.select(F.explode("features").alias("f"), "w", "b").groupBy("f").agg((F.sum("w") / 1e6).alias("n"), (F.sum("b") / 1e6).alias("bad"))
    z = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    telling = counts.withColumn("z", z).where((F.col("n") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z) & ~(F.col("bad") / F.col("n")).between(share / LEAST_LIFT, share * LEAST_LIFT))
    used = np.sort(telling.select("f").toArrow()["f"].to_numpy())

    known = spark.sparkContext.broadcast(used)
    sets = cut(rows.select("features", "w", "b").mapInArrow(_reducer(known), "own binary, w long, b long").groupBy("own").agg(F.sum("w").alias("w"), F.sum("b").alias("b")))
    held = sets.agg(F.sum(F.octet_length("own") + 16)).first()[0] or 0
    sets = sets.where(F.pmod(F.xxhash64("own"), F.lit(2**31)) < int(min(1.0, sample_bytes / max(1, held)) * 2**31)).toArrow()
    made = sorted(zip(sets["own"].to_pylist(), sets["w"].to_pylist(), sets["b"].to_pylist()))
    return fit_scorer([(np.frombuffer(x, np.int32), w / 1e6, b / 1e6) for x, w, b in made], used, bits)


def _reducer(known):
    """Of each text's features, where the used ones are among those."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = known.value
        for batch in it:
            own = []
            for f in batch.column(0):
                x = f.values.to_numpy()
                at = np.minimum(np.searchsorted(used, x), max(0, len(used) - 1))
                own.append(at[used[at] == x].astype(np.int32).tobytes() if len(used) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *batch.columns[1:]], names=["own", "w", "b"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", column: str = "badness") -> DataFrame:
    """``docs`` with the log-odds of being bad in a new column, which replaces any of its name."""
    docs = docs.drop(column)
    weights, bias = model
    known, bits, at = docs.sparkSession.sparkContext.broadcast(weights), int(len(weights)).bit_length() - 1, docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known.value
        for batch in it:
            made = []
            for raw in as_bytes(batch.column(at)):
                made.append(bias + float(w[features(Form(raw), alnum_words(raw), bits)].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, *, text: str = "text", threshold: float = 0.0, **how) -> DataFrame:
    """``docs`` without those that the classifier scores above the threshold; columns stay."""
    column = "__badness"
    return score(docs, fit(docs, labels, text=text, **how), text=text, column=column).where(F.col(column) <= threshold).drop(column)


def op9_classifier(spark, sf_dir: str) -> DataFrame:
    """Each document's score and whether it is rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", F.col("badness").alias("score"), (F.col("badness") > 0).alias("rejected"))
