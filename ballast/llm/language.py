"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Two recurrences read a window of bytes, one from each end; at every byte both states together give probabilities of the
languages, and a document's probabilities are the means over all of its bytes. A text is read whole, in segments of ``SPAN``
labelled bytes. Each recurrence starts ``MARGIN`` bytes outside the segment, so what a byte is labelled depends on the text alone, not on
what else is in the batch, and a very long text is as many independent rows of a batch as it has segments.

Training is done in Spark: a bounded sample, even over languages (``per_language`` distinct texts of each on average, ``windows`` stretches
of ``LENGTH`` bytes of each), is dealt to ``shards`` tasks. In each round every task makes some steps of Adam from the same weights over its
share, and the driver averages the weights, about 80 kB. The sample is drawn by the hash of the text, so copies of a text count
once, and a task that is lost is repeated alike. Which shard a text goes to, the order of its windows and the first weights follow
from hashes and a seed.

Nulls and empties: a null text, or one without any letter, is ``und`` with score zero. A null language teaches nothing. Very long texts are
read whole. Repeated rows are each predicted; a copy of a text under two languages teaches both. Without a text to learn from all
is ``und``. Other columns stay as they are; a clash with the two result columns is the caller's to name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.durable import cut
from ballast.llm.text import as_bytes

#: Width of each recurrence's state; bytes labelled in one segment; bytes read before them; bytes of a stretch that is learned from.
STATE, SPAN, MARGIN, LENGTH = 12, 256, 16, 96
UNKNOWN = "und"
_NAMES = ("input", "recurrent", "inner", "out")


def new(languages: int, seed: int = 5, state: int = STATE) -> dict[str, np.ndarray]:
    """First weights. ``input``: [2, 256, 3 x state], what each byte adds to the gates; ``recurrent``: [2, state, 3 x state];
    ``inner``: [2, state], added to the recurrent part of the candidate; ``out``: [2, state + 1, languages], the last row the bias."""
    draw = np.random.default_rng(seed)
    made = {
        "input": draw.normal(0, 0.3, (2, 256, 3 * state)),
        "recurrent": draw.normal(0, state**-0.5, (2, state, 3 * state)),
        "inner": np.zeros((2, state)),
        "out": draw.normal(0, state**-0.5, (2, state + 1, languages)),
    }
    made["out"][:, state] = 0
    return {k: v.astype(np.float32) for k, v in made.items()}


def _gate(x: np.ndarray) -> None:
    """The logistic function of twice ``x``, in place."""
    np.tanh(x, out=x)
    x += 1
    x *= 0.5


def forward(w: dict[str, np.ndarray], side: int, at: np.ndarray, real: np.ndarray | None, keep: int, trace: list | None = None) -> np.ndarray:
    """What one recurrence adds to the languages' logits after each of the last ``keep`` steps, as [step, language, row].

    ``at`` holds bytes by [step, row]; ``real`` marks those inside a text (None: all). A state is zero outside of its text.
    ``trace`` gets what :func:`backward` needs.
    """
    n = w["recurrent"].shape[1]
    table, product = w["input"][side].T.copy(), np.vstack([w["recurrent"][side].T, w["out"][side, :n].T])  # one product gives the gates and the logits
    table[: 2 * n] *= 0.5
    product[: 2 * n] *= 0.5
    inner = w["inner"][side][:, None]
    steps, rows = at.shape
    logits = np.empty((keep, len(product) - 3 * n, rows), np.float32)
    h, x, said = np.zeros((n, rows), np.float32), np.empty((3 * n, rows), np.float32), np.zeros((len(product), rows), np.float32)
    for k in range(steps):
        if trace is not None:
            x, before = np.empty_like(x), h.copy()
        np.take(table, at[k], axis=1, out=x, mode="clip")
        gates, c, held = x[: 2 * n], x[2 * n :], said[2 * n : 3 * n]
        gates += said[: 2 * n]
        _gate(gates)
        z, r = gates[:n], gates[n:]
        held += inner
        c += r * held
        np.tanh(c, out=c)
        h -= c
        h *= z
        h += c
        on = real[k] if real is not None else None
        if on is not None and not on.all():
            h *= on
        if trace is not None:
            trace.append((before, h.copy(), z, r, held.copy(), c, on))
        np.matmul(product, h, out=said)
        if k >= steps - keep:
            logits[k - steps + keep] = said[3 * n :]
    return logits


def backward(w: dict[str, np.ndarray], side: int, at: np.ndarray, trace: list, slope: np.ndarray, into: dict[str, np.ndarray]) -> None:
    """Adds the gradients through one recurrence to ``into``; ``slope``: the loss by the logits of each step."""
    n, u, out = w["recurrent"].shape[1], w["recurrent"][side], w["out"][side]
    dh, by_input = np.zeros_like(trace[0][0]), np.empty((3 * n, *at.shape), np.float32)
    for k in range(len(trace) - 1, -1, -1):
        before, h, z, r, held, c, on = trace[k]
        into["out"][side, :n] += h @ slope[k].T
        into["out"][side, n] += slope[k].sum(1)
        dh = dh + out[:n] @ slope[k]
        if on is not None:
            dh = dh * on
        dz = dh * (before - c) * z * (1 - z)
        dc = dh * (1 - z) * (1 - c * c)
        dr = dc * held * r * (1 - r)
        through = np.vstack([dz, dr, dc * r])  # by the recurrent product
        into["recurrent"][side] += before @ through.T
        into["inner"][side] += through[2 * n :].sum(1)
        by_input[:, k] = np.vstack([dz, dr, dc])
        dh = dh * z + u @ through
    bytes_, flat = at.ravel(), by_input.reshape(3 * n, -1)
    for i in range(3 * n):
        into["input"][side, :, i] += np.bincount(bytes_, flat[i], 256)


def loss_and_gradients(w: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all real bytes of a batch [step, row] with one language each, and its gradients."""
    n, keep = w["recurrent"].shape[1], len(at)
    traces: tuple[list, list] = ([], [])
    p = forward(w, 0, at, real, keep, traces[0]) + forward(w, 1, at[::-1], real[::-1], keep, traces[1])[::-1]
    _softmax(p, w["out"][0, n] + w["out"][1, n])
    count, rows = max(1, int(real.sum())), np.arange(len(truth))
    loss = -float((np.log(p[:, truth, rows] + 1e-30) * real).sum()) / count
    p[:, truth, rows] -= 1
    p *= (real / np.float32(count))[:, None]
    into = {k: np.zeros_like(v) for k, v in w.items()}
    backward(w, 0, at, traces[0], p, into)
    backward(w, 1, at[::-1], traces[1], p[::-1], into)
    return loss, into


def _softmax(logits: np.ndarray, bias: np.ndarray) -> None:
    """Probabilities along axis 1, in place."""
    logits += bias[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)


def train(w: dict[str, np.ndarray], windows: list[bytes], truth: np.ndarray, seed: int, rate: float, steps: int = 60, batch: int = 64) -> dict[str, np.ndarray]:
    """``w`` after some steps of Adam over the windows, as often through them as that takes, in orders that the seed gives."""
    w, draw, order = {k: v.copy() for k, v in w.items()}, np.random.default_rng(seed), np.empty(0, np.int64)
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, draw.permutation(len(windows))])
        ids, order = order[:batch], order[batch:]
        at, real = _padded([windows[i] for i in ids])
        _, g = loss_and_gradients(w, at, real, truth[ids])
        for k in _NAMES:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] * g[k] - s[k])
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    return w


def _padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by [step, row], and where there are any."""
    length = max(map(len, windows))
    at = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in windows), np.uint8).reshape(-1, length)
    real = np.arange(length) < np.fromiter(map(len, windows), int, len(windows))[:, None]
    return at.T.astype(np.intp), np.ascontiguousarray(real.T)


def probabilities(w: dict[str, np.ndarray], texts: list[bytes], rows: int = 2048) -> np.ndarray:
    """The languages' mean probabilities over all bytes of each text, which must not be empty."""
    n, width = w["recurrent"].shape[1], SPAN + 2 * MARGIN
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    segments = -(-sizes // SPAN)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(texts)), segments)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)) * SPAN - MARGIN  # in its text
    whole = np.frombuffer(b"".join(texts), np.uint8)
    total = np.zeros((len(texts), w["out"].shape[2]))
    for a in range(0, len(owner), rows):
        own = owner[a : a + rows]
        place = first[a : a + rows] + np.arange(width)[:, None]
        real = (place >= 0) & (place < sizes[own])
        at = whole[np.where(real, place + starts[own], 0)].astype(np.intp)
        p = forward(w, 0, at[: SPAN + MARGIN], real[: SPAN + MARGIN], SPAN)
        p += forward(w, 1, at[: MARGIN - 1 : -1], real[: MARGIN - 1 : -1], SPAN)[::-1]
        _softmax(p, w["out"][0, n] + w["out"][1, n])
        p *= real[MARGIN:-MARGIN, None]
        np.add.at(total, own, p.sum(0, dtype=np.float64).T)
    return total / sizes[:, None]


_SAMPLE = pa.schema([("language", pa.int32()), ("window", pa.binary())])


def _stretches(windows: int):
    """Takes ``windows`` stretches of each text, one from each equal part of it, at a place that the text's hash gives."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made: list[tuple[int, bytes]] = []
            for language, text, h in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                part = len(text) / windows
                at = [int(k * part + max(0, part - LENGTH) * ((h >> 8 * k) % 256) / 256) for k in range(windows)] if len(text) > LENGTH else [0]
                made += [(language, text[x : x + LENGTH]) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _SAMPLE)] if made else [pa.array([], f.type) for f in _SAMPLE], schema=_SAMPLE)

    return run


def _letters(text: str) -> Column:
    return F.col(text).rlike(r"\p{L}")


def fit(
    docs: DataFrame, *, text: str = "text", language: str = "lang", per_language: int = 1500, windows: int = 2, shards: int = 4, rounds: int = 4, steps: int = 60, rate: float = 0.02, seed: int = 5
) -> tuple[list[str], dict[str, np.ndarray]]:
    """The languages in order, and weights learned from a sample of ``docs`` of at most about ``per_language`` texts of each language."""
    taught = docs.select(F.col(language).alias("__language"), F.col(text).alias("__text")).where(F.col("__language").isNotNull() & _letters("__text"))
    counts = {r[0]: r[1] for r in taught.groupBy("__language").count().collect()}  # one row for each language
    names = sorted(counts)
    if not names:
        return [], {}
    # a literal rather than a join, so texts are not shuffled before they are drawn
    known = F.create_map(*(F.lit(v) for k, x in enumerate(names) for v in (x, k)))
    shares = F.array(*(F.lit(min(1.0, per_language / counts[x])) for x in names))
    numbered = taught.withColumn("__k", F.element_at(known, F.col("__language"))).withColumn("__h", F.xxhash64("__text"))
    drawn = numbered.where(F.pmod(F.xxhash64("__h"), F.lit(1 << 30)) < F.element_at(shares, F.col("__k") + 1) * (1 << 30))
    once = drawn.groupBy("__k", "__h").agg(F.first("__text").alias("__text"))
    sample = cut(once.select("__k", "__text", "__h").mapInArrow(_stretches(windows), "language int, window binary").withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(shards)).cast("int")))
    w = new(len(names), seed)
    for turn in range(rounds):
        w = _round(sample, w, shards, seed + turn, rate * 0.6**turn, steps)
    return names, w


def _round(sample: DataFrame, w: dict[str, np.ndarray], shards: int, seed: int, rate: float, steps: int) -> dict[str, np.ndarray]:
    """The mean of the weights that the shards reach from ``w``, by their numbers of windows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        windows = [x for b in batches for x in b.column(1).to_pylist()]
        if windows:
            truth = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
            got = train(w, windows, truth, seed, rate, steps)
            flat = np.concatenate([got[k].ravel() for k in _NAMES]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(windows)], pa.int64()), "flat": pa.array([flat], pa.binary())})

    made = sample.repartitionById(shards, F.col("shard")).sortWithinPartitions("window", "language").select("language", "window").mapInArrow(run, "n long, flat binary").collect()
    total = sum(r.n for r in made)
    mean = sum(np.frombuffer(r.flat, "<f4").astype(np.float64) * (r.n / total) for r in sorted(made, key=lambda r: r.flat))
    out, a = {}, 0
    for k in _NAMES:
        out[k] = mean[a : a + w[k].size].reshape(w[k].shape).astype(np.float32)
        a += w[k].size
    return out


def predict(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], *, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with each text's most probable language and that language's pooled probability."""
    names, w = model
    fields = [*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    if not names:
        return docs.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0)})
    at = docs.columns.index(text)

    def labelled(column: pa.Array, known: list[bool]) -> tuple[list[str], list[float]]:
        said, p, held, size = [UNKNOWN] * len(known), [0.0] * len(known), [], 0
        texts = as_bytes(column)
        for i, k in [*((i, k) for i, k in enumerate(known)), (-1, True)]:
            if i >= 0 and k:
                held.append(i)
                size += len(texts[i])
            if held and (i < 0 or size > 1_000_000):
                got = probabilities(w, [texts[j] for j in held])
                for j, best, row in zip(held, got.argmax(1).tolist(), got):
                    said[j], p[j] = names[best], float(min(1.0, row[best]))
                held, size = [], 0
        return said, p

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            said, p = labelled(batch.column(at), [bool(x) for x in batch.column(len(batch.columns) - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string()), pa.array(p, pa.float64())], names=[f.name for f in fields])

    return docs.withColumn("__letters", _letters(text)).mapInArrow(run, T.StructType(fields))


def op13_language(spark, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of the documents."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held)
    model = fit(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
