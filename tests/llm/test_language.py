"""The network against plain loops and finite differences, and the query on texts it has not seen."""

import math
import zlib

import numpy as np

from ballast.llm import language as L
from tests.llm.fixtures import SCHEMA, documents

SF = "/root/testdata/sf0.01"


def plain(w, text):
    """Mean probabilities of a text no longer than a segment, byte by byte."""
    n = w["recurrent"].shape[1]

    def states(side, data):
        h, out = np.zeros(n), []
        for b in data:
            x, u = w["input"][side][b].astype(float), h @ w["recurrent"][side]
            z, r = 1 / (1 + np.exp(-(x[:n] + u[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + u[n : 2 * n])))
            c = np.tanh(x[2 * n :] + r * (u[2 * n :] + w["inner"][side]))
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    left, right = states(0, text), states(1, text[::-1])[::-1]
    total = 0
    for a, b in zip(left, right):
        e = np.exp(np.append(a, 1) @ w["out"][0] + np.append(b, 1) @ w["out"][1])
        total = total + e / e.sum()
    return total / len(text)


def weights(languages=3, state=5):
    w, draw = L.new(languages, state=state), np.random.default_rng(1)
    return {k: v + draw.normal(0, 0.3, v.shape).astype(np.float32) for k, v in w.items()}


def test_probabilities_against_plain_loops():
    w, draw = weights(), np.random.default_rng(2)
    texts = [bytes(draw.integers(32, 250, n).tolist()) for n in (1, 2, 40, 255, 256)]
    for text, p in zip(texts, L.probabilities(w, texts)):
        assert np.abs(plain(w, text) - p).max() < 1e-5


def test_long_texts_are_the_same_in_any_batch():
    w, draw = weights(), np.random.default_rng(3)
    texts = [bytes(draw.integers(0, 256, n).tolist()) for n in (5000, 3, 257, 70000, 256, 1)]
    together = L.probabilities(w, texts, rows=50)
    for text, p in zip(texts, together):
        assert np.abs(L.probabilities(w, [text])[0] - p).max() < 1e-6
    text = texts[0]  # segments and margins, put together by hand
    total = 0
    for a in range(0, len(text), L.SPAN):
        low, high = max(0, a - L.MARGIN), min(len(text), a + L.SPAN + L.MARGIN)
        at = np.frombuffer(text[low:high], np.uint8).astype(np.intp)[:, None]
        z = L.forward(w, 0, at, None, len(at))[:, :, 0] + L.forward(w, 1, at[::-1], None, len(at))[::-1, :, 0] + w["out"][:, -1].sum(0)
        e = np.exp(z[a - low : min(a + L.SPAN, len(text)) - low])
        # both recurrences start at the margins' ends
        total = total + (e / e.sum(1, keepdims=True)).sum(0)
    assert np.abs(total / len(text) - together[0]).max() < 5e-3


def test_gradients_against_differences():
    w, draw = {k: v.astype(np.float64).astype(np.float32) for k, v in weights(3, 4).items()}, np.random.default_rng(5)
    at, real = L._padded([bytes(draw.integers(60, 66, n).tolist()) for n in (9, 5, 1, 9)])
    truth = np.array([0, 1, 2, 1])
    _, g = L.loss_and_gradients(w, at, real, truth)
    for name in g:
        where = np.argsort(-np.abs(g[name]).ravel())[:6]
        for i in where:
            moved = []
            for step in (0.01, -0.01):
                v = {k: x.copy() for k, x in w.items()}
                v[name].ravel()[i] += step
                moved.append(L.loss_and_gradients(v, at, real, truth)[0])
            assert math.isclose((moved[0] - moved[1]) / 0.02, g[name].ravel()[i], rel_tol=0.05, abs_tol=2e-4), (name, i)


def test_held_out_documents(spark):
    rows = {r.doc_id: r for r in L.op13_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    known = [d for d in docs if d.lang is not None and d.text and any(c.isalpha() for c in d.text)]
    for held in (True, False):
        mine = [d for d in known if rows[d.doc_id].held_out == held]
        assert sum(rows[d.doc_id].lang_pred == d.lang for d in mine) >= 0.985 * len(mine)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows_and_columns(spark):
    words = {"aa": "kalo mira tune", "bb": "strüx pfloch ßen", None: "kalo strüx"}
    rows = [(i, " ".join([words[k]] * (1 + i % 7)), k, "s", 1) for i, k in enumerate(["aa", "bb", None] * 60)]
    taught = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS __language", "2 AS shard")
    model = L.fit(taught, per_language=40)
    assert model[0] == ["aa", "bb"]
    asked = spark.createDataFrame(documents() + rows, SCHEMA).selectExpr("*", "3 AS __letters0", "'z' AS window")
    got = L.predict(asked, model).collect()
    assert len(got) == len(documents()) + len(rows)
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) == (not r.text or not any(c.isalpha() for c in r.text))
    assert all(r.lang_pred == r.lang for r in got[len(documents()) :] if r.lang)
    assert got[-3].lang_pred == L.predict(spark.createDataFrame(rows[-3:], SCHEMA), model).collect()[0].lang_pred
    nothing = L.fit(taught.where("false"))
    assert {(r.lang_pred, r.score) for r in L.predict(asked, nothing).collect()} == {("und", 0.0)}
    assert L.predict(asked.where("false"), model).count() == 0
    assert L.fit(taught.where("lang = 'aa'"))[0] == ["aa"]
