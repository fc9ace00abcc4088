"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest

from ballast.llm import whiten as W

SCHEMA = "vec_id long, embedding array<float>, deviation string"  # a clashing column


def brute(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    far = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    c = (x - s // n) - (s % n) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, far, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(spark, vectors, rows, k=8, **how):
    got = W.whiten(spark.createDataFrame(rows, SCHEMA), components=k, **how).collect()
    usable = [r for r in rows if any(r[1] is v for v in vectors)]
    n, far, white, explained = brute(vectors, k)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == n * k
    assert all(r.n == n and r.identity_error < 1e-8 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in got)
    for c in range(k):
        mine = np.array([by[row[0], c + 1][0].whitened for row in usable])
        want = white[:, c]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
    for row, f in zip(usable, far):
        assert {r.deviation for r in by[row[0], 1]} <= {f for x, f in zip(usable, far) if x[0] == row[0]}


def test_against_eigenvectors_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    vectors = [[float(np.float32(x)) for x in row] for row in draw.normal(size=(300, 12)) * np.linspace(1, 4, 12)]
    vectors += [vectors[0]] * 150  # a third are copies
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    odd = [(1000, None, ""), (1001, [], ""), (1002, [1.0] * 11 + [None], ""), (1003, [1.0] * 11 + [float("nan")], ""), (1004, [float("-inf")] * 12, ""), (1005, [1.0] * 5, "")]
    compare(spark, vectors, rows + odd)
    compare(spark, vectors, rows + odd, early=True)


def test_multiple_eigenvalues_and_subspaces(spark):
    eye = [[float(x) for x in row] for row in np.vstack([np.eye(6), -np.eye(6)])]
    got = W.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(eye)], SCHEMA)).collect()
    assert {r.component for r in got} == set(range(1, 7)) and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - 1 / 6) < 1e-12 for r in got)
    draw = np.random.default_rng(4)
    flat = [[float(a), float(b), float(a + b), 7.0, 0.0] for a, b in draw.integers(-50, 50, (80, 2))]
    got = W.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(flat)], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 160 and max(r.identity_error for r in got) < 1e-9


def test_tables_without_deviation_and_long_numbers(spark):
    for rows in ([], [(1, [1.0, 2.0], "")], [(i, [3.0, 4.0], "") for i in range(9)], [(1, None, "")]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    rows = [(None, [1e9, 0.0], ""), (None, [-1e9, 1.0], ""), (5, [1e9, 3.0], "")]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.deviation is None and r.distance > 0 for r in got)
    with pytest.raises(Exception, match="52 bits"):
        W.whiten(spark.createDataFrame([(1, [1e30], ""), (2, [0.0], "")], SCHEMA)).collect()


def test_whole_table(spark):
    got = W.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    _, far, white, explained = brute([r.embedding for r in table], 8)
    at = {r.vec_id: i for i, r in enumerate(table)}
    assert len(got) == 8 * len(table) and max(r.identity_error for r in got) < 1e-10
    assert all(r.deviation == far[at[r.vec_id]] and abs(abs(r.whitened) - abs(white[at[r.vec_id], r.component - 1])) < 1e-8 for r in got)
