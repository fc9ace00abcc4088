"""Whitening of embeddings by a Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

Rows become integers, so their sums, and each row's distance from the mean, are exact. They are packed into blocks of rows and centred
in integers before anything is multiplied. A step of the bidiagonalisation is one pass over the blocks, which does both products: each block takes
``u = Xv`` less what belongs to the step before, and gives ``Xᵀu``, ``uᵀu`` and ``Uᵀu`` for all left vectors so far. Left
vectors are as long as the table; they stay distributed, and are kept as the combinations ``U = XW`` that made them, so a block finds
its own part again with one product. Both sides are orthogonalised in full: right vectors on the driver, twice; left ones by subtracting what ``Uᵀu``
shows, from ``u`` by way of ``W`` and from ``Xᵀu`` by way of ``XᵀU``. Only arrays of the dimension, and matrices of its square, reach the driver or the tasks,
whatever the number of rows.

The singular values and right vectors of the small bidiagonal matrix give the components and their deviations. Steps go on until the whole space is
spanned, as a multiple eigenvalue hides from one starting vector; where a product vanishes (multiple eigenvalues, vectors in a subspace), the next right
vector is a new one orthogonal to all before. ``early`` ends them once the components asked for have converged to rounding, for spectra without multiples.

Nulls and empties: rows whose vector is null, empty, or holds null or non-finite entries, are dropped, and so are vectors that are not of the commonest length (of ties the greater).
An entry too large for a whole number of 52 bits fails with a message. Components without any deviation are not returned: a table of equal vectors, or of one, gives no rows.
A deviation beyond a long is null (``distance``, over the squared number of rows, is always given). Repeated rows count each; null ids stay. Other columns play no part. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import cut

_ROWS = 4096
_MOST = 1 << 52


def whole(vectors: DataFrame, vector: str, scale: float, shift: int) -> DataFrame:
    """``vectors`` with ``__x``: floor(scale * entry) + shift of each entry, as longs; rows without a usable vector go."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where(usable)
    lengths = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size(v) == (lengths.d if lengths else 0))
    inside = F.abs(F.lit(scale)) * F.array_max(F.transform(v, lambda c: F.abs(c.cast("double")))) < _MOST
    x = F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift))
    return kept.withColumn("__x", F.when(inside, x).otherwise(F.raise_error(F.lit("an entry is too large for a whole number of 52 bits"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, by rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows in as few bytes as hold them."""
    for batch in filter(len, it):
        x = _matrix(batch.column(0))
        for at in range(0, len(x), _ROWS):
            part = x[at : at + _ROWS]
            low, high = int(part.min()), int(part.max())
            small = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(part)], pa.int64()), "kind": pa.array([small]), "block": pa.array([part.astype(small).tobytes()], pa.binary())})


class Blocks:
    """Rows of whole numbers, dealt in blocks; passes over their centred values."""

    def __init__(self, rows: DataFrame):
        self.table = cut(rows.select("__x").mapInArrow(_packed, "n long, kind string, block binary"))
        sums = self._sums_of(lambda x: (np.array([len(x)]), x.sum(0)), np.int64, "long", raw=True)
        self.n = sums[0][0] if sums else 0
        self.sums = [int(s) for s in sums[1]] if sums else []
        self.d = len(self.sums)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Centres rows: ``x - S / n``, subtracting the whole part of the mean in integers first."""
        n, floor, rest = self.n, np.array([s // self.n for s in self.sums], np.int64), np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - floor) - rest

    def summed(self, fn: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """The sums over all blocks of the arrays that ``fn`` gives for a block's centred rows."""
        centre = self.centre()
        return self._sums_of(lambda x: fn(centre(x)), np.float64, "double")

    def _sums_of(self, fn, kind, sql: str, raw: bool = False) -> list[np.ndarray]:
        """Partitions add up their blocks; Spark adds up entry by entry, so the driver gets as many numbers as the arrays have."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for batch in it:
                for n, small, block in zip(*(c.to_pylist() for c in batch.columns)):
                    got = fn(np.frombuffer(block, small).reshape(n, -1).astype(np.int64))
                    total = [np.array(g, kind) for g in got] if total is None else [t + g for t, g in zip(total, got)]
            if total:
                flat = np.concatenate([t.ravel() for t in total])
                part = np.repeat(np.arange(len(total)), [t.size for t in total])
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "at": pa.array(np.concatenate([np.arange(t.size) for t in total]), pa.int32()), "value": pa.array(flat)})

        total = F.sum(F.col("value").cast("decimal(38,0)") if raw else "value")
        made = self.table.mapInArrow(run, f"part int, at int, value {sql}").groupBy("part", "at").agg(total.alias("value")).orderBy("part", "at").collect()
        parts = sorted({r.part for r in made})
        if raw:
            return [[int(r.value) for r in made if r.part == p] for p in parts]
        return [np.array([r.value for r in made if r.part == p]) for p in parts]


def bidiagonalise(data: Blocks, components: int, early: bool = False, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """``(vectors, values, trace)``: unit right singular vectors of the centred rows as columns, singular values falling, and the squared sum of all entries.

    Values at rounding are zero. ``early``: see :func:`whiten`.
    """
    d, draw = data.d, np.random.default_rng(seed)
    v_all, w_all, t_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # right vectors; combinations that give left ones; XᵀU
    inner = np.zeros((d, d))  # the bidiagonal matrix
    trace, floor, beta, v = 0.0, 0.0, 0.0, np.zeros(d)
    for k in range(d):
        if not beta:  # at the start, and where the space so far is closed
            v = draw.normal(size=d)
            for _ in range(3):
                v = v - v_all @ (v_all.T @ v)
                v /= np.linalg.norm(v)
        w = v - beta * w_all[:, -1] if beta else v

        def products(x: np.ndarray, w=w, known=w_all, first=k == 0) -> tuple[np.ndarray, ...]:
            u = x @ w
            return x.T @ u, np.array([u @ u]), np.append((x @ known).T @ u, 0.0), np.array([np.einsum("ij,ij->", x, x) if first else 0.0])

        xtu, uu, shared, square = data.summed(products)
        if k == 0:
            trace, floor = float(square[0]), 1e-13 * float(np.sqrt(square[0]))
        shared = shared[:-1]
        alpha = float(np.sqrt(max(0.0, float(uu[0]) - float(shared @ shared))))
        alpha = alpha if alpha > floor else 0.0
        t = (xtu - t_all @ shared) / alpha if alpha else np.zeros(d)
        w_all = np.column_stack([w_all, (w - w_all @ shared) / alpha if alpha else np.zeros(d)])
        v_all, t_all = np.column_stack([v_all, v]), np.column_stack([t_all, t])
        inner[k, k] = alpha
        after = t - alpha * v
        for _ in range(2):
            after = after - v_all @ (v_all.T @ after)
        beta = float(np.linalg.norm(after))
        beta = beta if beta > floor else 0.0
        if early and k + 1 >= components:
            left, _, _ = np.linalg.svd(inner[: k + 1, : k + 1])
            if np.all(beta * np.abs(left[-1, :components]) <= floor):
                break
        if beta and k + 1 < d:
            inner[k, k + 1], v = beta, after / beta
    size = v_all.shape[1]
    _, values, right = np.linalg.svd(inner[:size, :size])
    values[values <= floor] = 0
    return v_all @ right.T, values, trace


def whiten(
    vectors: DataFrame, *, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000, early: bool = False
) -> DataFrame:
    """A row for each usable vector and component: the vector projected on the component, over the component's deviation.

    Columns: the id as ``vec_id``, ``component`` (from 1, by falling variance), ``n``, ``deviation`` (the squared distance from
    the mean, times the squared n, exact), ``whitened``, ``explained`` (the component's share of the variance), ``identity_error``
    (of the whitened table's covariance, by its largest entry), ``distance`` (``deviation`` over the squared n).
    """
    rows = whole(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("__v")), "__v", scale, shift)
    data = Blocks(rows)
    basis, values, trace = bidiagonalise(data, components, early) if data.n else (np.zeros((0, 0)), np.zeros(0), 0.0)
    k = int((values[:components] > 0).sum())
    n, error, explained = data.n, 0.0, [float(v * v / trace) for v in values[:k]]
    project = basis[:, :k] / (values[:k] / np.sqrt(n)) if k else np.zeros((data.d, 0))
    if k:
        mean = data.summed(lambda x: ((x @ project).sum(0),))[0] / n
        square = data.summed(lambda x: ((y := x @ project - mean).T @ y,))[0].reshape(k, k) / n
        error = float(np.abs(square - np.eye(k)).max())
    centre = data.centre() if n else None
    floor, rest = [s // n for s in data.sums] if n else [], [s % n for s in data.sums] if n else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, it) if k else ():
            x = _matrix(batch.column(1))
            y = np.ascontiguousarray(centre(x) @ project)
            off = x - np.array(floor, np.int64)
            most = (int(np.abs(off).max()) + 1) * n
            if most * most * len(floor) < 1 << 63:
                far = ((off * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
            else:  # beyond 64 bits on the way
                far = [sum((a * n - r) ** 2 for a, r in zip(row, rest)) for row in off.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f if f < 1 << 63 else None for f in far], pa.int64()), pa.array([f / (n * n) for f in far], pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), k).cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "distance", "y"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    made = rows.select("vec_id", "__x").mapInArrow(run, f"vec_id {kind}, deviation long, distance double, y array<double>")
    each = made.select("vec_id", "deviation", "distance", F.posexplode("y").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(e) for e in explained)), F.col("at") + 1) if k else F.lit(0.0)
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"), "distance",
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every embedding on the eight components of the greatest variance, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
