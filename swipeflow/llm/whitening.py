"""Whitening of embeddings by incremental eigendecomposition (op 11).

Entries become whole numbers x = floor(scale * c) + shift.  Each partition keeps
the spectrum (eigenvalues, eigenvectors) of its centred scatter and updates it:
a block of rows is reduced to the triangular factor of its centred rows, which
has the same scatter in at most as many rows as there are dimensions, and each
of these rows, then the step between the means, is a centred rank-one update
(``block=1`` takes every row as it is).  A rank-one update turns the vector into
the basis of eigenvectors, deflates what is too small or belongs to equal
eigenvalues, solves the secular equation for the others, and takes their
eigenvectors from the weights for which the roots are exact (Loewner's formula),
which keeps them orthogonal.

Spectra are combined in a tree, a few in a task: the scaled eigenvectors of one
and the step between the means are rank-one updates of the other.  The last
basis is refined by a Rayleigh-Ritz step over all rows: the covariance in that
basis is summed by partitions and a tree, and its eigenvectors (a small matrix
on the driver) turn the basis into components.  A task holds matrices of the
dimension's square, whatever the number of rows; the driver holds one.

Whole numbers stay exact: sums are Python integers, the deviation is computed in
longs (null where it is beyond them).

Defined results: rows take part if the vector is there, has the length most
vectors have (the longer one if two are as frequent), and holds finite numbers
below 2**52 / scale; others give no rows.  Null ids stay null; repeated rows
count each; directions whose variance is below 1e-12 of the largest have no
component, so one vector, or equal ones, give no rows; an empty table gives an
empty result; other columns are not read.  The sign of a component is that of
its largest entry, made positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, col, stage, table

by_value(__name__)

EPS = float(np.finfo(np.float64).eps)
BLOCK = 1024         # rows reduced to their triangular factor before they update
FAN = 8              # states that one task of the tree combines
MAX_DIM = 4096       # a state holds the square of it in doubles
FLAT = 1e-12         # variance below this share of the largest is none
STATE = "part int, n long, sums array<string>, mean array<double>, spread array<double>, basis array<double>"


# ---- rank-one updates of a spectrum
def secular(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each root x of 1 + sum(w / (d - x)) = 0 (d rising, w positive) the
    row d - x.  Root i lies between d[i] and d[i + 1], the last one between d[-1]
    and d[-1] + sum(w).  The unknown is the way from the nearer pole, so that
    differences to it keep their digits."""
    k, every = len(d), np.arange(len(d))
    gap = np.append(np.diff(d), w.sum())
    away = d[None, :] - d[:, None]
    left = 1 + (w / (away - gap[:, None] / 2)).sum(1) >= 0      # rising: the root is left of the middle
    left[-1] = True
    delta = d[None, :] - d[np.where(left, every, np.minimum(every + 1, k - 1))][:, None]
    lo, hi = np.where(left, 0, -gap / 2), np.where(left, gap / 2, 0)
    hi[-1] = gap[-1]
    x = (lo + hi) / 2
    done = np.zeros(k, bool)
    lower, after = np.tri(k, dtype=bool), np.minimum(every + 1, k - 1)
    for _ in range(100):
        diff = delta - x[:, None]
        q = w / diff
        f = 1 + q.sum(1)
        below = f < 0
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        done |= np.abs(f) <= 4 * k * EPS * (1 + np.abs(q).sum(1))
        if done.all():
            break
        slope = q / diff
        psi = np.where(lower, slope, 0).sum(1)
        phi = slope.sum(1) - psi
        # the two neighbouring poles with weights of the same slopes, and a constant
        a1, a2 = diff[every, every], diff[every, after]
        c = f - a1 * psi - a2 * phi
        a, b = (a1 + a2) * f - a1 * a2 * (psi + phi), a1 * a2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = a1[-1] + a1[-1] ** 2 * psi[-1] / (f[-1] - a1[-1] * psi[-1])
        new = x + step
        new = np.where((new >= lo) & (new <= hi) & (new != 0), new, (lo + hi) / 2)
        done |= np.abs(new - x) <= EPS * np.abs(x)
        x = np.where(done, x, new)
    return delta - x[:, None]


def _merge_equal(d: np.ndarray, z: np.ndarray, basis: np.ndarray, tol: float) -> None:
    """Rotations that leave no weight on all but one of (nearly) equal eigenvalues."""
    p = -1
    for i in np.flatnonzero(z).tolist():
        if p >= 0:
            r = np.hypot(z[p], z[i])
            c, s = z[i] / r, z[p] / r
            if abs((d[i] - d[p]) * c * s) <= tol:
                z[i], z[p] = r, 0
                u, v = basis[:, p].copy(), basis[:, i].copy()
                basis[:, p], basis[:, i] = c * u - s * v, s * u + c * v
                d[p], d[i] = d[p] * c * c + d[i] * s * s, d[p] * s * s + d[i] * c * c
        p = i


def rank_one(spread: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis * spread * basis' + v * v'; eigenvalues rise."""
    z = basis.T @ v
    size = float(np.sqrt(z @ z))
    if size == 0:
        return spread, basis
    d, basis = spread.copy(), basis.copy()
    tol = 8 * EPS * max(float(d[-1]), size * size)
    z[np.abs(z) * size <= tol] = 0                              # deflated: its pair stays as it is
    at = np.flatnonzero(z)
    if len(at) > 1:
        zi, zp = z[at[1:]], z[at[:-1]]
        if (np.abs((d[at[1:]] - d[at[:-1]]) * zi * zp) <= tol * (zi * zi + zp * zp)).any():
            _merge_equal(d, z, basis, tol)
            at = np.flatnonzero(z)
            at = at[np.argsort(d[at], kind="stable")]
    if not len(at):
        return spread, basis
    poles, weights = d[at], z[at] ** 2
    diff = secular(poles, weights)
    # weights for which these roots are exact: products of (root - pole) over (pole - pole)
    k = len(at)
    below = np.tri(k, k=-1, dtype=bool).T                       # [j, i]: j < i
    other = np.where(below, poles[:, None], np.append(poles[1:], 0)[:, None]) - poles[None, :]
    other[-1] = np.where(below[-1], other[-1], -1)              # the last root has no pole of its own
    with np.errstate(all="ignore"):
        exact = np.sqrt(np.abs(np.prod(-diff / other, axis=0)))
    vectors = np.copysign(exact, z[at])[None, :] / diff
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    basis[:, at] = basis[:, at] @ vectors.T
    d[at] = poles - np.diagonal(diff)
    order = np.argsort(d, kind="stable")
    return d[order], basis[:, order]


class Spectrum:
    """Rows so far: number, exact sums, mean, and the spectrum of their centred scatter."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, [0] * dim, np.zeros(dim)
        self.spread, self.basis = np.zeros(dim), np.eye(dim)

    def update(self, v: np.ndarray) -> None:
        self.spread, self.basis = rank_one(self.spread, self.basis, v)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """The step between the means of these rows and ``n`` more."""
        if self.n:
            self.update(np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """A block of whole-number rows."""
        low = rows & ((1 << 26) - 1)
        self.sums = [s + (int(h) << 26) + int(x) for s, h, x in zip(self.sums, (rows >> 26).sum(0), low.sum(0))]
        origin = rows[0]
        x = (rows - origin).astype(np.float64)
        mean = x.mean(0)
        if len(x) > 1:
            for v in np.linalg.qr(x - mean, mode="r"):
                self.update(v)
        self._shift(len(x), origin + mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.spread, other.basis.T):
            if value > 0:
                self.update(np.sqrt(value) * vector)
        self._shift(other.n, other.mean)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> tuple:
        return part, self.n, [str(s) for s in self.sums], self.mean, self.spread, self.basis.ravel()

    @classmethod
    def of(cls, r) -> Spectrum:
        out = cls(len(r["mean"]))
        out.n, out.sums, out.mean, out.spread = int(r["n"]), [int(s) for s in r["sums"]], np.array(r["mean"]), np.array(r["spread"])
        out.basis = np.array(r["basis"]).reshape(len(out.mean), -1)
        return out


class Scatter:
    """Number, mean and centred scatter of rows; for the small matrices of the refinement."""

    def __init__(self, x: np.ndarray):
        self.n, self.mean = len(x), x.mean(0)
        y = x - self.mean
        self.spread = y.T @ y

    def merge(self, other: Scatter) -> None:
        n, step = self.n + other.n, other.mean - self.mean
        self.spread = self.spread + other.spread + np.outer(step, step) * (self.n * other.n / n)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def row(self, part: int) -> tuple:
        return part, self.n, [], self.mean, self.spread.ravel(), []

    @classmethod
    def of(cls, r) -> Scatter:
        out = cls.__new__(cls)
        out.n, out.mean = int(r["n"]), np.array(r["mean"])
        out.spread = np.array(r["spread"]).reshape(len(out.mean), -1)
        return out


# ---- over partitions
def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _state(row: tuple) -> pa.RecordBatch:
    part, n, *lists = row
    kinds = [pa.list_(pa.string()), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([n], pa.int64()), *[pa.array([list(x)], k) for x, k in zip(lists, kinds)]],
        names=[c.split()[0] for c in STATE.split(", ")])


def _spectra(block: int):
    """One spectrum per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch, "x")
                state = state or Spectrum(x.shape[1])
                for at in range(0, len(x), block):
                    state.add(x[at:at + block])
        if state:
            yield _state(state.row(TaskContext.get().partitionId()))
    return run


def _scatters(values: Callable[[pa.RecordBatch], np.ndarray]):
    """One scatter per partition of the rows that ``values`` makes of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                here = Scatter(values(batch))
                if state:
                    state.merge(here)
                else:
                    state = here
        if state:
            yield _state(state.row(TaskContext.get().partitionId()))
    return run


def combined(states: DataFrame, kind: type):
    """All states merged into one, FAN at a time; None if there are none."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")                       # in one order, whatever came first
        first, *rest = (kind.of(r) for r in rows.to_dict("records"))
        for r in rest:
            first.merge(r)
        return pd.DataFrame([first.row(int(rows["part"].iloc[0]) // FAN)], columns=list(rows.columns))
    states = stage(states, "states")
    while True:
        most = states.agg(F.max("part")).first()[0]
        if most is None:
            return None
        if not most:
            return kind.of(states.first().asDict())
        states = stage(states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(merge, STATE), "states")


def _rows(batch: pa.RecordBatch, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows minus their mean, and the whole numbers (row minus floor of the mean)."""
    floor = [s // n for s in sums]
    whole = _numbers(batch, "x") - np.array(floor, np.int64)
    return whole - np.array([(s - n * f) / n for s, f in zip(sums, floor)]), whole


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)^2) of each row, exact; None beyond a long."""
    rest = [s - n * (s // n) for s in sums]
    most = n * (float(np.abs(whole).max(initial=0)) + 1)
    if most * most * whole.shape[1] < 2.0 ** 62:
        y = n * whole - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * x - r) ** 2 for x, r in zip(row, rest)) for row in whole.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _whiten(n: int, sums: list[int], turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, whole = _rows(batch, n, sums)
                w = x @ turn
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(deviations(whole, n, sums), pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())],
                    names=["vec_id", "deviation", "w"])
    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x) of the rows that take part, all of one length."""
    v = col(vectors, vector_col)
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0 ** 52 / scale, F.lit(False)))    # NaN is above all
    good = F.when(F.coalesce(fine, F.lit(False)), v)
    rows = vectors.select(col(vectors, id_col).alias("vec_id"), F.transform(
        good, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")).alias("x")).where("size(x) > 0")
    rows = stage(rows, "whole-vectors")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("x") == (sizes["dim"] if sizes else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           scale: int = 64, shift: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    if min(components, block, scale) < 1:
        raise ValueError("components, block and scale must be at least 1")
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    kind = rows.schema["vec_id"].dataType.simpleString()
    dim = rows.select(F.size("x")).first()
    if dim and dim[0] > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} entries: a state would hold the square of them")
    fit = combined(rows.select("x").mapInArrow(_spectra(block), STATE), Spectrum)
    none = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                     "explained double, identity_error double")
    if fit is None:
        return none
    n, sums = fit.n, fit.sums
    basis = np.linalg.qr(fit.basis)[0]                          # orthogonal to the last digit
    ritz = combined(rows.select("x").mapInArrow(_scatters(lambda b: _rows(b, n, sums)[0] @ basis), STATE), Scatter)
    values, small = np.linalg.eigh(ritz.spread / n)
    values, turn = values[::-1], basis @ small[:, ::-1]
    kept = int((values[:components] > FLAT * values[0]).sum()) if values[0] > 0 else 0
    if not kept:
        return none
    turn = turn[:, :kept]
    turn = turn * np.sign(turn[np.abs(turn).argmax(0), np.arange(kept)])
    share = (values[:kept] / values.sum()).tolist()
    white = stage(rows.mapInArrow(_whiten(n, sums, turn / np.sqrt(values[:kept])),
                                  f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    check = combined(white.select("w").mapInArrow(_scatters(lambda b: _numbers(b, "w")), STATE), Scatter)
    error = float(np.abs(check.spread / n - np.eye(kept)).max())
    return white.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation").select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(share), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
