"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the eigenvectors of its own scatter matrix up to date by rank-one updates, whose new
eigenvalues are the roots of a secular equation. The spectra of tasks are combined by further
rank-one updates, and a Rayleigh-Ritz step over the whole list refines the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import dropped, stored
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

COMPONENTS = 4
#: What an entry is multiplied by before it is floored to an integer.
SCALE = 256.0
#: Vectors that become one set of rank-one updates.
CHUNK = 4096
#: States combined in one task.
FAN_IN = 8
#: Eigenvalues below this part of the trace are taken for zero: they have no component.
NOTHING = 1e-12
_EPS = np.finfo(float).eps


# -- rank-one updates ------------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' (d rising, no z zero) as (nearest pole, distance from it).

    Root i lies between d[i] and d[i+1], the last one at most |z|² above d[-1]. Each is sought from
    its nearer pole, so that small distances keep their digits, by bisection of all at once.
    """
    k = len(d)
    gap = np.append(np.diff(d), z @ z)
    middle = d + gap / 2
    at_middle = 1 + (z**2 / (d - middle[:, None])).sum(1)
    left = (at_middle >= 0) | (np.arange(k) == k - 1)
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[pole][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    squares = z**2
    for _ in range(70):
        mid = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            rising = 1 + (squares / (delta - mid[:, None])).sum(1) < 0  # the root is further right
        low, high = np.where(rising, mid, low), np.where(rising, high, mid)
    mu = (low + high) / 2
    return pole, np.where(mu == 0, np.where(left, 1, -1) * _EPS * np.maximum(gap, np.finfo(float).tiny), mu)


def rank_one(lam: np.ndarray, vecs: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vecs diag(lam) vecs' + v v'``.

    Deflation first: directions in which *v* has nothing keep their eigenpair, and of two equal
    eigenvalues one is turned out of the way by a rotation. The others solve the secular equation;
    their eigenvectors come from the weights for which the computed roots are exact, so they stay
    orthogonal.
    """
    z = vecs.T @ v
    norm = z @ z
    if norm == 0:
        return lam, vecs
    tiny = 8 * _EPS * max(abs(lam).max(), norm)
    z = np.where(abs(z) * np.sqrt(norm) <= tiny, 0.0, z)
    live = np.flatnonzero(z)
    close = np.flatnonzero(np.diff(lam[live]) <= tiny)
    if len(close):
        vecs = vecs.copy()
        for c in close.tolist():
            i, j = int(live[c]), int(live[c + 1])
            r = np.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            vecs[:, [i, j]] = vecs[:, [i, j]] @ np.array([[cos, sin], [-sin, cos]])
            z[i], z[j] = 0.0, r
        live = np.flatnonzero(z)
    d, w = lam[live], z[live]
    if not len(d):
        return lam, vecs
    pole, mu = secular_roots(d, w)
    away = (d - d[pole][:, None]) - mu[:, None]  # d_j - root_i
    between = d - d[:, None]
    np.fill_diagonal(between, 1.0)
    with np.errstate(divide="ignore"):
        weight = np.exp((np.log(abs(away)).sum(0) - np.log(abs(between)).sum(0)) / 2) * np.sign(w)
    q = weight[:, None] / away.T
    q /= np.sqrt((q**2).sum(0))
    lam, out = lam.copy(), vecs.copy()
    lam[live] = d[pole] + mu
    out[:, live] = vecs[:, live] @ q
    order = np.argsort(lam, kind="stable")
    return lam[order], out[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix (sum of squares about the mean)."""

    n: int
    mean: np.ndarray
    lam: np.ndarray
    vecs: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, n: int, mean: np.ndarray, directions: np.ndarray) -> None:
        """*n* more vectors, given by their mean and rows whose squares sum to their scatter."""
        apart = mean - self.mean
        both = self.n + n
        updates = [*directions, apart * np.sqrt(self.n * n / both)] if self.n else list(directions)
        for v in updates:
            self.lam, self.vecs = rank_one(self.lam, self.vecs, v)
        self.mean = self.mean + apart * (n / both)
        self.n = both

    def add_vectors(self, x: np.ndarray) -> None:
        """Centred vectors as updates; more than d of them are turned into d rows of the same scatter."""
        mean = x.mean(0)
        rows = x - mean
        self.add(len(x), mean, np.linalg.qr(rows, "r") if len(rows) > rows.shape[1] else rows)

    def absorb(self, other: Spectrum) -> None:
        """Another spectrum, direction by direction."""
        if other.n:
            scaled = (other.vecs * np.sqrt(np.maximum(other.lam, 0))).T
            self.add(other.n, other.mean, scaled[np.abs(scaled).max(1) > 0])


# -- over Spark ------------------------------------------------------------------------

_STATE = "id long, n long, sums array<decimal(38,0)>, mean array<double>, lam array<double>, vecs array<double>"


def _state(spectrum: Spectrum, sums: list[int], at: int) -> dict:
    return {
        "id": pa.array([at], pa.int64()), "n": pa.array([spectrum.n], pa.int64()),
        "sums": pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))),
        "mean": pa.array([spectrum.mean.tolist()]), "lam": pa.array([spectrum.lam.tolist()]), "vecs": pa.array([spectrum.vecs.ravel().tolist()]),
    }


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of *d* integers each as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _spectra(d: int):
    """For `mapInArrow` over the fit list: the task's spectrum and exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, sums = Spectrum.empty(d), [0] * d
        for batch in batches:
            rows = matrix(batch.column("x"), d)
            for start in range(0, len(rows), CHUNK):
                part = rows[start : start + CHUNK]
                high, low = part >> 32, part & 0xFFFFFFFF
                sums = [s + (int(h) << 32) + int(m) for s, h, m in zip(sums, high.sum(0), low.sum(0))]
                found.add_vectors(part.astype(float))
        if found.n:
            yield pa.RecordBatch.from_pydict(_state(found, sums, TaskContext.get().partitionId()))

    return run


def _combined(d: int):
    """For `applyInArrow` over some states: one state of all their vectors."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        found, sums = Spectrum.empty(d), [0] * d
        for r in rows:
            found.absorb(Spectrum(r["n"], np.array(r["mean"]), np.array(r["lam"]), np.array(r["vecs"]).reshape(d, d)))
            sums = [a + int(b) for a, b in zip(sums, r["sums"])]
        return pa.table(_state(found, sums, rows[0]["id"] // FAN_IN))

    return run


def combined(states: DataFrame, d: int):
    """The one state that states lead to, FAN_IN neighbours in a task; None without any."""
    now = stored(states, "spectra")
    while now.count() > 1:
        after = stored(now.groupBy(F.floor(F.col("id") / FAN_IN).alias("group")).applyInArrow(_combined(d), _STATE), "spectra")
        dropped(now)
        now = after
    row = now.first()
    dropped(now)
    return row


def _gram(d: int, centre: np.ndarray, basis: np.ndarray):
    """For `mapInArrow` over the fit list: sums of products of the centred, projected vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            rows = matrix(batch.column("x"), d)
            for start in range(0, len(rows), CHUNK):
                y = (rows[start : start + CHUNK] - centre) @ basis
                total += y.T @ y
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(total[i, j])})

    return run


def projected_scatter(fit: DataFrame, d: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of y y' over the fit list, y a centred vector in *basis*: added up entry by entry, so only
    as many numbers as the matrix has come to the driver."""
    k = basis.shape[1]
    out = np.zeros((k, k))
    for r in fit.mapInArrow(_gram(d, centre, basis), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: usable vectors in whole numbers; a NULL vector, and one with a NULL or
    non-finite entry, is left out."""
    entry = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) != float("inf")))
    whole = F.transform(vector, lambda c: F.floor(entry(c) * SCALE))
    return rows.filter(F.col(vector).isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  # one column per component
    trace: float
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the list *fit* (``x``, each of *d* whole numbers); None of an empty list."""
    state = combined(fit.mapInArrow(_spectra(d), _STATE), d)
    if state is None:
        return None
    found = Whitening(state["n"], [int(s) for s in state["sums"]], np.empty(0), np.empty((d, 0)), 0.0, 0.0)
    basis = np.linalg.qr(np.array(state["vecs"]).reshape(d, d)[:, ::-1])[0]
    scatter = projected_scatter(fit, d, found.centre, basis)
    values, turn = np.linalg.eigh(scatter / found.n)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    found.trace = float(values.sum())
    k = min(components, int((values > NOTHING * max(found.trace, 0)).sum()))
    found.values, found.axes = values[:k], axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(0), np.arange(k)])
    white = projected_scatter(fit, d, found.centre, found.axes / np.sqrt(found.values)) / found.n
    found.identity_error = float(np.abs(white - np.eye(k)).max(initial=0))
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)², exact; NULL where it is more than a long holds."""
    largest = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if largest * largest * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component.

    Entries become whole numbers ``floor(256 * c)``. Each distinct vector counts once in the fit, so
    repeated rows change nothing and come back as often as they came in. Rows without a vector, or with
    a NULL or non-finite entry, are left out; a NULL id stays NULL. A vector shorter than the longest
    counts as followed by zeros. Directions without variance are no components: equal vectors, a single
    vector, empty vectors and an empty table give no rows. Among equal eigenvalues any basis is as good;
    one is chosen, the same for all rows. Other columns are not read.
    """
    given = integers(rows, vector)
    d = given.agg(F.max(F.size("x"))).first()[0] or 0
    none = rows.sparkSession.createDataFrame([], _WHITE)
    if not d:
        return none
    padded = given.withColumn("x", F.when(F.size("x") == d, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))))
    fit = stored(padded.select("x").distinct(), "fit")
    model = fitted(fit, d, components)
    dropped(fit)
    if model is None or not len(model.values):
        return none
    n, sums, error = model.n, model.sums, model.identity_error
    centre, axes = model.centre, model.axes / np.sqrt(model.values)
    explained = (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            x = matrix(batch.column("x"), d)
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n)),
                "deviation": pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                "whitened": pa.array(((x - centre) @ axes).ravel()),
                "explained": pa.array(explained * m, pa.float64()),
                "identity_error": pa.array(np.full(m * k, error)),
            })

    return padded.mapInArrow(run, _WHITE)
