"""Whitening of vectors by an eigendecomposition that is updated vector by vector."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.vectors import components, finite, of_common_length
from domweave.session import written

#: Integers are held within this bound.
BOUND = 1 << 31
#: Spectra that one task combines.
FAN_IN = 16


def secular_roots(d: np.ndarray, z2: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) for strictly rising ``d`` and positive ``z2``: (origin index, distance from it) of each.

    Every root lies between two poles.  It is kept as its distance from the nearer pole, where
    the distance loses no digits; steps fit one pole on either side (the sums below and above
    the root), and fall back to halving where such a step leaves the bracket.
    """
    n, at = len(d), np.arange(len(d))
    width = np.append(np.diff(d), z2.sum())
    middle = 1 + (z2 / ((d[None, :] - d[:, None]) - width[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (at < n - 1)
    origin = at + right
    base = d[None, :] - d[origin][:, None]  # poles as seen from each root's origin
    low = np.where(right, -width / 2, np.where((middle < 0), width / 2, 0.0))
    high = np.where(right, 0.0, np.where((middle < 0), width, width / 2))
    x, below = (low + high) / 2, at[None, :] <= at[:, None]
    last = at == n - 1
    following = np.minimum(at + 1, n - 1)
    for _ in range(rounds):
        gap = base - x[:, None]
        term = z2 / gap
        slope = term / gap
        value = 1 + term.sum(axis=1)
        high, low = np.where(value >= 0, x, high), np.where(value < 0, x, low)
        near, far = gap[at, at], gap[at, following]
        psi = np.where(below, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        with np.errstate(all="ignore"):
            c = value - near * psi - far * phi
            a = (near + far) * value - near * far * (psi + phi)
            b = near * far * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, near + near * near * psi / (value - near * psi), step)
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        # at a root up to the rounding of the sum itself
        done = np.abs(value) <= 2e-16 * (1 + np.abs(term).sum(axis=1))
        if done.all():
            break
        x = np.where(done, x, new)
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(values) vectors' + rho v v'``, rho > 0.

    Deflation: directions that v hardly touches keep their pair, and of (nearly) equal
    eigenvalues a rotation leaves only one that it touches.  The others' new values are
    the roots of the secular equation; the vectors use weights recomputed from the roots
    (Gu and Eisenstat, 1994), so that they stay orthogonal.
    """
    z = vectors.T @ v * np.sqrt(rho)
    order = np.argsort(values, kind="stable")
    d, z, q = values[order], z[order], vectors[:, order]
    total = max(np.abs(d).max(initial=0), float(z @ z))
    tiny = 8 * np.finfo(float).eps * total
    if total == 0:
        return d, q
    touched = np.abs(z) * np.sqrt(total) > tiny
    close = np.flatnonzero(touched)
    kept = []
    if len(close) and np.any(np.diff(d[close]) <= tiny):
        q = q.copy()
        for i in close:
            if kept and d[i] - d[kept[-1]] <= tiny:
                j = kept.pop()
                r = np.hypot(z[i], z[j])
                c, s = z[i] / r, z[j] / r
                q[:, [j, i]] = np.column_stack([c * q[:, j] - s * q[:, i], s * q[:, j] + c * q[:, i]])
                z[j], z[i] = 0.0, r
            kept.append(i)
        close = np.array(kept)
    if not len(close):
        return d, q
    dk, zk = d[close], z[close]
    origin, x = secular_roots(dk, zk * zk)
    gap = (dk[None, :] - dk[origin][:, None]) - x[:, None]  # pole j minus root i
    k = len(dk)
    # weights that have exactly these roots
    ratio = -gap.T  # root i minus pole j, by pole
    others = dk[None, :] - dk[:, None]
    np.fill_diagonal(others, 1.0)
    # pair root i < j with pole i, root i >= j with pole i + 1: every factor is positive
    shifted = np.empty((k, k))
    lower = np.tri(k, k, -1, dtype=bool)
    shifted[lower] = others[lower]
    if k > 1:
        upper = np.triu(np.ones((k, k - 1), bool))
        block = np.empty((k, k - 1))
        block[upper] = others[:, 1:][upper]
        shifted[:, :-1][upper] = block[upper]
    shifted[:, -1] = 1.0
    weight = np.sqrt(np.abs(np.prod(ratio / shifted, axis=1)))
    new = np.where(zk < 0, -weight, weight)[:, None] / gap.T
    new /= np.linalg.norm(new, axis=0)
    d, q = d.copy(), q.copy()
    d[close] = dk[origin] + x
    q[:, close] = q[:, close] @ new
    return d, q


@dataclass
class Spectrum:
    """Scatter (sum of centred outer products) of ``n`` vectors as eigenvalues and eigenvectors, with their mean."""

    n: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a centred rank-one update."""
        difference = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, difference, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + difference / self.n

    def combine(self, other: Spectrum) -> None:
        """The other's directions, then the distance of the means, as successive rank-one updates."""
        if not other.n:
            return
        if self.n:
            for value, vector in zip(other.values, other.vectors.T):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
            n, difference = self.n + other.n, other.mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, difference, self.n * other.n / n)
            self.mean, self.n = self.mean + difference * (other.n / n), n
        else:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors

    def record(self) -> dict:
        return {"n": float(self.n), "mean": self.mean.tolist(), "vals": self.values.tolist(), "vecs": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, r) -> Spectrum:
        mean = np.array(r.mean, float)
        return cls(r.n, mean, np.array(r.vals, float), np.array(r.vecs, float).reshape(len(mean), -1))


_SPECTRUM = "place long, n double, mean array<double>, vals array<double>, vecs array<double>"


def _integers(batch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


def spectrum_of(fit: DataFrame, dims: int, tasks: int) -> Spectrum:
    """Spectrum of the rows (x array<long>): one per task, combined ``FAN_IN`` at a time until one is left."""

    def update(batches):
        own = Spectrum.empty(dims)
        for batch in batches:
            for x in _integers(batch).astype(float):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([{"place": TaskContext.get().partitionId()} | own.record()])

    def combine(key, group):
        own = Spectrum.empty(dims)
        for r in group.sort_values("place").itertuples():
            own.combine(Spectrum.of(r))
        return pd.DataFrame([{"place": key[0]} | own.record()])

    now = written(fit.repartition(tasks).mapInArrow(update, _SPECTRUM), "spectra")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        group = F.floor(F.col("place") / FAN_IN)
        now = written(now.groupBy(group.alias("next")).applyInPandas(combine, _SPECTRUM), "spectra")
    return Spectrum.of(now.first())


def _projected(fit: DataFrame, total: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """basis' V basis, V the covariance of the rows; their products are summed by Spark."""
    k = basis.shape[1]

    def products(batches):
        own = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = _centred(_integers(batch), total, n) @ basis
                own += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j])], names=["i", "j", "s"])

    out = np.zeros((k, k))
    for r in fit.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def _centred(x: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """x - total / n without cancellation: the mean's whole part is taken off in integers."""
    whole = total // n
    return (x - whole.astype(np.int64)).astype(float) - ((total - whole * n) / n).astype(float)


def rayleigh_ritz(fit: DataFrame, total: np.ndarray, n: int, basis: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, refined within the span of ``basis``.

    Each pass projects the covariance on the basis and turns it to the projection's own
    eigenvectors, until the part off the diagonal has gone down to rounding.
    """
    values = None
    for _ in range(rounds):
        basis, _ = np.linalg.qr(basis)
        small = _projected(fit, total, n, basis)
        values, turn = np.linalg.eigh(small)
        values, basis = values[::-1], basis @ turn[:, ::-1]
        off = small - np.diag(np.diag(small))
        if np.abs(off).max() <= 1e-13 * max(values[0], 0):
            break
    return np.maximum(values, 0), basis / np.linalg.norm(basis, axis=0)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: int = 4, scale: int = 256, rows_per_task: int = 5_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row, for up to ``keep`` components.

    Components of the vectors become long floor(scale * x), held within +-2**31.  The model is fitted on each distinct
    vector once.  Every task runs through its share and updates a spectrum by one centred
    rank-one step a vector; spectra are combined by rank-one steps, 16 at a time; `rayleigh_ritz` then
    refines the result over all vectors.  A spectrum has as many numbers as dimensions squared,
    and nothing else reaches the driver.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are vectors whose length is not
    that of the smallest id.  Directions without variance (one distinct vector, fewer vectors than
    components) cannot be whitened and give no rows.  Null ids and repeated rows are returned like others;
    other columns are ignored; an empty table gives no rows.  ``deviation`` is exact; it is null if it does not fit a long.
    """
    spark = rows.sparkSession
    x = F.transform(F.col("v"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))))
    own = components(rows, id_col, vector).where(finite("v")).select("vec_id", x.alias("x"))
    own = written(of_common_length(own, "x"), "integers")
    fit = written(own.select("x").distinct(), "distinct")
    sums = fit.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("d").collect()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if not sums:
        return spark.createDataFrame([], out + ", identity_error double")
    dims, n = len(sums), sums[0].n
    total = np.array([int(r.s) for r in sums], object)
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-n // 100)), -(-n // rows_per_task))
    model = spectrum_of(fit, dims, tasks)
    values, vectors = rayleigh_ritz(fit, total, n, model.vectors)
    k = int(min(keep, (values > 1e-12 * values.sum()).sum()))
    trace, values, vectors = values.sum(), values[:k], vectors[:, :k]
    # the whitened vectors' own covariance, over all distinct vectors
    error = float(np.abs(_projected(fit, total, n, vectors / np.sqrt(values)) - np.eye(k)).max()) if k else None

    def project(batches):
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _integers(batch.select([1]))
            white = _centred(x, total, n) @ vectors / np.sqrt(values)
            # n x - S fits a long, or its square would not
            if (np.abs(total).max() + n * int(np.abs(x).max())) ** 2 * dims < 1 << 63:
                part = n * x - total.astype(np.int64)
                deviation = pa.array((part * part).sum(axis=1))
            else:
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x.tolist()]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            for c in range(k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), c + 1, np.int32)), pa.array(np.full(len(x), n, np.int64)), deviation,
                     pa.array(np.ascontiguousarray(white[:, c])), pa.array(np.full(len(x), values[c] / trace))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return own.mapInArrow(project, out).withColumn("identity_error", F.lit(error).cast("double"))
