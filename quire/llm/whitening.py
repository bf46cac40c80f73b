"""Embedding whitening by incremental eigendecomposition (operator 13).

Each task goes over its vectors once and keeps the eigenvalues and
eigenvectors of their scatter about their mean. A vector is a centred rank-one
update: its coordinates z in the present basis give the secular equation
1 + rho * sum(z_i^2 / (d_i - t)) = 0, whose roots are the new eigenvalues.
Coordinates of no weight and equal eigenvalues are deflated; eigenvectors come
from coordinates recomputed from the roots, which keeps them orthogonal. Two
spectra are combined by one such update for each eigenvector of one and one
for the difference of means; they are folded FAN at a time, in tasks, and the
last FAN in the driver.

Then Rayleigh-Ritz steps over all rows: with the exact mean, the covariance
times the basis is summed in tasks, and the small projected matrix is solved.
With at most RANK dimensions the basis is whole and one step gives the
components to double precision. With more, the spectrum keeps RANK directions
and steps of subspace iteration follow until the residuals of the asked
components are below TOLERANCE of the first eigenvalue.

A task holds one batch of vectors and some matrices of dimensions x RANK, as
does the driver, whatever the number of rows.

Defined cases: null vectors and such with null or non-finite entries are
dropped; a null vec_id stays; repeated rows count and come again; no vectors,
or vectors without entries: no rows; of fewer dimensions than components all
are given; a component without variance (below 1e-13 of the whole) has a null
`whitened` and counts as right in `identity_error`; `explained` is null if
there is no variance at all; a `deviation` too large for a long is null; equal
eigenvalues have any orthonormal pair of vectors; other columns don't matter
(see common.pick). Vectors of different lengths, or entries beyond 2^42, are
errors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, stored, table

COMPONENTS, RANK, FAN = 8, 128, 16
TOLERANCE, MOST_STEPS = 1e-12, 300
SCALE, SHIFT = 1024, 100_000
_EPS = np.finfo(float).eps


# ---- rank-one updates ----------------------------------------------------------------------------


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - t)), for rising d and positive w: (t, difference of each pole and each root [root, pole]).

    Each root lies between two poles, the last above all of them. It is sought
    as a distance from the nearer pole by two-pole interpolation, and by
    halving where that leaves the bracket.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    at_mid = 1 + (w / (d - (d + gap / 2)[:, None])).sum(axis=1)
    from_left = (at_mid >= 0) | (np.arange(k) == k - 1)
    origin = np.where(from_left, d, right)
    delta = d - origin[:, None]
    lo = np.where(from_left, 0.0, -gap / 2)
    hi = np.where(from_left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    t = (lo + hi) / 2
    on = np.arange(k)  # roots still sought
    with np.errstate(all="ignore"):
        for _ in range(80):
            end = on == k - 1
            diff = delta[on] - t[on, None]
            term = w / diff
            slope = term / diff
            below = np.arange(k) <= on[:, None]
            low, dlow = np.where(below, term, 0).sum(axis=1), np.where(below, slope, 0).sum(axis=1)
            high, dhigh = term.sum(axis=1) - low, slope.sum(axis=1) - dlow
            f = 1 + low + high
            a, b = diff[np.arange(len(on)), on], np.where(end, 1.0, diff[np.arange(len(on)), np.minimum(on + 1, k - 1)])
            hi[on], lo[on] = np.where(f > 0, t[on], hi[on]), np.where(f < 0, t[on], lo[on])
            s, s2 = dlow * a * a, np.where(end, 0.0, dhigh * b * b)
            c = f - dlow * a - np.where(end, 0.0, dhigh * b)
            p = c * (a + b) + s + s2
            q = c * a * b + s * b + s2 * a
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            new = t[on] + np.where(end, a + s / c, step)
            new = np.where((new > lo[on]) & (new < hi[on]), new, (lo[on] + hi[on]) / 2)
            open_ = (np.abs(f) > _EPS * k * (1 - low + high)) & (new != t[on])
            t[on[open_]] = new[open_]
            on = on[open_]
            if not len(on):
                break
    return origin + t, delta - t[:, None]


def rank_one(d: np.ndarray, basis: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of basis (diag(d) + rho z z') basis', for rho > 0."""
    norm = np.linalg.norm(z)
    top = max(abs(d[-1]), rho * norm * norm) if len(d) else 0.0
    if not len(d) or rho * norm * norm <= _EPS * top * 1e-3 or norm == 0:
        return d, basis
    z, rho = z / norm, rho * norm * norm
    tol = 8 * _EPS * top
    live = rho * np.abs(z) > tol
    # Equal eigenvalues: turn the pair so that one of the two has no weight.
    place = np.flatnonzero(live)
    near = np.flatnonzero(np.diff(d[place]) <= 64 * tol) if len(place) > 1 else place[:0]
    if len(near):
        basis, z, d = basis.copy(), z.copy(), d.copy()
        held = place[0]
        for j in place[1:]:
            r = np.hypot(z[held], z[j])
            c, s = z[j] / r, z[held] / r
            if abs((d[j] - d[held]) * c * s) <= tol:
                one, two = basis[:, held].copy(), basis[:, j].copy()
                basis[:, held], basis[:, j] = c * one - s * two, s * one + c * two
                a, b = d[held], d[j]
                d[held], d[j] = a * c * c + b * s * s, a * s * s + b * c * c
                z[held], z[j] = 0.0, r
                live[held] = False
            held = j
    mine = np.flatnonzero(live)
    if len(mine):
        order = mine[np.argsort(d[mine], kind="stable")]
        pole, zz = d[order], z[order]
        roots, diff = secular_roots(pole, rho * zz * zz)
        k = len(pole)
        # Weights for which these roots are exact.
        below = np.tri(k, k, -1, dtype=bool).T  # [root, pole], root < pole
        shifted = np.append(pole[1:], 0.0)[:, None]
        under = np.where(below, pole[:, None] - pole, np.where(np.arange(k)[:, None] == k - 1, rho, shifted - pole))
        weight = np.sqrt(np.abs(np.prod(-diff / under, axis=0))) * np.sign(zz)
        turned = weight[:, None] / diff.T
        turned /= np.linalg.norm(turned, axis=0)
        d, basis = d.copy(), basis.copy()
        d[order], basis[:, order] = roots, basis[:, order] @ turned
    order = np.argsort(d, kind="stable")
    return d[order], basis[:, order]


class Spectrum:
    """Number, mean and scatter (as eigenvalues and eigenvectors, `rank` of them at most) of vectors."""

    def __init__(self, dims: int, rank: int = RANK):
        self.dims, self.rank, self.n = dims, min(rank, dims), 0
        self.mean, self.values, self.basis = np.zeros(dims), np.zeros(0), np.zeros((dims, 0))

    def _update(self, v: np.ndarray, weight: float) -> None:
        z = self.basis.T @ v
        if len(self.values) < self.dims:
            rest = v - self.basis @ z
            more = self.basis.T @ rest
            rest, z = rest - self.basis @ more, z + more
            size = np.linalg.norm(rest)
            if size > 1e-10 * np.linalg.norm(v):
                self.values, self.basis, z = np.append(0.0, self.values), np.column_stack((rest / size, self.basis)), np.append(size, z)
        self.values, self.basis = rank_one(self.values, self.basis, z, weight)
        if len(self.values) > self.rank:
            self.values, self.basis = self.values[1:], self.basis[:, 1:]

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self._update(away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if other.n == 0:
            return
        if self.n == 0:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        away, n = other.mean - self.mean, self.n + other.n
        self._update(away, self.n * (other.n / n))
        for value, v in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self._update(v, value)
        self.mean, self.n = self.mean + away * (other.n / n), n


# ---- passes over the vectors ---------------------------------------------------------------------


def _integers(column: pa.Array) -> np.ndarray:
    """x = floor(1024 c) + 100000 of a batch of vectors without nulls, all of the first one's length."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    c = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, int(sizes[0]) if n else 0)
    if c.size and np.abs(c).max() > 2.0**42:
        raise ValueError("an entry is beyond 2^42")
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


def _rows(batches, column: int = 0, most: int = 2000):
    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            yield part, _integers(part.column(column))


def fold(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str, fan: int = FAN) -> bytes | None:
    """One value of all rows of parts(part: binary), one a task: merged `fan` at a time in tasks, the last ones in the driver."""
    parts = stored(parts.select(F.spark_partition_id().alias("slot"), "part"), name)
    last = parts.agg(F.max("slot")).first()[0]
    if last is None:
        return None

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"slot": [key[0]], "part": [merge(pdf.sort_values("slot")["part"].tolist())]})

    while last >= fan:
        parts = stored(parts.groupBy(F.floor(F.col("slot") / fan).cast("int").alias("slot_")).applyInPandas(run, "slot int, part binary"), name)
        last //= fan
    return merge([r[1] for r in sorted(parts.collect())])


def _one_a_task(df: DataFrame, work: Callable) -> DataFrame:
    """(part) with work(iterator of (batch, integers)), pickled, for each task that has rows."""

    def run(batches):
        got = work(_rows(batches))
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["part"])

    return df.mapInArrow(run, "part binary")


def spectrum_of(vectors: DataFrame, rank: int = RANK) -> tuple[int, np.ndarray, Spectrum] | None:
    """Number, exact sums and spectrum of vectors(embedding); None without any."""

    def work(rows):
        found = None
        for _, x in rows:
            if found is None:
                found = [0, np.zeros(x.shape[1], np.int64), Spectrum(x.shape[1], rank)]
            if x.shape[1] != found[2].dims:
                raise ValueError("vectors of different lengths")
            found[0] += len(x)
            found[1] += x.sum(axis=0)
            for v in x.astype(float):
                found[2].add(v)
        return found

    def merge(parts):
        n, sums, spectrum = pickle.loads(parts[0])
        for m, more, other in map(pickle.loads, parts[1:]):
            if other.dims != spectrum.dims:
                raise ValueError("vectors of different lengths")
            n, sums = n + m, sums + more
            spectrum.merge(other)
        return pickle.dumps((n, sums, spectrum))

    got = fold(_one_a_task(vectors.select("embedding"), work), merge, "whiten-spectra")
    return None if got is None else pickle.loads(got)


def _sum_parts(parts):
    total = pickle.loads(parts[0])
    for p in parts[1:]:
        total = total + pickle.loads(p)
    return pickle.dumps(total)


def covariance_times(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance about the exact mean, times the basis."""

    def work(rows):
        total = None
        for _, x in rows:
            y = (n * x - sums) / n
            total = (0 if total is None else total) + y.T @ (y @ basis)
        return total

    return pickle.loads(fold(_one_a_task(vectors.select("embedding"), work), _sum_parts, "whiten-products")) / n


def components_of(vectors: DataFrame, n: int, sums: np.ndarray, spectrum: Spectrum, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` greatest eigenvalues and their vectors, by Rayleigh-Ritz steps."""
    basis = np.linalg.qr(spectrum.basis[:, ::-1])[0]
    count = min(count, basis.shape[1])
    for _ in range(MOST_STEPS):
        product = covariance_times(vectors, n, sums, basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, product @ turn
        off = np.linalg.norm(image[:, :count] - ritz[:, :count] * values[:count], axis=0)
        if basis.shape[1] == spectrum.dims or (off <= TOLERANCE * values[0]).all():
            return values[:count], ritz[:, :count]
        basis = np.linalg.qr(image)[0]
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")


def _whitened_error(vectors: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the covariance of whitened vectors, less the identity."""

    def work(rows):
        held = None
        for _, x in rows:
            w = ((n * x - sums) / n) @ turn
            mean = w.mean(axis=0)
            held = _joined(held, (len(w), mean, (w - mean).T @ (w - mean)))
        return held

    def merge(parts):
        held = None
        for p in parts:
            held = _joined(held, pickle.loads(p))
        return pickle.dumps(held)

    m, _, scatter = pickle.loads(fold(_one_a_task(vectors.select("embedding"), work), merge, "whiten-checks"))
    return float(np.abs(scatter / m - np.eye(len(scatter))).max())


def _joined(a, b):
    """Number, mean and scatter of two sets together."""
    if a is None:
        return b
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * (b[0] / n))


def _deviations(t: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of integers; null where beyond a long."""
    about = (t.astype(float) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        out = (t * t).sum(axis=1).tolist()
    for i in np.flatnonzero(about > 9.2e18).tolist():
        exact = sum(v * v for v in t[i].tolist())
        out[i] = exact if exact < 1 << 63 else None
    return out


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, rank: int = RANK) -> DataFrame:
    """embeddings(vec_id, embedding) → (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each remaining vector and component."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = pick(embeddings, "vec_id", "embedding").where(F.col("embedding").isNotNull() & finite)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, {SCHEMA}"
    found = spectrum_of(vectors, max(rank, components))
    if found is None or found[2].dims == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, spectrum = found
    if len(spectrum.values) < min(components, spectrum.dims):  # fewer directions with variance than components: any further ones do
        extra = np.linalg.qr(np.column_stack((spectrum.basis[:, ::-1], np.eye(spectrum.dims))))[0]
        spectrum.basis = extra[:, : min(max(rank, components), spectrum.dims)][:, ::-1]
    values, vectors_of = components_of(vectors, n, sums, spectrum, components)
    # The trace, exactly: its squares are summed as the deviations are.
    trace = _trace(vectors, n, sums)
    real = values > 1e-13 * trace if trace > 0 else np.zeros(len(values), bool)
    turn = np.where(real, vectors_of / np.sqrt(np.where(real, values, 1.0)), 0.0)
    error = _whitened_error(vectors, n, sums, turn[:, real]) if real.any() else 0.0
    shares = [float(v / trace) if trace > 0 else None for v in np.maximum(values, 0)]
    k = len(values)

    def run(batches):
        for part, x in _rows(batches, 1):
            t = n * x - sums
            w = (t / n) @ turn
            rows = len(x)
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()),
                    pa.array([d for d in _deviations(t) for _ in range(k)], pa.int64()),
                    pa.array(flat, pa.float64(), mask=~np.tile(real, rows)),
                    pa.array(shares * rows, pa.float64()),
                    pa.array(np.full(rows * k, error), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)


def _trace(vectors: DataFrame, n: int, sums: np.ndarray) -> float:
    def work(rows):
        total = None
        for _, x in rows:
            total = (0.0 if total is None else total) + float((((n * x - sums) / n) ** 2).sum())
        return total

    return pickle.loads(fold(_one_a_task(vectors.select("embedding"), work), _sum_parts, "whiten-trace")) / n


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
