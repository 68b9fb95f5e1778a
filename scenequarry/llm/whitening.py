"""Whitening of embeddings: an incremental eigendecomposition of their covariance, refined over all rows.

A partition keeps the spectrum of what it has read: eigenvalues and eigenvectors of the scatter about the mean. A vector changes the
scatter by one centred term of rank one, so the new eigenvalues are the roots of a secular equation, found after deflation, and the new
eigenvectors follow from them. Spectra of partitions are united in a tree by the same updates, one for each eigenpair of the other and one for
the difference of means. Rayleigh-Ritz passes over all rows then refine the leading vectors until their residual is at rounding level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.shared import store

COMPONENTS = 8
#: Spectra that one task unites.
FAN_IN = 8
#: Vectors beside the wanted ones in the refined basis; refinements at most; residual, as a share of the largest eigenvalue, at which they end.
SPARE, REFINEMENTS, SETTLED = 8, 8, 1e-13
#: Eigenvalues below this share of the largest are zeros of rounding.
ZERO = 1e-12
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + rho z z'`` for rising, distinct ``d``, non-zero ``z`` of length one and ``rho`` above 0.

    Returns for each root the pole it is measured from, and its distance: differences from poles keep their relative precision.
    Steps by a rational interpolation through both poles around a root, kept in a bracket that is halved where a step leaves it.
    """
    m, z2 = len(d), z * z
    if m == 1:
        return np.zeros(1, int), rho * z2
    right = np.append(d[1:], d[-1] + rho * z2.sum())
    width = right - d
    at_middle = 1 + rho * (z2 / (d - (d + width / 2)[:, None])).sum(1)
    # The pole nearer to the root; the last root has only one.
    origin = np.arange(m) + ((at_middle < 0) & (np.arange(m) < m - 1))
    apart = d[None, :] - d[origin][:, None]
    near = origin == np.arange(m)
    low = np.where(near, np.where(at_middle < 0, width / 2, 0.0), -width / 2)
    high = np.where(near, np.where(at_middle < 0, width, width / 2), 0.0)
    last = np.arange(m) == m - 1
    left_of = np.tri(m)
    one, two = apart[np.arange(m), np.arange(m)], apart[np.arange(m), np.minimum(np.arange(m) + 1, m - 1)]
    tau, weight = (low + high) / 2, rho * z2
    with np.errstate(all="ignore"):
        for turn in range(100):
            inverse = 1 / (apart - tau[:, None])
            # Poles up to a root's own give negative terms, the others positive ones.
            below, both = (inverse * left_of) @ weight, inverse @ weight
            f = 1 + both
            found = (np.abs(f) <= 4 * _EPS * m * (1 + both - 2 * below)) | (high - low <= 2 * _EPS * np.abs(tau))
            if found.all():
                break
            low, high = np.where(f < 0, tau, low), np.where(f >= 0, tau, high)
            inverse *= inverse
            df, psi = inverse @ weight, (inverse * left_of) @ weight
            a1, a2 = one - tau, two - tau
            c = f - a1 * psi - a2 * (df - psi)
            a, b = (a1 + a2) * f - a1 * a2 * df, a1 * a2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            # The last root: one pole and a constant.
            s = a1 * a1 * df
            step = np.where(last, a1 + s / (f - a1 * df), step)
            moved = tau + step
            inside = (moved > low) & (moved < high) & (turn % 8 < 6)
            tau = np.where(found, tau, np.where(inside, moved, (low + high) / 2))
    return origin, tau


class Spectrum:
    """Count, mean, and eigenvalues (rising) with eigenvectors (columns) of the scatter of the vectors seen."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.values, self.vectors, self.steps = 0, np.zeros(size), np.zeros(size), np.eye(size), 0

    def _rank_one(self, v: np.ndarray, rho: float) -> None:
        """The spectrum of the scatter plus ``rho v v'``."""
        z = self.vectors.T @ v
        length = float(np.sqrt(z @ z))
        if not rho * length > 0:
            return
        z, rho = z / length, rho * length * length
        d, tiny = self.values, 8 * _EPS * max(float(self.values[-1]), rho)
        # Deflation: parts of z too small to matter, and poles too close to tell apart, whose z a rotation gathers in one.
        active = rho * np.abs(z) > tiny
        at = np.flatnonzero(active)
        for i in np.flatnonzero(np.diff(d[at]) <= tiny):
            p, j = at[i], at[i + 1]
            r = np.hypot(z[p], z[j])
            c, s = z[j] / r, z[p] / r
            self.vectors[:, [p, j]] = self.vectors[:, [p, j]] @ np.array([[c, s], [-s, c]])
            d[p], d[j] = d[p] * c * c + d[j] * s * s, d[p] * s * s + d[j] * c * c
            z[p], z[j], active[p] = 0.0, r, False
        at = np.flatnonzero(active)
        if not len(at):
            return
        poles = d[at]
        origin, tau = secular_roots(poles, z[at], rho)
        # Pole minus root, and from it the z for which these roots are exact: eigenvectors come out orthogonal.
        gap = (poles[None, :] - poles[origin][:, None]) - tau[:, None]
        m = len(at)
        exact = np.empty(m)
        if m == 1:
            exact[0] = 1.0
        else:
            i, j = np.arange(m)[:, None], np.arange(m - 1)[None, :]
            other = j + (j >= i)
            exact = np.sqrt(np.abs(np.prod(gap[j, i] / (poles[i] - poles[other]), axis=1) * gap[m - 1]))
        q = np.copysign(exact, z[at])[None, :] / gap
        q /= np.sqrt((q * q).sum(1))[:, None]
        self.vectors[:, at] = self.vectors[:, at] @ q.T
        d[at] = poles[origin] + tau
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = np.maximum(d[order], 0.0), self.vectors[:, order]
        self.steps += 1
        if self.steps % 256 == 0:
            # Orthogonal again; signs don't matter.
            self.vectors = np.linalg.qr(self.vectors)[0]

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        away = x - self.mean
        self._rank_one(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def unite(self, other: Spectrum) -> None:
        """All vectors of another spectrum: one update for each of its eigenpairs, one for the difference of means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        top = other.values[-1]
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > _EPS * top:
                self._rank_one(vector, float(value))
        away = other.mean - self.mean
        self._rank_one(away, self.n * other.n / (self.n + other.n))
        self.mean = self.mean + away * (other.n / (self.n + other.n))
        self.n += other.n

    def row(self) -> list:
        return [self.n, self.mean, self.values, self.vectors.ravel()]

    @staticmethod
    def of(n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Spectrum:
        made = Spectrum(len(mean))
        made.n, made.mean, made.values, made.vectors = int(n), np.array(mean, float), np.array(values, float), np.array(vectors, float).reshape(len(mean), len(mean))
        return made


SPECTRUM = "n long, mean array<double>, values array<double>, vectors array<double>"


def _blocks(batches: Iterator[pa.RecordBatch], place: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of whole numbers, some thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            yield part, part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def spectrum_of(rows: DataFrame, origin: np.ndarray, fan_in: int = FAN_IN) -> Spectrum:
    """Spectrum of all ``rows(x)``, seen from a whole-number ``origin``: a partition's vectors one by one, then partitions ``fan_in`` at a time, level by level.

    A task holds one spectrum (size squared numbers) and reads the others it unites one after another.
    """

    size = len(origin)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(size)
        for _, block in _blocks(batches, 0, size):
            for x in (block - origin).astype(float):
                own.add(x)
        if own.n:
            row = [TaskContext.get().partitionId(), *own.row()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:2]] + [pa.array([v], pa.list_(pa.float64())) for v in row[2:]], ["part", "n", "mean", "values", "vectors"])

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One task's partition has all of its groups, in order: a spectrum at a time is read.
        own, group = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if own is not None and r.group != group:
                    yield pd.DataFrame([[group, *own.row()]], columns=["part", "n", "mean", "values", "vectors"])
                    own = None
                if own is None:
                    own, group = Spectrum(size), r.group
                own.unite(Spectrum.of(r.n, r.mean, r.values, r.vectors))
        if own is not None:
            yield pd.DataFrame([[group, *own.row()]], columns=["part", "n", "mean", "values", "vectors"])

    level = store(rows.select("x").mapInArrow(read, f"part long, {SPECTRUM}"), "whitening-spectra")
    while (count := level.count()) > 1:
        # Partition numbers may have gaps where partitions were empty; groups shrink until one is left.
        groups = -(-int(level.agg(F.max("part")).first()[0] + 1) // fan_in) if count > fan_in else 1
        placed = level.withColumn("group", F.floor(F.col("part") / fan_in) if groups > 1 else F.lit(0).cast("long")).drop("part")
        level = store(placed.repartition(max(1, min(groups, 10_000)), "group").sortWithinPartitions("group").mapInPandas(unite, f"part long, {SPECTRUM}"), "whitening-spectra")
    found = level.first()
    return Spectrum(size) if found is None else Spectrum.of(found["n"], found["mean"], found["values"], found["vectors"])


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``x`` minus the mean: the difference is taken in whole numbers, so that nothing cancels."""
    return (x * n - total) / n


def _covariance_times(rows: DataFrame, n: int, total: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over all rows of ``(x - mean)`` times its part in the basis: one pass, one small matrix a partition, summed cell by cell."""
    size, wide = basis.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((size, wide))
        for _, block in _blocks(batches, 0, size):
            away = _centred(block, n, total)
            found += away.T @ (away @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * wide)), pa.array(found.ravel())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * wide)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out.reshape(size, wide)


def refine(rows: DataFrame, n: int, total: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` eigenvalues (falling) and eigenvectors of the covariance (divisor ``n``), from a basis near them.

    A pass gives the covariance times the basis, so both the Ritz pairs and their residuals. While those are above rounding, the
    residuals join the basis and another pass is made.
    """
    size, before = len(total), np.inf
    basis = np.linalg.qr(start[:, : min(size, k + SPARE)])[0]
    for turn in range(REFINEMENTS):
        image = _covariance_times(rows, n, total, basis) / n
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        vectors, images = basis @ turned, image @ turned
        rest = images - vectors * values
        off = np.abs(rest[:, :k]).max(initial=0.0)
        if turn == REFINEMENTS - 1 or basis.shape[1] == size or off <= SETTLED * max(values[0], 0.0) or off > before / 2:
            break
        before = off
        keep = min(size, k + SPARE)
        wide = np.concatenate([vectors[:, :keep], rest[:, :keep] / np.maximum(np.sqrt((rest[:, :keep] ** 2).sum(0)), 1e-300)], axis=1)
        basis = np.linalg.qr(wide)[0][:, :size]
    return values[:k], vectors[:, :k]


def usable_vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` of rows whose vector has only finite entries, as whole numbers ``floor(scale c) + shift``, and the vectors' length.

    The length is the commonest among such rows (of equals the least); vectors of other lengths, and empty ones, are left out.
    """
    c = F.col(f"`{column}`")
    fine = table.select(F.col(f"`{id_column}`").alias("vec_id"), c.cast("array<double>").alias("c")).where("c IS NOT NULL AND size(c) > 0 AND forall(c, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))")
    lengths = fine.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    size = 0 if lengths is None else lengths["d"]
    return fine.where(F.size("c") == size).select("vec_id", F.transform("c", lambda v: F.floor(v * scale).cast("long") + shift).alias("x")), size


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are those of another length than the commonest.
    Repeated rows count as often as they are there; a null id is handed on. There are as many components as the vectors have entries, at most
    ``components``; a component without variance (below 1e-12 of the largest) can't be scaled to one and is left out, so that a single vector, or
    copies of one, give no rows, as an empty table does. Equal eigenvalues leave their vectors open to a rotation. Entries too large for the
    whole-number form are an error. ``deviation`` is null where it is beyond a long. Extra columns are ignored.
    """
    spark = table.sparkSession
    rows, size = usable_vectors(table, id_column, column)
    schema = f"vec_id {table.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = store(rows, "whitening-rows")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(total, n))], ["place", "v"])

    sums = {r["place"]: r["v"] for r in rows.select("x").mapInArrow(add_up, "place long, v long").groupBy("place").agg(F.sum("v").alias("v")).collect()}
    n, total = sums[size], np.array([sums[i] for i in range(size)], np.int64)
    spectrum = spectrum_of(rows, np.rint(total / n).astype(np.int64))
    values, vectors = refine(rows, n, total, spectrum.vectors[:, ::-1], min(components, size))
    trace = float(spectrum.values.sum()) / n
    usable = values > ZERO * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[usable], vectors[:, usable]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, ones = np.zeros((k, k)), np.zeros(k)
        for _, block in _blocks(batches, 0, size):
            w = _centred(block, n, total) @ scaled
            moments, ones = moments + w.T @ w, ones + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([moments.ravel(), ones]))], ["cell", "v"])

    cells = {r["cell"]: r["v"] for r in rows.select("x").mapInArrow(second_moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    found = np.array([cells[i] for i in range(k * k + k)]) / n
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :]) - np.eye(k)).max())
    explained = values / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, 1, size):
            if not part.num_rows:
                continue
            w = _centred(block, n, total) @ scaled
            off = block * n - total
            if int(np.abs(off).max()) ** 2 * size < 1 << 63:
                deviation = (off**2).sum(axis=1).tolist()
            else:
                # Whole numbers of any size, where a long may not do.
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                deviation = [v if v < 1 << 63 else None for v in exact]
            each = np.repeat(np.arange(part.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(each), n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(emit, schema)
