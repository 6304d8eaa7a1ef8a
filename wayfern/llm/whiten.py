"""Whitening of embeddings from an exact scatter matrix in residues.

Components become integers x, and with n rows and sums S the centred integers
are y = n*x - S.  Their scatter sum(y yT) is far beyond a double, so it is
computed in a residue number system: for each of several primes below 2^21 a
task reduces its rows modulo the prime and multiplies them as doubles in slices
of ``SLICE`` rows, where every sum stays exact.  The residues of all tasks are
added by Spark, and Chinese remaindering rebuilds the exact integers; as many
primes are taken as the largest |y| asks for.  The covariance is the scatter
over n^3, rounded once, and ``eigh`` in doubles gives its components.

Distribution: four scans of the vectors (sums, scatter, check, result).  What
tasks send on are matrices of dimensions x dimensions, added in the shuffle;
the driver holds one of them for each length of vectors, whatever the number of
rows.

Defined cases: vectors that are null, or hold null or a non-finite entry, take
no part, nor do rows without an id.  Vectors of each length are a fit list of
their own.  Repeated rows each count.  Entries beyond +-2^50 after scaling are
held there, deviations at the largest long.  Components whose eigenvalue is not
over ``RANK`` of the largest (constant or dependent dimensions, a single row)
have no direction of their own and are not returned; so an empty table, empty
vectors and equal vectors give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors

#: Primes lie below this; so many rows of residues keep a sum of products below 2^53.
PRIME_BELOW, SLICE = 1 << 21, 1 << 11
#: Scaled entries are held at this.
LIMIT = float(1 << 50)
#: Share of the largest eigenvalue below which a component counts as none.
RANK = 1e-12
LONG = np.iinfo(np.int64).max
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(product: int) -> list[int]:
    """Primes from ``PRIME_BELOW`` downwards whose product exceeds ``product``."""
    out: list[int] = []
    number, have = PRIME_BELOW - 1, 1
    while have <= product:
        if all(number % d for d in range(3, int(number**0.5) + 1, 2)):
            out.append(number)
            have *= number
        number -= 2
    return out


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues (Chinese remaindering)."""
    x, m = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def residue_scatter(y: np.ndarray, prime: int) -> np.ndarray:
    """sum(y yT) modulo a prime, for integer rows ``y``."""
    total = np.zeros((y.shape[1], y.shape[1]), np.int64)
    for at in range(0, len(y), SLICE):
        part = (y[at : at + SLICE] % prime).astype(np.float64)
        total = (total + (part.T @ part).astype(np.int64)) % prime
    return total


def integers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int64) + offset


@dataclass
class Fit:
    """Sums of a fit list: rows, sum of each dimension and largest |n*x - S|."""

    n: int
    sums: list[int]
    top: int

    def __post_init__(self) -> None:
        middle = [round(Fraction(s, self.n)) for s in self.sums]
        self._middle = np.array(middle, np.int64)
        self._rest = [s - self.n * m for s, m in zip(self.sums, middle, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, as longs where they fit, else as Python integers."""
        kind = np.int64 if self.top < 1 << 62 else object
        return (x - self._middle).astype(kind) * self.n - np.array(self._rest, kind)

    def deviations(self, y: np.ndarray) -> np.ndarray:
        if self.top**2 * max(1, y.shape[1]) <= LONG:
            return (y * y).sum(1)
        return np.array([min(int(v), LONG) for v in (y.astype(object) ** 2).sum(1)], np.int64)


@dataclass
class Components:
    """Projection of centred integers on whitened components, and each one's share of the variance."""

    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, y: np.ndarray) -> np.ndarray:
        return y.astype(np.float64) @ self.weights


def components(scatter: list[list[int]], n: int, most: int) -> Components:
    """The leading components of an exact scatter of n*x - S."""
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in scatter]).reshape(len(scatter), len(scatter))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * max(values.max(initial=0.0), 0.0)]
    trace = float(sum((Fraction(scatter[i][i], n**3) for i in range(len(scatter))), Fraction(0)))
    return Components(vectors[:, order] / (np.sqrt(values[order]) * n), values[order] / trace if trace else values[order])


def _rows(batch: pa.RecordBatch, scale: int, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, integer rows) for each length of vectors in a batch."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows = flat[(ends[at] - length)[:, None] + np.arange(length)].reshape(len(at), length)
        yield int(length), ids[at], integers(rows, scale, offset)


def fit_lists(rows: DataFrame, scale: int, offset: int) -> dict[int, Fit]:
    """Sums for each length of vectors; what comes to the driver is a row for each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for length, _, x in _rows(batch, scale, offset):
                if length:
                    part = [len(x), (x >> 25).sum(0), (x & ((1 << 25) - 1)).sum(0), x.min(0), x.max(0)]
                    old = found.get(length)
                    found[length] = part if old is None else [old[0] + part[0], old[1] + part[1], old[2] + part[2], np.minimum(old[3], part[3]), np.maximum(old[4], part[4])]
        for length, (n, high, low, least, most) in found.items():
            columns = [np.full(length, length), np.arange(length), np.full(length, n), high, low, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["length", "at", "n", "high", "low", "least", "most"])

    parts = rows.mapInArrow(sums, "length long, at long, n long, high long, low long, least long, most long")
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = parts.groupBy("length", "at").agg(F.sum("n").alias("n"), big("high"), big("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    out = {}
    for length in {r.length for r in found}:
        own = sorted((r for r in found if r.length == length), key=lambda r: r.at)
        n, s = own[0].n, [(int(r.high) << 25) + int(r.low) for r in own]
        top = max(max(n * r.most - t, t - n * r.least) for r, t in zip(own, s, strict=True))
        out[length] = Fit(n, s, top)
    return out


def exact_scatters(rows: DataFrame, fits: dict[int, Fit], scale: int, offset: int) -> dict[int, list[list[int]]]:
    """sum((n*x - S)(n*x - S)T) for each length of vectors, as exact integers."""
    moduli = {length: primes(2 * fit.n * fit.top**2 + 1) for length, fit in fits.items()}

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, _, x in _rows(batch, scale, offset):
                if length in fits:
                    y = fits[length].centred(x)
                    for p in moduli[length]:
                        found[length, p] = (found.get((length, p), 0) + residue_scatter(y, p)) % p
        for (length, p), matrix in found.items():
            at = np.triu_indices(length)  # the rest is the mirror image
            columns = [np.full(len(at[0]), length), np.full(len(at[0]), p), at[0], at[1], matrix[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["length", "prime", "i", "j", "r"])

    parts = rows.mapInArrow(residues, "length long, prime long, i long, j long, r long")
    sums = {(r.length, r.prime, r.i, r.j): r.r for r in parts.groupBy("length", "prime", "i", "j").agg(F.sum("r").alias("r")).collect()}
    out = {}
    for length, ps in moduli.items():
        matrix = [[0] * length for _ in range(length)]
        for i in range(length):
            for j in range(i, length):
                matrix[i][j] = matrix[j][i] = remainder([sums[length, p, i, j] % p for p in ps], ps)
        out[length] = matrix
    return out


def identity_errors(rows: DataFrame, fits: dict[int, Fit], found: dict[int, Components], scale: int, offset: int) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on the vectors."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for length, _, x in _rows(batch, scale, offset):
                if length in found:
                    z = found[length].project(fits[length].centred(x))
                    old = total.get(length, [0.0, 0.0])
                    total[length] = [old[0] + z.T @ z, old[1] + z.sum(0)]
        for length, (second, first) in total.items():
            k = len(first)
            i, j = np.indices((k + 1, k))
            columns = [np.full(i.size, length), i.ravel(), j.ravel(), np.vstack([second, first]).ravel()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["length", "i", "j", "v"])

    parts = rows.mapInArrow(products, "length long, i long, j long, v double").groupBy("length", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for length, c in found.items():
        k = c.weights.shape[1]
        m = np.zeros((k + 1, k))
        for r in parts:
            if r.length == length:
                m[r.i, r.j] = r.v
        m /= fits[length].n
        out[length] = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each of its ``most`` leading components, as ``SCHEMA`` says.

    ``deviation`` is sum((n*x - S)^2), ``explained`` a component's share of the
    variance, ``identity_error`` one value for each length of vectors.
    """
    rows = finite_vectors(vectors, id_col, vec_col)
    fits = fit_lists(rows, scale, offset)
    found = {length: components(matrix, fits[length].n, most) for length, matrix in exact_scatters(rows, fits, scale, offset).items()}
    for length, error in identity_errors(rows, fits, found, scale, offset).items():
        found[length].identity_error = error

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, ids, x in _rows(batch, scale, offset):
                c = found.get(length)
                k = c.weights.shape[1] if c else 0
                if not k:
                    continue
                fit, n = fits[length], len(ids)
                y = fit.centred(x)
                columns = [np.repeat(ids, k), np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, fit.n), np.repeat(fit.deviations(y), k), c.project(y).ravel(), np.tile(c.explained, n), np.full(n * k, c.identity_error)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(result, SCHEMA)
