"""Whitening of embeddings by principal components from a randomised range finder.

Counts and sums come first, then passes over all rows. A pass has an orthonormal basis, a few directions wider than the
components asked for, and sums each centred row times its products with the basis: the covariance applied to the basis,
which never exists in whole. The first basis is random; each pass is a power step, and its Rayleigh-Ritz values and vectors
come with residuals. If the residuals of the wanted components are still over TOLERANCE after POWER passes, the basis becomes
the full space and one more pass makes the components exact to the rounding of the sums. Last, the covariance of the whitened
rows is measured over all rows.

Tasks add up matrices of the size of the basis, which are summed in a tree of tasks. Nothing that grows with the
rows reaches the driver.

Defined results: rows whose vector is null or empty or holds null or non-finite entries are left out. Vectors of different
lengths have nothing in common: each length is fitted by itself. Components without variance (an eigenvalue under VANISHING of the
trace) can't be scaled to one and have no rows, so there may be fewer than asked for, and none where all vectors are equal. The
deviation is exact; one that 64 bits don't hold is null. Entries beyond 2**42 count as 2**42. Repeated rows and null ids are rows
like others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.common import saved, table

COMPONENTS, OVERSAMPLE, POWER, SEED = 8, 8, 8, 12
#: Residual of a component over its eigenvalue, and share of the trace below which there is no variance.
TOLERANCE, VANISHING = 1e-12, 1e-12
SCALE, SHIFT, MOST = 1024.0, 100_000, 2.0**52
#: Rows that are multiplied at once, and sums that one task adds at a level of the tree.
ROWS, FAN = 4096, 64
#: Whole numbers are summed as x >> HALF and the rest, so that sums of 2**36 rows fit 64 bits.
HALF = 26


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    basis: np.ndarray | None = None
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residual: float = np.inf
    rate: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """Columns that turn a centred row into its whitened components."""
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the whole part goes first, so nothing is rounded twice."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)**2) of each row; None if 64 bits don't hold it."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        if len(x) and ((int(np.abs(x - whole).max()) + 1) * self.n) ** 2 * x.shape[1] < 1 << 63:
            return (((x - whole) * self.n - rest) ** 2).sum(axis=1).tolist()
        found = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in found]


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length in a column of lists without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            yield d, part, values[starts[part][:, None] + np.arange(d)]


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers, of the rows (vec_id, embedding) that take part; written, as passes read them often."""
    # infinity less itself is not a number
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double") - c.cast("double")))
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))
    x = F.transform("embedding", lambda c: F.floor(scaled(c)) + F.lit(SHIFT))
    return saved(rows.where((F.size("embedding") > 0) & fine).select("vec_id", x.alias("x")), "whole-vectors", compression="zstd")


def summed(rows: DataFrame, of: Callable[[int, np.ndarray], np.ndarray], dtype: type = np.float64) -> dict[int, np.ndarray]:
    """The sums of of(length, matrix) over all rows, by length of the vectors. Tasks add up, then a tree of tasks."""
    names, schema = ["d", "sums"], "d int, sums binary"

    def packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names)

    def added(total: dict[int, np.ndarray], d: int, x: np.ndarray) -> None:
        total[d] = total[d] + x if d in total else x

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in vectors(b.column("x")):
                added(total, d, of(d, x).ravel())
        yield packed(total)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in zip(b.column("d").to_pylist(), b.column("sums").to_pylist()):
                added(total, d, np.frombuffer(x, dtype))
        yield packed(total)

    parts = rows.rdd.getNumPartitions()
    level = rows.select("x").mapInArrow(leaf, schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        level = level.repartition(parts).mapInArrow(branch, schema)
    out: dict[int, np.ndarray] = {}
    for r in level.collect():  # FAN rows for each length of vectors
        added(out, r.d, np.frombuffer(r.sums, dtype))
    return out


def counted(rows: DataFrame) -> dict[int, Fit]:
    """n and the sums of each length, exact."""

    def halves(d: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], (x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)))

    found = {d: s.tolist() for d, s in summed(rows, halves, np.int64).items()}
    return {d: Fit(s[0], [(a << HALF) + b for a, b in zip(s[1 : d + 1], s[d + 1 :])]) for d, s in found.items()}


def applied(rows: DataFrame, fits: dict[int, Fit]) -> None:
    """One pass: the covariance applied to each fit's basis (None: the full space), then Rayleigh-Ritz within it."""

    def products(d: int, x: np.ndarray) -> np.ndarray:
        if d not in fits:
            return np.zeros(0)
        c, q = fits[d].centred(x), fits[d].basis
        return np.concatenate(([(c * c).sum()], (c.T @ (c if q is None else c @ q)).ravel()))

    for d, sums in summed(rows, products).items():
        if d not in fits:
            continue
        fit = fits[d]
        q = np.eye(d) if fit.basis is None else fit.basis
        fit.trace, y = sums[0] / fit.n, sums[1:].reshape(d, -1) / fit.n
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:COMPONENTS]
        order = order[values[order] > VANISHING * fit.trace]
        fit.values, fit.vectors = values[order], q @ turn[:, order]
        off = np.linalg.norm(y @ turn[:, order] - fit.vectors * fit.values, axis=0)
        before, fit.residual = fit.residual, float((off / fit.values).max(initial=0.0))
        # a lower rank than the basis shows in a residual of its own
        out = np.linalg.norm(y - q @ inner) / max(fit.trace, np.finfo(float).tiny)
        fit.residual = max(fit.residual, out) if len(order) < min(COMPONENTS, d) else fit.residual
        fit.rate = fit.residual / before if np.isfinite(before) else 0.0
        fit.basis = np.linalg.qr(y)[0]


def fitted(rows: DataFrame, power: int = POWER) -> dict[int, Fit]:
    """The components of the vectors of each length."""
    fits = counted(rows)
    rng = np.random.default_rng(SEED)
    for d in sorted(fits):
        wide = min(d, COMPONENTS + OVERSAMPLE)
        fits[d].basis = None if wide == d else np.linalg.qr(rng.standard_normal((d, wide)))[0]
    for k in range(power):
        # passes still needed at the present rate, if that is known
        left = {d: f for d, f in fits.items() if f.residual > TOLERANCE}
        going = {d: f for d, f in left.items() if not f.rate or f.rate < 1 and np.log(TOLERANCE / f.residual) / np.log(f.rate) <= power - k}
        if not going:
            break
        applied(rows, going)
    failed = {d: f for d, f in fits.items() if f.residual > TOLERANCE}
    for f in failed.values():
        f.basis = None
    if failed:
        applied(rows, failed)
    for f in fits.values():
        # either sign is right: the largest entry is positive
        f.vectors = f.vectors * np.sign(f.vectors[np.abs(f.vectors).argmax(axis=0), np.arange(len(f.values))]) if len(f.values) else f.vectors
    return fits


def identity_error(rows: DataFrame, fits: dict[int, Fit]) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all rows."""

    def products(d: int, x: np.ndarray) -> np.ndarray:
        z = fits[d].centred(x) @ fits[d].scales
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    worst = 0.0
    for d, sums in summed(rows, products).items():
        k, n = len(fits[d].values), fits[d].n
        mean = sums[:k] / n
        cov = sums[k:].reshape(k, k) / n - np.outer(mean, mean)
        worst = max(worst, float(np.abs(cov - np.eye(k)).max(initial=0.0)))
    return worst


def whitened(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of the rows (vec_id, embedding)."""
    x = quantised(rows)
    fits = fitted(x)
    error = identity_error(x, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, v in vectors(b.column("x")):
                fit = fits[d]
                k = len(fit.values)
                if not k:
                    continue
                z = fit.centred(v) @ fit.scales
                each = np.repeat(np.arange(len(at)), k)
                columns = [
                    b.column("vec_id").take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), fit.n)),
                    pa.array(fit.deviations(v), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(fit.values / fit.trace, len(at))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return x.mapInArrow(run, OUT)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
