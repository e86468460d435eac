"""Whitened embeddings: integer vectors, an exact scatter matrix, eigh, and the projection of every row.

Entries are floored to 1/256. Over the distinct vectors, less a shift, sums and cross-products are kept as whole numbers of
any size: tasks multiply 20-bit limbs as floats, which is exact for a few thousand rows, and add them up as Python
integers; Spark sums the 32-bit limbs of the tasks' totals. n X'X - SS' is formed exactly and turned into floats only then.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
LIMB, ROWS = 20, 4_096
#: 32-bit limbs of a total: 192 bits.
PARTS = 6
_WIDTHS = (1, 2, 4, 8)
#: Of whole numbers below this in size, differences and limbs don't overflow.
_SMALL = 1 << 61


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of each length of vectors: floor(256 * entry), without vectors that are null or hold null,
    infinite or not-a-number entries. Values beyond 64 bits become the largest or smallest long."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64(), safe=False)
        c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), d)
        good = np.isfinite(c).all(1)
        y = np.floor(SCALE * np.clip(c[good], -1e300, 1e300))
        x = np.where(np.abs(y) < 2.0**63, y, 0).astype(np.int64)
        x[y >= 2.0**63], x[y < -(2.0**63)] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        yield rows[good], x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """embedding -> d, x: the whole numbers in as few bytes each as the vector needs, so equal vectors are equal bytes."""
    for batch in batches:
        for _, x in vectors(batch.column(0)):
            if not len(x):
                continue
            low, high = x.min(1), x.max(1)
            need = np.select([(low >= -(1 << (8 * w - 1))) & (high < (1 << (8 * w - 1))) for w in _WIDTHS[:-1]], _WIDTHS[:-1], _WIDTHS[-1])
            for w in np.unique(need).tolist():
                part = x[need == w].astype(f"<i{w}")
                size = part.shape[1] * w
                ends = pa.py_buffer((np.arange(len(part) + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x.shape[1], np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(np.ascontiguousarray(part))])], names=["d", "x"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch of (d, x), some thousands of one length and width at a time."""
    d, size = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy()
    for length, bytes_ in np.unique(np.stack([d, size]), axis=1).T.tolist():
        rows = np.flatnonzero((d == length) & (size == bytes_))
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            flat = batch.column(1).take(pa.array(part))
            start = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset]
            yield np.frombuffer(flat.buffers()[2], f"<i{bytes_ // length}", len(part) * length, int(start)).astype(np.int64).reshape(len(part), length)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Floats of which each is below 2**20 in size, and sum(limb << 20 k) is ``y``."""
    out = []
    while True:
        if not len(y) or (y.min() >= -(1 << LIMB) and y.max() < (1 << LIMB)):
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def scatter(x: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of at most ROWS rows of ``x`` less ``shift``, as Python integers."""
    if len(x) and max(abs(int(x.min())), abs(int(x.max())), *(abs(int(v)) for v in shift)) >= _SMALL:
        y = x.astype(object) - shift.astype(object)
        return y.sum(0), y.T @ y
    parts = _limbs(x - shift.astype(np.int64))
    s = sum(p.sum(0).astype(np.int64).astype(object) << (LIMB * k) for k, p in enumerate(parts))
    c = 0
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            # below ROWS * 2**40 = 2**52: no rounding
            c = c + ((p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return s, c


def _totals(shifts: dict[int, list[int]]):
    """d, x -> d, i, j, l0...: the task's sums (i, j: entry, -1), cross-products (i <= j) and number of rows (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for x in _unpacked(batch):
                d = x.shape[1]
                s, c = scatter(x, np.array(shifts[d], object))
                at = totals.setdefault(d, [0, 0, 0])
                at[0], at[1], at[2] = at[0] + len(x), at[1] + s, at[2] + c
        for d, (n, s, c) in totals.items():
            i, j = np.triu_indices(d)
            rows = np.concatenate([[-1], np.arange(d), i]), np.concatenate([np.full(d + 1, -1), j])
            values = np.array([n, *s, *c[i, j]], object)
            limbs = [((values >> (32 * k)) & 0xFFFFFFFF if k < PARTS - 1 else values >> (32 * k)).astype(np.int64) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), d, np.int32)), *(pa.array(r.astype(np.int32)) for r in rows), *map(pa.array, limbs)], names=["d", "i", "j", *(f"l{k}" for k in range(PARTS))])

    return run


class Whitening:
    """Of vectors of one length: n, S, and for each of the first components its unit vector, sqrt(e) and e / trace."""

    def __init__(self, n: int, sums: list[int], moment: list[list[int]], components: int = COMPONENTS):
        """``moment``: n X'X - SS', whole numbers."""
        self.n, self.sums = n, np.array(sums, object)
        v = np.array([[m / (n * n) for m in row] for row in moment], np.float64)
        e, q = np.linalg.eigh(v)
        e, q = e[::-1][:components], q[:, ::-1][:, :components]
        q = q * np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
        # an eigenvalue of zero, to double precision, can't be divided by
        zero = e <= len(v) * np.finfo(float).eps * max(float(e[0]), 0.0)
        self.vectors, self.roots = q, np.where(zero, np.nan, np.sqrt(np.where(zero, 1, e)))
        trace = float(np.trace(v))
        self.explained = np.where(zero, 0.0, e) / trace if trace > 0 else np.full(len(e), np.nan)
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs where they surely fit, else as Python integers."""
        most = self.n * (max(abs(int(x.min())), abs(int(x.max()))) if len(x) else 0) + max(abs(v) for v in self.sums)
        if most < _SMALL:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def deviations(self, z: np.ndarray) -> list[int]:
        if z.dtype == object or not len(z):
            return (z * z).sum(1).tolist()
        if int(np.abs(z).max()) ** 2 * z.shape[1] < 1 << 63:
            return (z * z).sum(1).tolist()
        parts = [p.astype(np.int64) for p in _limbs(z)]
        return sum((p * q).sum(1).astype(object) << (LIMB * (i + j)) for i, p in enumerate(parts) for j, q in enumerate(parts)).tolist()

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / self.n) @ self.vectors / self.roots


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vectors in ``rows``, over the distinct whole-number vectors. What comes to the driver is
    bounded by the lengths d: (d + 1)(d + 2) / 2 totals each."""
    distinct = common.materialize(rows.select(F.col(vector).alias("_v")).mapInArrow(common.lean(_packed), "d int, x binary").distinct(), "whitening-distinct")
    shifts = {}
    for row in distinct.groupBy("d").agg(F.min("x").alias("x")).collect():
        one = next(_unpacked(pa.RecordBatch.from_arrays([pa.array([row.d], pa.int32()), pa.array([bytes(row.x)], pa.binary())], names=["d", "x"])))
        shifts[row.d] = one[0].tolist()
    if not shifts:
        return {}
    names = [f"l{k}" for k in range(PARTS)]
    totals = distinct.mapInArrow(common.lean(_totals(shifts)), "d int, i int, j int, " + ", ".join(f"{c} long" for c in names))
    found: dict[int, dict] = {d: {} for d in shifts}
    for r in totals.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in names)).toLocalIterator():
        found[r.d][r.i, r.j] = sum(r[c] << (32 * k) for k, c in enumerate(names))
    models = {}
    for d, t in found.items():
        n, s = t[-1, -1], [t[i, -1] for i in range(d)]
        moment = [[n * t[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
        models[d] = Whitening(n, [a + n * b for a, b in zip(s, shifts[d], strict=True)], moment, components)
    _measure(distinct, models, components)
    return models


def _measure(distinct: DataFrame, models: dict[int, Whitening], components: int) -> None:
    """The identity error of each model, from the whitened vectors themselves."""
    names = [f"w{k}" for k in range(components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _unpacked(batch):
                model = models[x.shape[1]]
                w = model.whitened(model.centred(x))
                columns = [pa.array(w[:, k], from_pandas=True) if k < w.shape[1] else pa.nulls(len(w), pa.float64()) for k in range(components)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x.shape[1], np.int32)), *columns], names=["d", *names])

    whitened = distinct.mapInArrow(common.lean(run), "d int, " + ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    for r in whitened.groupBy("d").agg(*(F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs)).collect():
        errors = [abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if r[f"c{a}_{b}"] is not None]
        models[r.d].identity_error = max(errors) if errors else None


def _projected(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors(batch.column(1)):
                for k in range(0, len(rows), ROWS):
                    part, model = x[k : k + ROWS], models[x.shape[1]]
                    z, many = model.centred(part), model.vectors.shape[1]
                    deviation = pa.array([Decimal(v) if abs(v) < 10**38 else None for v in model.deviations(z)], pa.decimal128(38, 0))
                    w, again = model.whitened(z), np.repeat(np.arange(len(part)), many)
                    columns = [
                        batch.column(0).take(pa.array(rows[k : k + ROWS][again])), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(part))), pa.array(np.full(len(again), model.n)), deviation.take(pa.array(again)),
                        pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, len(part)), from_pandas=True), pa.array([model.identity_error] * len(again), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and each of the first ``components`` components: key, component, n, deviation, whitened, explained
    and identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out. Repeated rows and vectors are
    returned each, and fitted once. Vectors of different lengths are fitted apart, each by those of its length; a length
    below ``components`` has so many components. Where vectors don't vary in a component's direction (one distinct vector,
    say) whitened is null and explained 0 (null if they don't vary at all); identity_error is then about the others.
    deviation is a decimal of 38 digits, null beyond. Null keys stay. An empty table gives an empty result.
    """
    models = fit(rows, vector, components)
    source = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    out = source.mapInArrow(common.lean(_projected(models)), common.schema(source, "_vector", "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"))
    return out.withColumnRenamed("_key", key)
