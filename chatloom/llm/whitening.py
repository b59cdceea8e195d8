"""Whitening of embeddings on leading principal components found by spectrum slicing.

Entries become whole numbers, ``floor(SCALE * c) + OFFSET``. Sums and, after centring on the rounded mean, products
are added up exactly, as whole numbers: a few thousand of them per task, whatever the number of rows. The
covariance is their exact fraction, rounded once, so it does not depend on how rows are dealt out or on lost tasks.
The eigenpairs of that one d x d matrix are found on the driver by ``spectrum_slicing``; rows are projected where
they are.

Rows whose vector is null or empty, or holds null or non-finite entries, are left out; all other rows stay, repeated
ones and those without an id too. Vectors of different lengths are an error. An empty table, or one without usable
vectors, gives no rows. A component without variance has null for ``whitened`` and is not part of
``identity_error``. ``deviation`` is null beyond 64 bits, ``deviation_exact`` holds it up to 38 digits. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import stored
from chatloom.llm.spectrum_slicing import EPS, leading_eigenpairs

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Whole numbers up to here are exact as doubles, and so are their sums.
EXACT = 1 << 53
SUMS = "i int, j int, total decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """What is known of the fitted rows; all of it is as small as d x d numbers."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The means as nearest whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """Sums of the rows after taking off the centre."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]

    @property
    def explained(self) -> np.ndarray:
        trace = np.trace(self.covariance)
        return self.values / trace if trace > 0 else np.zeros(len(self.values))

    @property
    def varied(self) -> np.ndarray:
        """Components that have variance beyond rounding."""
        return self.values > len(self.sums) * EPS * max(float(np.trace(self.covariance)), 0.0)


def whole_numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and their entries as whole numbers, a row each."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
    usable = sizes > 0
    usable[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]] = False
    width = sizes[usable]
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors of different lengths")
    entries = np.floor(SCALE * flat[np.repeat(usable, sizes)])
    if len(entries) and np.abs(entries).max() >= 1 << 62:
        raise ValueError("an entry is too large for a 64-bit whole number")
    return usable, entries.astype(np.int64).reshape(len(width), int(width[0]) if len(width) else 0) + OFFSET


def _columns(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _added(rows: DataFrame, totals: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], int]:
    """Exact sums of ``totals(x)`` over all rows by place; tasks send one number per place.

    What is one-dimensional has its length for ``i``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, x = whole_numbers(batch.column(1))
            if not len(x):
                continue
            new = totals(x)
            if held is not None and held.shape != new.shape:
                raise ValueError("vectors of different lengths")
            held = new if held is None else held + new
        if held is not None:
            i, j = np.nonzero(np.ones(held.shape)) if held.ndim == 2 else (np.full(len(held), len(held)), np.arange(len(held)))
            kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0)]
            columns = [i.tolist(), j.tolist(), [Decimal(int(v)) for v in held.ravel()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "total"])

    summed = rows.mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r.i, r.j): int(r.total) for r in summed.collect()}  # d x d numbers at most


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products, as Python's whole numbers."""
    most = int(np.abs(y).max(initial=1)) or 1
    step = EXACT // (most * most)
    if not step:
        y = y.astype(object)
        return y.T @ y
    out = np.zeros((y.shape[1],) * 2, object)
    for start in range(0, len(y), step):
        part = y[start : start + step].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Covariance of all usable rows and its leading eigenpairs; None where no row is usable."""
    rows = _columns(rows, id_col, vector_col)
    # numbers of one batch are added as Python's own, so nothing overflows; the last place counts the rows
    found = _added(rows, lambda x: np.r_[x.astype(object).sum(axis=0), len(x)])
    if not found:
        return None
    if len({size for size, _ in found}) > 1:
        raise ValueError("vectors of different lengths")
    d = len(found) - 1
    n, sums = found[d + 1, d], tuple(found[d + 1, j] for j in range(d))
    blank = Whitening(n, sums, np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))
    centre, rest = blank.centre, blank.rest
    products = _added(rows, lambda x: _products(x - centre))
    covariance = np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    return Whitening(n, sums, covariance, *leading_eigenpairs(covariance, components))


def project(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, deviation_exact, whitened``: one row per usable vector, null for components without variance."""
    centre, rest, n = model.centre, model.rest, model.n
    scaled = model.vectors / np.sqrt(np.where(model.varied, model.values, np.nan))
    off = np.array([r / n for r in rest])
    limit = max(map(abs, rest), default=0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = whole_numbers(batch.column(1))
            if not len(x):
                continue
            y = x - centre
            most = n * int(np.abs(y).max()) + limit
            if most * most * y.shape[1] < 1 << 63:
                gaps = (n * y - np.array(rest, np.int64)) ** 2
            else:
                gaps = (n * y.astype(object) - np.array(rest, object)) ** 2
            deviation = [Decimal(int(v)) for v in gaps.sum(axis=1)]
            white = (y - off) @ scaled
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * white.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(usable)), pa.array(deviation, pa.decimal128(38, 0)), lists],
                names=["vec_id", "deviation_exact", "whitened"],
            )

    return _columns(rows, id_col, vector_col).mapInArrow(run, "vec_id bigint, deviation_exact decimal(38,0), whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; means are taken off before multiplying."""
    used = np.flatnonzero(model.varied).tolist()
    if not used:
        return 0.0
    at = lambda k: F.get("whitened", F.lit(k))
    means = projected.agg(*[F.avg(at(k)).alias(f"m{k}") for k in used]).first()
    pairs = [(a, b) for n, a in enumerate(used) for b in used[n:]]
    products = projected.agg(*[F.avg((at(a) - means[f"m{a}"]) * (at(b) - means[f"m{b}"])) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, products))


def whitened_embeddings(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` per row and component."""
    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = fit_whitening(rows, components, id_col, vector_col)
    if model is None:
        return rows.sparkSession.createDataFrame([], kinds)
    projected = stored(project(rows, model, id_col, vector_col), "whitened")
    error = identity_error(projected, model)
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    long = projected.select("vec_id", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation_exact").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
        "deviation_exact",
    )
