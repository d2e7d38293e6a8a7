"""Whitening of embeddings with exact sums, by digit-slice products.

An entry c is the whole number x = floor(64 c) + 1000000 (held within 2^62). Entries are centred before they are
multiplied: u = x - m with m the floor of the mean, which is exact. A block of u is split into balanced digits of
DIGIT bits; the product of two digit slices in float64 is exact, since DIGIT-bit digits over BLOCK rows stay
below 2^53 in every sum; digit products of one weight are added as 64-bit integers and carried, so that a task
holds its sums of u u' as big integers in base 2^DIGIT. Spark merges the digits of tasks by sums, the driver
carries once more and has G = sum of u u' and R = sum of u as exact integers, so that the covariance
V = (n G - R R') / n^2 is exact, too; each entry is rounded once, to double, and V is decomposed.

What goes to the driver is d (d + 1) / 2 sums for vectors of d entries, whatever their number.

The fit list is all rows whose vector isn't null, isn't empty and has no null or non-finite entry. Its dimension
is the commonest length (of equally common ones the largest); vectors of other lengths are left out like null
ones. Null and repeated ids are rows like others, equal vectors count as often as they occur, and equal
eigenvalues stay in the order in which the decomposition gives them. Without rows the result is empty. A
component whose eigenvalue is 0 to double precision (1e-13 of the largest) has whitened 0, and the identity
error is then 1 by its definition. ``deviation`` is an exact decimal text, as it has no bound; the query gives it
as long, null beyond that range. Carried columns travel in one struct, so no name clashes with what tasks use;
one that is called like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strata.llm.common import bounded_batches, table

SCALE, SHIFT = 64.0, 1_000_000
#: Bits of a digit and rows of a block: 2 * (DIGIT - 1) + log2(BLOCK) stays within 53.
DIGIT, BLOCK = 18, 1 << 16
COMPONENTS = 32
#: Entries of one block of rows that are worked on at once.
CELLS = 1 << 20
#: Eigenvalues below this share of the largest are 0.
LEAST = 1e-13
_HALF, _MASK = 1 << (DIGIT - 1), (1 << DIGIT) - 1
RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def slices(u: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of 64-bit integers, the lowest first: u = sum of digit[i] * 2^(DIGIT i)."""
    out = []
    while not out or u.any():
        s = ((u + _HALF) & _MASK) - _HALF
        out.append(s)
        u = (u - s) >> DIGIT
    return out


def carried(sums: list[np.ndarray]) -> list[np.ndarray]:
    """The same big integers with balanced digits: what is over goes to the next one."""
    out, over, k = [], np.zeros_like(sums[0]), 0
    while k < len(sums) or over.any():
        value = over + sums[k] if k < len(sums) else over
        s = ((value + _HALF) & _MASK) - _HALF
        out.append(s)
        over, k = (value - s) >> DIGIT, k + 1
    return out


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two big integers by digits."""
    if len(a) < len(b):
        a, b = b, a
    return carried([x + b[k] if k < len(b) else x for k, x in enumerate(a)])


def products(u: np.ndarray) -> list[np.ndarray]:
    """u' u of (rows, d) integers as digits of big integers: exact float64 products of digit slices."""
    parts = [s.astype(np.float64) for s in slices(u)]
    total = [np.zeros((u.shape[1], u.shape[1]), dtype=np.int64) for _ in range(2 * len(parts) - 1)]
    for i, a in enumerate(parts):
        for j in range(i + 1):
            g = (a.T @ parts[j]).astype(np.int64)
            total[i + j] += g if i == j else g + g.T
    return carried(total)


def big(digits: dict[int, int]) -> int:
    return sum(v << (DIGIT * k) for k, v in digits.items())


def integers(vectors: np.ndarray) -> np.ndarray:
    """x of each entry, as double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their x) with CELLS entries or BLOCK rows at most."""
    rows = max(1, min(BLOCK, CELLS // max(d, 1)))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, integers(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def _sums(df: DataFrame, run) -> dict[int, int]:
    """Exact sums that tasks give as (cell, digit, value): value times 2^(DIGIT digit)."""
    found: dict[int, dict[int, int]] = {}
    for r in df.mapInArrow(run, "cell long, digit int, value long").groupBy("cell", "digit").agg(F.sum("value").alias("v")).collect():
        found.setdefault(r["cell"], {})[r["digit"]] = r["v"]
    return {cell: big(digits) for cell, digits in found.items()}


def _emitted(digits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, value in enumerate(digits):
        cells = np.flatnonzero(value)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), k, dtype=np.int32)), pa.array(value[cells])], ["cell", "digit", "value"])


@dataclass
class Whitening:
    """What a fit knows. ``mean`` is the floor of the mean, ``rest`` = sum of u, so the mean is mean + rest / n."""

    n: int
    mean: np.ndarray
    rest: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (d, components), unit columns
    explained: np.ndarray

    @property
    def scaled(self) -> np.ndarray:
        live = self.values > LEAST * max(self.values.max(initial=0.0), 0.0)
        return self.vectors * np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.scaled


def usable(vectors: DataFrame, column: str, carry: list[str]) -> tuple[DataFrame, int]:
    """(carried, vector) of the rows of the fit list, and the dimension."""
    good = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    rows = good.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"), F.col(column).cast("array<double>").alias("vector"))
    top = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.where(F.size("vector") == d), d


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Two passes over ``rows`` (carried, vector): sums of x, then products of what is centred."""
    rows = rows.select("vector")
    n = rows.count()
    if not n:
        return None

    def sums(batches):
        total = [np.zeros(d, dtype=np.int64)]
        for _, x in blocks(batches, d):
            total = added(total, carried([s.sum(axis=0) for s in slices(x)]))
        yield from _emitted(total)

    found = _sums(rows, sums)
    s = [found.get(k, 0) for k in range(d)]
    mean = np.array([v // n for v in s], dtype=np.int64)
    rest = [v - n * int(m) for v, m in zip(s, mean, strict=True)]
    upper = np.triu_indices(d)

    def grams(batches):
        total = [np.zeros((d, d), dtype=np.int64)]
        for _, x in blocks(batches, d):
            total = added(total, products(x - mean))
        yield from _emitted([t[upper] for t in total])

    found = _sums(rows, grams)
    v = np.zeros((d, d))
    trace = Fraction(0)
    for cell, (i, j) in enumerate(zip(*(a.tolist() for a in upper), strict=True)):
        exact = Fraction(n * found.get(cell, 0) - rest[i] * rest[j], n * n)
        v[i, j] = v[j, i] = float(exact)
        trace += exact if i == j else 0
    values, basis = np.linalg.eigh(v)
    k = min(components, d)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    # one sign for all rows: the largest entry of a component is positive
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    values = np.maximum(values, 0.0)
    return Whitening(n, mean, rest, values, basis, values / float(trace) if trace else np.zeros(k))


def deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """Exact sum over dimensions of (n x - S)^2 = n^2 u.u - 2 n u.R + R.R for each row."""
    parts, rest = slices(x - w.mean), slices(np.array(w.rest, dtype=np.int64))

    def dot(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        out = 0
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                out = out + ((p * q).sum(axis=1).astype(object) << (DIGIT * (i + j)))
        return out

    own = sum(r * r for r in w.rest)
    return list(w.n * w.n * dot(parts, parts) - 2 * w.n * dot(parts, rest) + own)


def identity_error(rows: DataFrame, d: int, w: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    k = w.scaled.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        total, m = np.zeros((k + 1, k)), sent.value
        for _, x in blocks(batches, d):
            z = m.whitened(x)
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    found = rows.select("vector").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["cell"]] = r["v"]
    total = total.reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of the fit list and component: the carried columns (all others, unless named),
    component int, n long, deviation string, whitened double, explained double, identity_error double."""
    spark = vectors.sparkSession
    carry = [c for c in (carry if carry is not None else [c for c in vectors.columns if c != column]) if c not in RESULT]
    bounded_batches(spark)
    rows, d = usable(vectors, column, carry)
    w = fit(rows, d, components)
    names = [F.col(f"carried.`{c}`") for c in carry]
    if w is None:
        none = {"component": "int", "n": "long", "deviation": "string", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.where("false").select(*names, *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    error, sent = identity_error(rows, d, w), spark.sparkContext.broadcast(w)

    def run(batches):
        m = sent.value
        for part, x in blocks(batches, d):
            z = m.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("carried"), pa.array([str(v) for v in deviations(x, m)], pa.string()), lists], ["carried", "deviation", "z"])

    out = rows.mapInArrow(run, rows.select("carried").schema.add("deviation", "string").add("z", ArrayType(DoubleType())))
    share = F.array(*(F.lit(float(v)) for v in w.explained))
    out = out.select("carried", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(*names, (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)")).select("vec_id", *RESULT)
