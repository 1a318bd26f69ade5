"""Embedding whitening from a bit-sliced scatter matrix.

1. Every entry ``c`` becomes the integer ``x = floor(1024 c) + 100000``.  One
   native aggregate gives the number of vectors and the range of ``x``.
2. Cross-products: ``x`` is shifted by its least value, so that few bits are left.
   Each bit plane of each dimension is packed over the rows into 64-bit words; the
   popcount of two planes' AND, weighted by both bits' values, summed over all
   planes, is the exact sum of products of two dimensions.  A task sends one row
   for each pair of dimensions, cut in limbs of 60 bits that sum exactly at any
   number of rows.
3. The scatter matrix is centred as integers (``n * sum(x y) - sum(x) sum(y)``),
   divided once and handed to ``eigh``: D x D numbers on the driver, whatever the
   number of rows.
4. Vectors are centred and projected; the covariance of the results is measured
   over all rows.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite
entry are dropped; null ids stay; repeated rows count each; an empty table gives
no rows; vectors of different lengths, or entries beyond a long, raise; other
columns are kept out.  Components with less than ``LEAST`` of the largest
eigenvalue (constant or dependent dimensions, a single vector) have no whitened
value and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skein.session import write_shared

SCALE, SHIFT = 1024, 100_000
#: components returned
TOP = 8
#: least eigenvalue, as a share of the largest
LEAST = 1e-11
#: rows packed at once
_ROWS = 4096
_LIMB = 60


def usable(vector: Column) -> Column:
    """True for a vector of finite entries."""
    c = vector.cast("array<double>")
    return F.coalesce((F.size(c) > 0) & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))


def whole(vector: Column) -> Column:
    """The vector's entries as integers."""
    return F.transform(vector.cast("array<double>"),
                       lambda e: F.floor(e * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))


@dataclass
class Fit:
    """What the fit list gives: exact counts and the components."""

    n: int
    sums: list[int]
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # unit eigenvectors, a column each
    trace: float


# --- the scatter matrix -----------------------------------------------------------

def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative ``u`` (rows x dimensions), packed over rows:
    dimensions x bits x words."""
    rows, dims = u.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = u
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        one = (padded >> b & 1).astype(np.uint8)
        out[:, b] = np.packbits(np.ascontiguousarray(one.T), axis=1).view(np.uint64)
    return out


def scatter(u: np.ndarray, bits: int) -> np.ndarray:
    """Exact sums of products of all pairs of columns of ``u``, by popcounts."""
    packed = planes(u, bits)
    dims, _, words = packed.shape
    # below 2 ** 62 the weighted counts fit 64 bits
    narrow = 2 * bits + len(u).bit_length() <= 62
    kind = np.int64 if narrow else object
    weight = np.array([1 << b for b in range(bits)], kind)
    out = np.zeros((dims, dims), kind)
    for i in range(dims):
        later = packed[i:]
        for a in range(bits):
            counts = np.bitwise_count(later & packed[i, a]).sum(axis=2, dtype=np.int64)
            out[i, i:] += (counts.astype(kind) @ weight) * (1 << a)
    return out


def _partial(rows: DataFrame, low: int, bits: int) -> DataFrame:
    """``i, j, l0, l1, l2``: a task's sum of products of dimensions i <= j of
    ``x - low``, in limbs; ``j = -1``: the plain sum of dimension i."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            u = flat.reshape(batch.num_rows, -1) - low
            for at in range(0, len(u), _ROWS):
                block = u[at:at + _ROWS]
                part = scatter(block, bits).astype(object)
                total = part if total is None else total + part
                ones = block.astype(object).sum(axis=0) if bits > 50 else block.sum(axis=0).astype(object)
                sums = ones if sums is None else sums + ones
        if total is None:
            return
        i, j = np.triu_indices(len(sums))
        values = [*total[i, j], *sums]
        mask = (1 << _LIMB) - 1
        limbs = [pa.array([int(v) >> (_LIMB * k) & mask for v in values], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*i, *range(len(sums))], pa.int32()), pa.array([*j, *[-1] * len(sums)], pa.int32()), *limbs],
            ["i", "j", "l0", "l1", "l2"])
    return rows.select("x").mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long")


def fit(rows: DataFrame) -> Fit | None:
    """The components of ``x`` (arrays of longs); None without rows."""
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("d0"), F.max(F.size("x")).alias("d1"),
                    F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    if not seen["n"]:
        return None
    if seen["d0"] != seen["d1"]:
        raise ValueError(f"vectors of {seen['d0']} and of {seen['d1']} entries cannot be whitened together")
    n, dims, low = seen["n"], seen["d1"], seen["low"]
    bits = max(1, (seen["high"] - low).bit_length())
    if bits > 62:
        raise ValueError("the entries' range is beyond 62 bits")
    limb = [F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(3)]
    found = _partial(rows, low, bits).groupBy("i", "j").agg(*limb).collect()
    sums, products = [0] * dims, {}
    for r in found:
        value = sum(int(r[f"l{k}"]) << (_LIMB * k) for k in range(3))
        if r["j"] < 0:
            sums[r["i"]] = value
        else:
            products[r["i"], r["j"]] = value
    v = np.empty((dims, dims))
    for (i, j), p in products.items():      # the shift leaves the covariance as it is
        v[i, j] = v[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    return Fit(n, [s + n * low for s in sums], values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(v)))


# --- whitening ----------------------------------------------------------------------

def _projected(rows: DataFrame, found: Fit, top: int) -> DataFrame:
    """``id, deviation, w``: the exact distance from the mean and the whitened
    components of each vector."""
    n = found.n
    count = int((found.values[:top] > LEAST * max(found.values[0], 0)).sum())
    axes = found.vectors[:, :count] / np.sqrt(found.values[:count])
    mean = np.array([float(Fraction(s, n)) for s in found.sums])
    kind = rows.schema["id"].dataType
    exact = np.array(found.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = max(n * int(x.max()) - int(exact.min()), int(exact.max()) - n * int(x.min()))
            if max(n * abs(int(x.max())), n * abs(int(x.min())), len(exact) * far * far) < 1 << 62:
                d = n * x - exact.astype(np.int64)
            else:       # Python's integers
                d = n * x.astype(object) - exact
            w = (x - mean) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(v) for v in (d * d).sum(axis=1)]),
                 pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])
    out = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.StringType()),
                        T.StructField("w", T.ArrayType(T.DoubleType()))])
    return rows.select("id", "x").mapInArrow(run, out)


def _error(projected: DataFrame, count: int) -> float:
    """Largest entry of the whitened values' covariance minus the identity."""
    if not count:
        return 0.0
    w = [F.col("w")[k] for k in range(count)]
    means = projected.agg(*[F.avg(c) for c in w]).first()
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    cov = projected.agg(*[F.avg((w[a] - F.lit(means[a])) * (w[b] - F.lit(means[b]))) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for (a, b), c in zip(pairs, cov))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """Per vector and component ``id_col, component, n, deviation`` (a decimal),
    ``whitened, explained, identity_error``."""
    rows = write_shared(vectors.where(usable(F.col(vector)))
                        .select(F.col(id_col).alias("id"), whole(F.col(vector)).alias("x")), "whole")
    found = fit(rows)
    if found is None:
        found = Fit(0, [], np.empty(0), np.empty((0, 0)), 0.0)
        projected = rows.select("id", F.lit("0").alias("deviation"), F.array().cast("array<double>").alias("w"))
        error, count = 0.0, 0
    else:
        projected = write_shared(_projected(rows, found, top), "whitened")
        count = int((found.values[:top] > LEAST * max(found.values[0], 0)).sum())
        error = _error(projected, count)
    shares = [float(e / found.trace) for e in found.values[:count]]
    return (projected.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"),
                    F.lit(found.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
                    "whitened", F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("k"))
                    .alias("explained"), F.lit(error).alias("identity_error")))
