"""Embedding whitening by polarisation: covariances from the exact variances of dimensions and their sums.

Entries become whole numbers x; with n vectors and sums S, n * x - S is the centred entry, exactly. Tasks
sum its squares, and those of the sum of every two dimensions; (V[i+j] - V[i] - V[j]) / 2 is the
covariance of i and j. All sums are whole numbers of any size, kept in limbs of 62 bits, so partial sums
merge in any order without rounding. Only the sums (a row per pair of dimensions) reach the driver.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._spark import attach, materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Limbs of 62 bits: sums stay below 2^372.
LIMBS, LIMB = 6, 62
#: Components with less than this share of the greatest eigenvalue have no direction of their own.
LEAST = 1e-12


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the rows whose vector takes part."""
    scaled = lambda c: c.cast("double") * SCALE
    # false for NaN, infinities and values beyond a long; null entries make it null
    fine = F.coalesce(F.forall("embedding", lambda c: F.coalesce(F.abs(scaled(c)) < float(1 << 62), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))), F.lit(False))
    good = rows.select("vec_id", "embedding").where(fine & (F.size("embedding") > 0))
    return good.select("vec_id", F.transform("embedding", lambda c: F.floor(scaled(c)).cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


def _limbs(value: int) -> list[int]:
    return [value >> (LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS)]


def _summed(partial: DataFrame, *keys: str) -> dict[tuple, int]:
    """The sums of limb columns by key, as whole numbers."""
    sums = partial.groupBy(*keys).agg(*[F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)]).collect()
    return {tuple(r[k] for k in keys): sum(int(r[f"l{k}"]) << (LIMB * k) for k in range(LIMBS)) for r in sums}


_LIMB_SCHEMA = ", ".join(f"l{k} long" for k in range(LIMBS))


def _limb_batch(keys: dict[str, np.ndarray], values: list[int]) -> pa.RecordBatch:
    limbs = np.array([_limbs(v) for v in values], np.int64).reshape(-1, LIMBS)
    return pa.RecordBatch.from_arrays([*map(pa.array, keys.values()), *[pa.array(limbs[:, k]) for k in range(LIMBS)]], [*keys, *[f"l{k}" for k in range(LIMBS)]])


def dimension_sums(fit: DataFrame, dim: int) -> list[int]:
    """The exact sum of x of each dimension."""

    def run(batches):
        total = [0] * dim
        for batch in batches:
            x = _matrix(batch, dim)
            high, low = (x >> 31).sum(axis=0), (x & ((1 << 31) - 1)).sum(axis=0)
            total = [t + (int(h) << 31) + int(b) for t, h, b in zip(total, high, low)]
        # x may be negative: its sum is kept as a sign and a size
        for sign in (1, -1):
            yield _limb_batch({"i": np.arange(dim, dtype=np.int32), "sign": np.full(dim, sign, np.int32)}, [max(sign * t, 0) for t in total])

    sums = _summed(fit.select("x").mapInArrow(run, f"i int, sign int, {_LIMB_SCHEMA}"), "i", "sign")
    return [sums.get((i, 1), 0) - sums.get((i, -1), 0) for i in range(dim)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they hold it, else Python's."""
    if n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(t: np.ndarray) -> list[int]:
    """The exact sum of squares of each column.

    Integer sums are right in their low 64 bits whatever their size, and sums in doubles to within 2^63
    as long as they stay below 2^90: together they give all bits. Larger values are Python's integers.
    """
    if t.dtype == object:
        return [int(v) for v in (t * t).sum(axis=0)] if len(t) else [0] * t.shape[1]
    real = t.astype(float)
    about = np.einsum("ij,ij->j", real, real)
    if about.max(initial=0) >= 2.0**90:
        return squares(t.astype(object))
    wrapped = t.view(np.uint64)
    low = np.einsum("ij,ij->j", wrapped, wrapped).tolist()
    return [b + (round((int(a) - b) / (1 << 64)) << 64) for a, b in zip(about.tolist(), low)]


def pair_variances(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """(i, i): sum of squares of centred dimension i; (i, j), i < j: of the sum of dimensions i and j. Exact."""
    dim = len(sums)
    i, j = np.triu_indices(dim)

    def run(batches):
        total = [0] * len(i)
        for batch in batches:
            y = centred(_matrix(batch, dim), n, sums)
            part = []
            for a in range(dim):
                part += squares(y[:, a : a + 1])
                if a + 1 < dim:
                    part += squares(y[:, a : a + 1] + y[:, a + 1 :])
            total = [s + p for s, p in zip(total, part)]
        yield _limb_batch({"i": i.astype(np.int32), "j": j.astype(np.int32)}, total)

    return _summed(fit.select("x").mapInArrow(run, f"i int, j int, {_LIMB_SCHEMA}"), "i", "j")


def covariance(variances: dict[tuple[int, int], int], n: int, dim: int) -> np.ndarray:
    """The covariance matrix of x, each entry rounded once."""
    out = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            twice = variances[i, j] - variances[i, i] - variances[j, j] if i != j else 2 * variances[i, i]
            out[i, j] = out[j, i] = float(Fraction(twice, 2 * n**3))
    return out


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part.

    A row takes part if its vector is not null or empty and holds neither null nor non-finite entries
    (nor entries of 2^56 and more, which are no longs) and has the commonest length (ties: the least; in
    a whole table all have it). Equal x vectors are fitted once, but each row has its result, whatever
    its vec_id (null and repeated ones included). A component without variance (constant dimensions, too
    few vectors) has null for whitened. deviation is null where it exceeds a long (from some 10^7
    distinct vectors on). An empty table gives an empty result; other columns are not read.
    """
    attach(rows.sparkSession)
    x = materialize(whole_vectors(rows), "whole-vectors")
    common = x.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = common.n
    x = x.where(F.size("x") == dim)
    fit = materialize(x.select("x").groupBy("x").agg(F.lit(1)).select("x"), "fit-list")
    n = fit.count()
    sums = dimension_sums(fit, dim)
    v = covariance(pair_variances(fit, n, sums), n, dim)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    has = values > LEAST * max(values[0], 0.0) if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    scaled = axes[:, has] / np.sqrt(values[has])
    trace, kept = float(np.trace(v)), int(has.sum())
    # The covariance of the whitened fit list, whose mean is zero since n * x - S sums to zero.
    i, j = np.triu_indices(kept)

    def products(batches):
        total = np.zeros(len(i))
        for batch in batches:
            w = (centred(_matrix(batch, dim), n, sums) / n).astype(float) @ scaled
            total += (w.T @ w)[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total)], ["i", "j", "s"])

    measured = fit.select("x").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect() if kept else []
    error = max((abs(r.s / n - (r.i == r.j)) for r in measured), default=0.0)
    explained = [float(e) / trace if trace > 0 else None for e in values]

    def project(batches):
        for batch in batches:
            y = centred(_matrix(batch, dim), n, sums)
            deviation = [s if s < 1 << 63 else None for s in squares(np.ascontiguousarray(y.T))]
            w, m = (y / n).astype(float) @ scaled, len(values)
            whitened = np.full((len(y), m), np.nan)
            whitened[:, has] = w
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(y)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(y))), pa.array(np.full(len(y) * m, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), m))), pa.array(whitened.ravel(), from_pandas=True), pa.array(explained * len(y), pa.float64()), pa.array(np.full(len(y) * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)
