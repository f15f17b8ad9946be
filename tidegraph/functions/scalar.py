"""Scalar functions as column expressions: wrapping 64-bit hashing and small linear algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the 64-bit integer hash, in the order of its steps.
HASH_STEPS = [
    ("+", 0x7ED55D166BEF7A1D, "+", 12), ("^", 0xC761C23C510FA2DD, "^", -9), ("+", 0x165667B183A9C0E1, "+", 59),
    ("+", 0xD3A2646CAB3487E3, "^", 49), ("+", 0xFD7046C5EF9AB54C, "+", 3), ("^", 0xB55A4F090DD4A67B, "^", -32),
]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def wrapping_add(a: Column, b: Column) -> Column:
    """64-bit addition that wraps, in halves, so that ANSI mode has nothing to object to."""
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def with_hash(df: DataFrame, source: Column, name: str) -> DataFrame:
    """Adds the 64-bit hash of a long as ``name``, staged so that no step repeats another."""
    df = df.withColumn(name, source.cast("long"))
    for first, constant, second, shift in HASH_STEPS:
        a, c = F.col(name), F.lit(_signed(constant))
        left = wrapping_add(a, c) if first == "+" else a.bitwiseXOR(c)
        right = F.shiftleft(a, shift) if shift > 0 else F.shiftrightunsigned(a, -shift)
        df = df.withColumns({"_l": left, "_r": right})
        df = df.withColumn(name, wrapping_add(F.col("_l"), F.col("_r")) if second == "+" else F.col("_l").bitwiseXOR(F.col("_r"))).drop("_l", "_r")
    return df


def unsigned_double(a: Column) -> Column:
    """A long read as unsigned, as a double (rounded once)."""
    return F.shiftrightunsigned(a, 32).cast("double") * 4294967296.0 + a.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")


def hash64(values: np.ndarray) -> np.ndarray:
    """The same hash over uint64 arrays."""
    a = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        for first, constant, second, shift in HASH_STEPS:
            c = np.uint64(constant)
            left = a + c if first == "+" else a ^ c
            right = a << np.uint64(shift) if shift > 0 else a >> np.uint64(-shift)
            a = left + right if second == "+" else left ^ right
    return a


def solve2(m00: Column, m01: Column, m11: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """Solution of a symmetric 2x2 system; null where it is singular."""
    det = m00 * m11 - m01 * m01
    return F.try_divide(m11 * b0 - m01 * b1, det), F.try_divide(m00 * b1 - m01 * b0, det)


def matmul(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """Row-major n x k times k x m."""
    return F.array(*[sum((F.get(a, F.lit(i * k + x)) * F.get(b, F.lit(x * m + j)) for x in range(k)), F.lit(0.0)) for i in range(n) for j in range(m)])


def elementwise(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y)


def scaled(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def outer(a: Column, k: int) -> Column:
    """v v' of a k-vector, row-major."""
    return F.array(*[F.get(a, F.lit(i)) * F.get(a, F.lit(j)) for i in range(k) for j in range(k)])


def determinant2(a: Column) -> Column:
    return F.get(a, F.lit(0)) * F.get(a, F.lit(3)) - F.get(a, F.lit(1)) * F.get(a, F.lit(2))


def inverse2(a: Column) -> Column:
    """Inverse of a row-major 2x2 matrix, by its adjoint; null entries where it is singular."""
    d = determinant2(a)
    return F.array(*[F.try_divide(x, d) for x in (F.get(a, F.lit(3)), -F.get(a, F.lit(1)), -F.get(a, F.lit(2)), F.get(a, F.lit(0)))])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse(matrices: pd.Series) -> pd.Series:
    """Inverse of row-major square matrices of any size; null where singular."""

    def one(v):
        a = np.asarray(v, float)
        k = int(len(a) ** 0.5)
        try:
            return np.linalg.inv(a.reshape(k, k)).ravel()
        except np.linalg.LinAlgError:
            return None

    return matrices.map(one, na_action="ignore")
