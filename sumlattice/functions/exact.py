"""Whole-number sums that hold at any count: exact decimals in plans, two limbs on arrays.

Classes of up to 2^62 rows are counted by longs.  Twice the pairs of two classes, 2 P N, is below
10^38 then, which a decimal of 38 digits holds; squares of pairs aren't, so plans add them up in parts
of 32 bits, and the parts meet as Python's integers, once for each candidate.

Weights of rows can make larger classes.  Those are counted by decimals ("wide" counts), up to
10^27, and products of such counts are added up by limbs of nine digits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a class up to which counts, doubled, are longs.
MOST = 2**62
_LOW = 0xFFFFFFFF
#: Wide counts: base and number of their limbs, rows of a class that they hold, and their type.
LIMB, LIMBS = 10**9, 3
WIDEST = LIMB**LIMBS
WIDE = "decimal(38,0)"


def is_wide(counts: DataFrame) -> bool:
    """Whether a table's p and n are decimals instead of longs."""
    return isinstance(counts.schema["p"].dataType, T.DecimalType)


def limbs(c: Column) -> list[Column]:
    """A count up to twice WIDEST by limbs, least first."""
    cut = lambda v: F.call_function("div", v, F.lit(LIMB)).cast("decimal(20,0)")
    low, rest = [], c
    for _ in range(LIMBS - 1):
        low.append((rest % F.lit(LIMB)).cast("decimal(10,0)"))
        rest = cut(rest)
    return [*low, rest.cast("decimal(10,0)")]


def limb_products(*factors: Column) -> list[Column]:
    """Sums of the product of two or three wide counts by places of LIMB, least first."""
    product = lambda a, b: [reduce(lambda x, y: x + y, (a[i] * b[k - i] for i in range(len(a)) if 0 <= k - i < len(b))) for k in range(len(a) + len(b) - 1)]
    return [total(c) for c in reduce(product, map(limbs, factors))]


def limb_double(parts: list[Column]) -> Column:
    """What such sums make together as its nearest double: their places are carried and read as one number."""
    digits, carry = [], F.lit(0).cast(WIDE)
    for part in parts:
        own = part + carry
        digits.append(F.lpad((own % F.lit(LIMB)).cast("decimal(10,0)").cast("string"), 9, "0"))
        carry = F.call_function("div", own, F.lit(LIMB)).cast(WIDE)
    return F.concat(carry.cast("string"), *reversed(digits)).cast("double")


def join_limbs(parts: list[np.ndarray]) -> np.ndarray:
    """The number of which these are the places, least first, as Python's integers; longs where there is one place only."""
    return parts[0] if len(parts) == 1 else sum(v.astype(object) * LIMB**i for i, v in enumerate(parts))


def wide(c: Column) -> Column:
    """A long as a decimal whose product with another such has 38 digits and no fraction."""
    return c.cast("decimal(20,0)")


def total(product: Column) -> Column:
    """The sum of products of wide numbers; one that doesn't fit is an error, never a wrong number."""
    return F.sum(product.cast("decimal(38,0)"))


def square_parts(weight: Column, value: Column) -> list[Column]:
    """Sums of weight * value^2 in three parts, those of 2^64, 2^33 and 1, for values below 2^63."""
    high, low = F.shiftright(value, 32), value.bitwiseAND(F.lit(_LOW))
    return [total(wide(weight) * wide(high * high)), total(wide(weight) * wide(high * low)), total(wide(weight) * (wide(low) * wide(low)).cast("decimal(20,0)"))]


def join_parts(high: np.ndarray, middle: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sums that ``square_parts`` were cut into, as Python's integers."""
    return (high << 64) + (middle << 33) + low


def integers(values: list) -> np.ndarray:
    """Decimals or longs as an array of Python's integers."""
    out = np.empty(len(values), object)
    out[:] = [int(v) for v in values]
    return out


def doubles(values: np.ndarray) -> np.ndarray:
    """Each integer as its nearest double."""
    return np.array([float(v) for v in values]) if values.dtype == object else values.astype(float)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row sums of a * b for matrices of longs, none negative: longs where no sum can overflow, else Python's integers.

    Numbers are cut in halves of 32 bits; halves of the four products are added up by their
    weight, in which columns can't overflow before there are 2^30 of them.
    """
    if a.dtype == object or b.dtype == object:
        return (a * b).sum(1)
    if int(a.sum(1).max(initial=0)) * int(b.max(initial=0)) < 2**63:
        return (a * b).sum(1)
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    half, mask = np.uint64(32), np.uint64(_LOW)
    (a1, a0), (b1, b0) = ((x >> half, x & mask) for x in (a, b))
    parts = [np.zeros(len(a), np.uint64) for _ in range(4)]
    for x, y, place in ((a0, b0, 0), (a0, b1, 1), (a1, b0, 1), (a1, b1, 2)):
        product = x * y
        parts[place] += (product & mask).sum(1)
        parts[place + 1] += (product >> half).sum(1)
    return sum(p.astype(object) << (32 * i) for i, p in enumerate(parts))


def bincount(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums of long weights for each place, exact: a weight's low 31 bits and the rest are added up apart."""
    if int(weights.sum(dtype=float)) < 2**52:  # then doubles are exact
        return np.bincount(at, weights.astype(float), size).astype(np.int64)
    low = np.bincount(at, (weights & 0x7FFFFFFF).astype(float), size).astype(np.int64)
    return (np.bincount(at, (weights >> 31).astype(float), size).astype(np.int64) << 31) + low
