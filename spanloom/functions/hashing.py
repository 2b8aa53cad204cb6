"""The family of linear hash functions, whose coefficients come from the C library's generator, and hashes of tokens and arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_HASH = 2_147_483_647


def glibc_rand(seed: int, n: int) -> list[int]:
    """First n values of rand() after srand(seed), by the additive feedback rule that the GNU C library documents."""
    r = [seed or 1]
    for _ in range(30):
        r.append(16807 * r[-1] % 2_147_483_647)
    r += r[:3]
    out = []
    for i in range(34, 344 + n):
        r.append((r[i - 3] + r[i - 31]) & 0xFFFFFFFF)
        if i >= 344:
            out.append(r[i] >> 1)
    return out


@lru_cache
def coefficients(seed: int) -> tuple[int, int]:
    """(a, b) of one function; a is the first value that isn't 0."""
    values = glibc_rand(seed, 16)
    i = next(i for i, v in enumerate(values) if v)
    return values[i], values[i + 1]


def family(k: int, first_seed: int = 1) -> list[tuple[int, int, int]]:
    """(h, a, b) of k functions; seeds count from first_seed, since 0 and 1 seed alike."""
    return [(h, *coefficients(first_seed + h)) for h in range(k)]


def family_table(spark: SparkSession, k: int, first_seed: int = 1) -> DataFrame:
    return spark.createDataFrame(family(k, first_seed), "h int, a long, b long")


def linear_hash(token: Column, a: Column, b: Column) -> Column:
    """a * token + b in wrapping signed 32 bits; the product of two numbers below 2**31 fits a long."""
    return (F.pmod(a * token.cast("long") + b + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def linear_hash_array(tokens: np.ndarray, a: int, b: int) -> np.ndarray:
    return (tokens.astype(np.int64) * a + b).astype(np.uint32).view(np.int32).astype(np.int64)


def stopword_hash(token: Column, a: Column, b: Column, is_stop: Column) -> Column:
    """A stopword hashes to the greatest value, so it's never the least."""
    return F.when(is_stop, F.lit(STOP_HASH)).otherwise(linear_hash(token, a, b))


def hash_array(tokens: Column, a: int, b: int, stopwords: list[int] | None = None) -> Column:
    """The hashes of an array column, with the same length."""
    stop = (lambda x: x.isin(stopwords)) if stopwords else (lambda x: F.lit(False))
    return F.transform(tokens, lambda x: stopword_hash(x, F.lit(a), F.lit(b), stop(x)))


_LOW32 = 0xFFFFFFFF


def _mixed32(x: Column) -> Column:
    """One mixing step in wrapping signed 32 bits."""
    y = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(_LOW32))
    return F.when(y >= 1 << 31, y - F.lit(1 << 32)).otherwise(y)


def _sum64(a: Column, b: Column) -> Column:
    """a + b in wrapping 64 bits, by halves: a plain sum raises an error where it overflows."""
    low = a.bitwiseAND(F.lit(_LOW32)) + b.bitwiseAND(F.lit(_LOW32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW32)))


def sequence_hash(tokens: Column | str) -> Column:
    """One 64-bit number for each integer array: mixes of its values folded into a running seed, starting at its length. Null arrays have none."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    # step by step, so that no expression holds another more than a few times
    x = F.transform(tokens, lambda v: v.cast("long"))
    for _ in range(2):
        x = F.transform(x, _mixed32)
    x = F.transform(x, lambda v: (F.shiftright(v, 16).bitwiseXOR(v) + F.lit(0x9E3779B9)).bitwiseAND(F.lit(_LOW32)))
    return F.aggregate(x, F.size(tokens).cast("long"), lambda seed, v: seed.bitwiseXOR(_sum64(_sum64(v, F.shiftleft(seed, 6)), F.shiftrightunsigned(seed, 2))))
