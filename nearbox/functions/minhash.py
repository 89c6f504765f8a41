"""MinHash signatures and banding.

A token's hash is its SHA-1 modulo p = 2**61 - 1; permutation i maps it to (a_i * h + b_i) mod p, where product and sum
wrap in 64 bits. A signature is the least value for each permutation; no tokens give p throughout. The signature is
computed a row at a time in Arrow batches, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearbox.functions.text import MERSENNE


@lru_cache(maxsize=8)
def permutations(num_perm: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """a and b, from numpy's legacy generator."""
    rng = np.random.RandomState(seed)
    return rng.randint(1, MERSENNE, size=num_perm, dtype=np.int64), rng.randint(0, MERSENNE, size=num_perm, dtype=np.int64)


@lru_cache(maxsize=1 << 16)
def hashed(token: str) -> int:
    return int(hashlib.sha1(token.encode()).hexdigest(), 16) % MERSENNE


def signature_of(tokens, num_perm: int = 128, seed: int = 42) -> np.ndarray:
    if tokens is None or not len(tokens):
        return np.full(num_perm, MERSENNE, np.int64)
    a, b = permutations(num_perm, seed)
    h = np.array([hashed(t) for t in tokens], np.int64)
    with np.errstate(over="ignore"):
        return ((a[:, None] * h + b[:, None]) % np.int64(MERSENNE)).min(1)


def with_signature(df: DataFrame, tokens: str = "tokens", num_perm: int = 128, seed: int = 42) -> DataFrame:
    """df and a column signature of the token arrays in a column."""
    at = df.columns.index(tokens)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = [signature_of(t, num_perm, seed) for t in b.column(at).to_pylist()]
            flat = pa.array(np.concatenate(signed) if signed else np.zeros(0, np.int64), pa.int64())
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(signed) + 1, dtype=np.int32) * num_perm), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "signature"])

    return df.mapInArrow(sign, T.StructType([*df.schema.fields, T.StructField("signature", T.ArrayType(T.LongType()))]))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def best_bands(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows whose threshold (1/b)**(1/r) is nearest; the fewest bands of equals."""
    divisors = [b for b in range(1, num_perm + 1) if num_perm % b == 0]
    b = min(divisors, key=lambda b: abs((1 / b) ** (b / num_perm) - threshold))
    return b, num_perm // b


def bands(sig: Column, b: int, r: int) -> Column:
    """An array of structs (band, band_key), for explode or inline."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.slice(sig, i * r + 1, F.lit(r)).alias("band_key")))
