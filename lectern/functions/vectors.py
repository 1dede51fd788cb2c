"""Vector functions as Column -> Column, and the same over Arrow batches for wide scans."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def int8_scale(vector: Column) -> Column:
    """Largest magnitude / 127 in single precision; 0 for a zero vector."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return (largest.cast("float") / F.lit(127.0).cast("float")).cast("float")


def int8_values(vector: Column) -> Column:
    """Components as whole numbers from -127 to 127, halves to even; zeros for a zero vector.

    Quotients are single precision, as `quantized` has them: Spark divides in double precision, and what rounds to a half in one
    may not be one in the other.
    """
    scale = int8_scale(vector)
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround((x / scale).cast("float").cast("double"), 0).cast("int"))))
    return F.when(scale > 0, whole).otherwise(F.transform(vector, lambda x: F.lit(0)))


def dot(a: Column, b: Column, zero: Column | None = None) -> Column:
    """Sum of products over the shorter length; exact for whole numbers."""
    n = F.least(F.size(a), F.size(b))
    start = F.lit(0).cast("int") if zero is None else zero
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), start, lambda s, x: s + x)


def blended_unit(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) a + weight b, scaled to length 1; unscaled if it is zero."""
    mixed = F.zip_with(a, b, lambda x, y: x.cast("double") * F.lit(1.0 - weight) + y.cast("double") * F.lit(weight))
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mixed, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def stable_hash(word: str) -> int:
    """31-hash of a word from 23, as a signed 32-bit number."""
    h = 23
    for c in word:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


@lru_cache(1 << 17)
def _slot(word: str, dims: int) -> int:
    return abs(stable_hash(word)) % dims


def word_hash_vector(words: Column, dims: int = 64) -> Column:
    """A bag of hashed words of three letters or more, of length 1: a text's stand-in vector where no embedding model is at hand."""

    @F.pandas_udf("array<double>")
    def bag(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            slots = [_slot(w, dims) for w in (() if row is None else row) if w is not None and len(w) > 2]
            counts = np.bincount(slots, minlength=dims).astype(float) if slots else np.zeros(dims)
            norm = np.sqrt((counts * counts).sum())
            out.append(counts / norm if norm else counts)
        return pd.Series(out)

    return bag(words)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of a text's token vectors whose mask is 1, scaled to length 1; zeros if the mask has none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.try_element_at(kept, F.lit(1)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    zeros = F.transform(F.try_element_at(vectors, F.lit(1)), lambda x: F.lit(0.0))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: F.when(norm > 0, x / norm).otherwise(x))).otherwise(zeros)


def quantized(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 rows, scales) of single-precision rows, by the rules of int8_values."""
    x = vectors.astype(np.float32)
    scale = (np.abs(x).max(axis=1) / np.float32(127)).astype(np.float32)
    safe = np.where(scale > 0, scale, np.float32(1))
    return np.clip(np.rint(x / safe[:, None]), -127, 127).astype(np.int8), scale
