"""Column expressions for vectors. Arrow batches only where a built-in cannot keep up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTROPY_BINS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body`` (lambda bodies would re-evaluate it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity; a zero vector has similarity 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def is_finite_vector(v: Column) -> Column:
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return v.isNotNull() & ~bad


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic unit vector from SHA-256 of a text. Stands in for a model; carries no meaning.

    Two little-endian bytes out of every four of a chained digest give each coordinate. All of it
    is built-in expressions, so embedding runs inside the scan stage.
    """
    blocks = (dim * 4) // 32 + 1

    def extended(seed: Column) -> Column:
        counters = F.sequence(F.lit(0), F.lit(blocks - 1))
        return F.array_join(
            F.transform(counters, lambda i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i), 8, "0"))), 256)), ""
        )

    def values(digits: Column) -> Column:
        def one(j: Column) -> Column:
            low = F.substr(digits, j * 8 + 1, F.lit(2))
            high = F.substr(digits, j * 8 + 3, F.lit(2))
            return F.conv(F.concat(high, low), 16, 10).cast("double") / 65535.0 * 2.0 - 1.0

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)

    seed = F.unhex(F.sha2(text, 256))
    raw = let(let(seed, extended), values)
    return let(raw, lambda v: let(norm(v) + 1e-8, lambda n: F.transform(v, lambda x: x / n)))


def entropy_of_rows(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shannon entropy (bits) of each ragged row over 64 equal bins between its own min and max."""
    out = np.zeros(len(counts))
    some = counts > 0
    if not some.any():
        return out
    clean = np.nan_to_num(values, nan=0.0, posinf=1.0, neginf=-1.0)
    first = starts[some]
    n = counts[some]
    low = np.minimum.reduceat(clean, first)
    high = np.maximum.reduceat(clean, first)
    flat = np.abs(high - low) <= 1e-5 * np.maximum(np.abs(low), np.abs(high))
    span = np.where(flat, 1.0, high - low)
    row = np.repeat(np.arange(len(n)), n)
    bins = np.minimum(ENTROPY_BINS - 1, np.floor((clean - low[row]) / span[row] * ENTROPY_BINS)).astype(np.int64)
    bins = np.maximum(bins, 0)
    hist = np.bincount(row * ENTROPY_BINS + bins, minlength=len(n) * ENTROPY_BINS).reshape(len(n), ENTROPY_BINS)
    p = hist / n[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p), 0.0)
    out[some] = np.where(flat, 0.0, -terms.sum(axis=1))
    return out


def _vector_entropy(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    counts = np.nan_to_num(lengths.astype(float)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts
    return pa.array(entropy_of_rows(values, starts, counts))


def vector_entropy(vector: Column) -> Column:
    return F.arrow_udf(_vector_entropy, T.DoubleType())(vector)


def entropy_route(entropy: Column, low: float = 1.2, high: float = 2.5) -> Column:
    return F.when(entropy < low, "local").when(entropy < high, "flash").otherwise("ultra")
