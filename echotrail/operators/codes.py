"""Code columns for coarse search: sparse binary winner codes and lattice points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echotrail.operators.kernels import lowest_copies, to_ids, to_matrix
from echotrail.operators.knn import candidate_count, knn, rerank_knn
from echotrail.session import cut_lineage, discard, written

FLY_BITS, FLY_SEED, FLY_LINKS, FLY_ACTIVE = 10_000, 42, 6, 0.05
ROWS_AT_ONCE = 1024


def with_code(df: DataFrame, encode, kind: T.DataType) -> DataFrame:
    """Append a ``code`` column made batch by batch from ``embedding``; no shuffle."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField("code", kind)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = encode(to_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays(batch.columns + [code], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, schema)


def lowest_of_code(df: DataFrame, most: int) -> DataFrame:
    """Rows ``(doc_id, code, ...)`` without those that share a code with ``most`` lower ids of their batch.

    They score as these do and come after them, so no search for ``most`` rows by code alone can find them.
    """
    def run(batches):
        for batch in batches:
            few = lowest_copies(to_ids(batch.column("doc_id")), to_matrix(batch.column("code")), most) if batch.num_rows else None
            yield batch if few is None else batch.take(pa.array(few))

    return df.mapInArrow(run, df.schema)


@lru_cache(maxsize=4)
def fly_projection(dim: int, bits: int = FLY_BITS, seed: int = FLY_SEED, links: int = FLY_LINKS):
    """Target bit and weight of each input coordinate's few links, drawn coordinate by coordinate."""
    rng = np.random.default_rng(seed)
    targets, weights = [], []
    for _ in range(dim):
        chosen = rng.choice(bits, size=min(links, bits), replace=False)
        targets.append(chosen)
        weights.append(rng.standard_normal(size=len(chosen)).astype(np.float32))
    return np.array(targets), np.array(weights)


def fly_codes(x: np.ndarray, bits: int = FLY_BITS) -> np.ndarray:
    """Packed bits of the strongest 5 % of a sparse random projection; constant rows give no bits."""
    n, dim = x.shape
    clean = np.nan_to_num(x, nan=0.0, posinf=1e9, neginf=-1e9)
    targets, weights = fly_projection(dim, bits)
    active = max(1, int(bits * FLY_ACTIVE))
    out = np.zeros((n, bits // 8), dtype=np.uint8)
    for start in range(0, n, 512):
        part = clean[start:start + 512]
        projected = np.zeros((len(part), bits), dtype=np.float32)
        for j in range(dim):
            projected[:, targets[j]] += part[:, j:j + 1].astype(np.float32) * weights[j]
        order = np.argsort(projected, axis=1, kind="stable")[:, -active:]
        mask = np.zeros((len(part), bits), dtype=np.uint8)
        np.put_along_axis(mask, order, 1, axis=1)
        flat = (part.max(axis=1) == part.min(axis=1)) | (projected.max(axis=1) == projected.min(axis=1))
        mask[flat] = 0
        out[start:start + 512] = np.packbits(mask, axis=1)
    return out


def flyhash_index(df: DataFrame) -> DataFrame:
    def encode(x):
        return pa.array([row.tobytes() for row in fly_codes(x)], pa.binary())

    return with_code(df, encode, T.BinaryType())


def _code_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def without_common_bits(*tables: DataFrame) -> list[DataFrame]:
    """The tables with codes cut to the bits that are not the same in all of them; no distance changes, and most bits of a
    sparse code are of no use."""
    def both(batches):
        one, every = None, None
        for batch in batches:
            if batch.num_rows:
                codes = _code_rows(batch.column("code"))
                least, most = np.bitwise_and.reduce(codes, axis=0), np.bitwise_or.reduce(codes, axis=0)
                one, every = (most, least) if one is None else (one | most, every & least)
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([one.tobytes()]), pa.array([every.tobytes()])], names=["one", "every"])

    found = [r for t in tables for r in t.select("code").mapInArrow(both, "one binary, every binary").collect()]  # a row per task
    if not found:
        return list(tables)
    one, every = (np.array([np.frombuffer(r[name], np.uint8) for r in found]) for name in ("one", "every"))
    differ = np.bitwise_or.reduce(one, axis=0) & ~np.bitwise_and.reduce(every, axis=0)
    octets = np.flatnonzero(differ)
    octets = octets if len(octets) else np.zeros(1, np.int64)
    bits = np.flatnonzero(np.unpackbits(differ[octets]))

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                codes = _code_rows(batch.column("code"))[:, octets]
                short = [np.packbits(np.unpackbits(codes[i:i + ROWS_AT_ONCE], axis=1)[:, bits], axis=1) for i in range(0, len(codes), ROWS_AT_ONCE)]
                at = batch.schema.get_field_index("code")
                yield batch.set_column(at, batch.schema.field(at), pa.array([row.tobytes() for part in short for row in part], batch.schema.field(at).type))

    return [t.mapInArrow(cut, t.schema) for t in tables]


def _coded_pair(queries: DataFrame, corpus: DataFrame) -> list[DataFrame]:
    coded = written(flyhash_index(queries)), written(flyhash_index(corpus))
    short = [written(t) for t in without_common_bits(*coded)]
    for table in coded:
        discard(table)
    return short


def hamming_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, **options) -> DataFrame:
    return knn(*_coded_pair(queries, corpus), k, metric="hamming", **options)


def flyhash_rerank_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, candidates: int | None = None, **options) -> DataFrame:
    coded_queries, coded_corpus = _coded_pair(queries, corpus)
    return rerank_knn(coded_queries, coded_corpus, k, "hamming", candidates or candidate_count(k), **options)


# --- lattice ------------------------------------------------------------------------------

# Parity part of the generator of the extended binary Golay code.
GOLAY_PARITY = """
110100011101
111010001110
011101000111
101110100011
110111010001
111011101000
011101110100
001110111010
000111011101
100011101110
010001110111
111111111110
"""
BLOCKS, WIDTH = 32, 24
LATTICE_SCALE = np.sqrt(8.0)
# The words differ in 6 places or more, so points lie at least sqrt(24) apart, and one whose squared distance is below 6 is the
# nearest; some room for rounding.
SURE = 5.5


@lru_cache(maxsize=1)
def golay_words() -> np.ndarray:
    """All 4096 code words, message bits first (least significant bit in front)."""
    parity = np.array([[int(b) for b in row] for row in GOLAY_PARITY.split()])
    message = (np.arange(4096)[:, None] >> np.arange(12)[None, :]) & 1
    return np.concatenate([message, message @ parity % 2], axis=1).astype(np.float64)


@lru_cache(maxsize=1)
def _word_tables():
    """The 64 patterns of six bits, and for each message the index of its parity half."""
    six = ((np.arange(64)[:, None] >> np.arange(6)[None, :]) & 1).astype(bool)
    parity = golay_words()[:, 12:].astype(np.int64) @ (1 << np.arange(12))
    return six, parity


def nearest_lattice(y: np.ndarray, step: int = 16) -> np.ndarray:
    """Nearest point of the scaled lattice for each row of 24 coordinates.

    Points are ``4z + 2g`` (coordinate sum divisible by 8) or ``4z + 2g + 1`` (sum 4 mod 8) for a code
    word g. Per word the nearest such integers are taken; if the sum is off, the coordinate with the
    largest error moves one step of 4 towards its value, which adds ``16 - 8 * |error|`` to the cost.

    A word's cost, sum and largest error come from tables over six coordinates each, so a row costs a
    few operations per word instead of one per word and coordinate. A row that lies within half the least distance
    of the nearest multiples of 4 needs no words.
    """
    out = 4.0 * np.rint(np.asarray(y, dtype=np.float64) / 4.0)
    far = np.flatnonzero((np.mod(out.sum(axis=1), 8.0) != 0.0) | ~(((y - out) ** 2).sum(axis=1) < SURE))
    if len(far):
        out[far] = _nearest_by_words(y[far], step)
    return out


def _nearest_by_words(y: np.ndarray, step: int) -> np.ndarray:
    words = golay_words().astype(bool)
    six, parity = _word_tables()
    out = np.empty_like(y, dtype=np.float64)
    for start in range(0, len(y), step):
        part = y[start:start + step]
        n = len(part)
        best, point = np.full(n, np.inf), np.empty((n, WIDTH))
        for odd in (0.0, 1.0):
            near = [4.0 * np.rint((part - 2.0 * bit - odd) / 4.0) + 2.0 * bit + odd for bit in (0, 1)]
            gap = [part - v for v in near]
            halves = []
            for half in (0, 1):
                tables = []
                for group in (0, 1):
                    at = slice(12 * half + 6 * group, 12 * half + 6 * group + 6)
                    e = np.where(six[None], gap[1][:, None, at], gap[0][:, None, at])
                    v = np.where(six[None], near[1][:, None, at], near[0][:, None, at])
                    # Costs rank candidates in single precision; sums only matter modulo 8.
                    tables.append(((e * e).sum(axis=2).astype(np.float32), np.mod(np.rint(v.sum(axis=2)), 8).astype(np.int8),
                                   np.abs(e).max(axis=2).astype(np.float32)))
                low, high = tables
                halves.append([
                    (high[0][:, :, None] + low[0][:, None, :]).reshape(n, 4096),
                    (high[1][:, :, None] + low[1][:, None, :]).reshape(n, 4096),
                    np.maximum(high[2][:, :, None], low[2][:, None, :]).reshape(n, 4096)])
            first, second = halves
            off = ((first[1] + np.take(second[1], parity, axis=1)) & 7) == (4 if odd == 0.0 else 0)
            extra = np.float32(16.0) - np.float32(8.0) * np.maximum(first[2], np.take(second[2], parity, axis=1))
            cost = first[0] + np.take(second[0], parity, axis=1) + extra * off
            word = cost.argmin(axis=1)
            rows = np.arange(n)
            better = cost[rows, word] < best
            chosen = np.where(words[word], near[1], near[0])
            error = part - chosen
            worst = np.abs(error).argmax(axis=1)
            move = np.where(off[rows, word], np.where(error[rows, worst] >= 0, 4.0, -4.0), 0.0)
            chosen[rows, worst] += move
            point[better] = chosen[better]
            best = np.minimum(best, cost[rows, word])
        out[start:start + step] = point
    return out


def lattice_codes(x: np.ndarray, noise_scale: float = 0.1, seed: int = 42) -> np.ndarray:
    """Integer lattice coordinates of each vector: 32 blocks, padded to 24 with seeded noise, decoded."""
    n, dim = x.shape
    if dim % BLOCKS:
        raise ValueError("dimension must be divisible by 32")
    if n > ROWS_AT_ONCE:
        return np.concatenate([lattice_codes(x[i:i + ROWS_AT_ONCE], noise_scale, seed) for i in range(0, n, ROWS_AT_ONCE)])
    per = dim // BLOCKS
    blocks = x.reshape(n, BLOCKS, per)
    pad = (WIDTH - per % WIDTH) % WIDTH
    if pad:
        draw = np.random.default_rng(seed).standard_normal((BLOCKS, pad))
        mean = x.mean(axis=1)[:, None, None]
        std = x.std(axis=1, ddof=1)[:, None, None] if dim > 1 else np.ones((n, 1, 1))
        blocks = np.concatenate([blocks, mean + noise_scale * std * draw[None]], axis=2)
    flat = blocks.reshape(-1, WIDTH) * LATTICE_SCALE
    codes = np.rint(nearest_lattice(flat)).reshape(n, -1)
    return np.clip(codes, -32768, 32767).astype(np.int16)


def lattice_index(df: DataFrame) -> DataFrame:
    def encode(x):
        codes = lattice_codes(x)
        offsets = pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1), pa.int16()))

    return with_code(df, encode, T.ArrayType(T.ShortType()))


def lattice_coarse_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, tolerance: float | None = 0.5, **options) -> DataFrame:
    """The ``3k`` nearest codes by distance, then exact cosine among them.

    The entropy gate belongs to the exact stage, so it is applied to the candidates afterwards.
    """
    from pyspark.sql import functions as F

    from echotrail.functions.vectors import vector_entropy
    from echotrail.operators.knn import scan, take_top
    from echotrail.session import small_side

    # The code tables are written once; each would otherwise be decoded at every read.
    coded_queries, coded_corpus = cut_lineage(lattice_index(queries)), cut_lineage(lowest_of_code(lattice_index(corpus), 3 * k))
    coarse = scan(coded_queries, coded_corpus, 3 * k, "l2", True, tolerance=None, **options)
    chosen = take_top(coarse, 3 * k, "score", "coarse_rank")
    if tolerance is not None:
        left = queries.select("query_id", vector_entropy(F.col("embedding")).alias("_q"))
        right = corpus.select("doc_id", vector_entropy(F.col("embedding")).alias("_d"))
        # Few rows may be chosen by every query, so the entropies travel where they can, not the pairs.
        chosen = chosen.join(small_side(right, 32), "doc_id").join(small_side(left, 32), "query_id").filter(
            F.round(F.abs(F.col("_q") - F.col("_d")), 9) <= tolerance)
    return take_top(chosen, k, "exact").select(
        "query_id", "rank", "doc_id", F.col("exact").alias("score"), (1.0 - F.col("exact")).alias("distance"))
