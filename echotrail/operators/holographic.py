"""Superposed memories: one additive state per collection or day, recalled by correlation with a key."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.functions import vectors as vx
from echotrail.operators.kernels import ROUND, to_matrix
from echotrail.operators.knn import knn

NO_MATCH = 0.05
KEY_SEED = 60_221


def key_vector(doc_id, dim: int):
    """Key of a document: the hash vector of its id."""
    return vx.hash_embedding(doc_id.cast("string"), dim)


def memory_state(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum over rows of key convolved with vector, held in the frequency domain.

    Each task adds up its rows into one spectrum; only ``dim`` numbers per task are shuffled. The state
    is additive, so new rows are added and deleted rows subtracted without touching the others.
    """
    out = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def partial(batches):
        total = np.zeros(dim, dtype=complex)
        for batch in batches:
            if batch.num_rows:
                total += (np.fft.fft(to_matrix(batch.column("key")), axis=1) * np.fft.fft(to_matrix(batch.column("embedding")), axis=1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total.real.copy()), pa.array(total.imag.copy())], names=["i", "re", "im"])

    keyed = rows.select(key_vector(F.col("doc_id"), dim).alias("key"), "embedding")
    sums = keyed.mapInArrow(partial, out).groupBy("i").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    spectrum = np.zeros(dim, dtype=complex)
    for r in sums.collect():  # dim numbers
        spectrum[r["i"]] = complex(r["re"], r["im"])
    return spectrum


def recalled_vectors(rows: DataFrame, spectrum: np.ndarray) -> DataFrame:
    """Replace each row's vector by what the memory returns for its key; the stored entropy stays."""
    dim = len(spectrum)
    shared = rows.sparkSession.sparkContext.broadcast(spectrum)
    keyed = rows.select("doc_id", key_vector(F.col("doc_id"), dim).alias("key"), vx.vector_entropy(F.col("embedding")).alias("entropy"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("entropy", T.DoubleType())])

    def recall(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.fft.ifft(shared.value[None, :] * np.conj(np.fft.fft(to_matrix(batch.column("key")), axis=1)), axis=1).real
                offsets = pa.array(np.arange(len(v) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1))), batch.column("entropy")],
                    names=["doc_id", "embedding", "entropy"])

    return keyed.mapInArrow(recall, schema)


def holographic_knn(queries: DataFrame, rows: DataFrame, k: int = 10, spectrum: np.ndarray | None = None,
                    tolerance: float | None = 0.5, **options) -> DataFrame:
    """Cosine of each query with the vectors recalled from memory, gated by the stored entropies."""
    if spectrum is None:
        spectrum = memory_state(rows, rows.select(F.size("embedding")).first()[0])
    gated = queries.select("query_id", "embedding", vx.vector_entropy(F.col("embedding")).alias("entropy"))
    return knn(gated, recalled_vectors(rows, spectrum), k, tolerance=tolerance, **options)


# --- one memory per day -------------------------------------------------------------------


def unitary(x: np.ndarray) -> np.ndarray:
    """Rows with all Fourier magnitudes set to one."""
    spectrum = np.fft.fft(x, axis=-1)
    size = np.abs(spectrum)
    return np.fft.ifft(spectrum / np.where(size < 1e-9, 1.0, size), axis=-1).real


def orthogonal_base(dim: int) -> np.ndarray:
    """``dim`` orthonormal pointer vectors from a fixed seed."""
    q, r = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).T


def batch_key(index: int, dim: int) -> np.ndarray:
    """Key of a batch of slots: a unitary vector drawn for the batch number from our own seed."""
    return unitary(np.random.default_rng([KEY_SEED, index]).standard_normal(dim))


def pointers(slots: np.ndarray, dim: int) -> np.ndarray:
    """Pointer of each 0-based slot: a base vector bound with the key of its batch of ``dim`` slots."""
    base = np.fft.fft(orthogonal_base(dim), axis=1)
    out = np.empty((len(slots), dim))
    for b in np.unique(slots // dim):
        chosen = np.nonzero(slots // dim == b)[0]
        out[chosen] = np.fft.ifft(base[slots[chosen] % dim] * np.fft.fft(batch_key(int(b), dim))[None, :], axis=1).real
    return out


def compile_days(rows: DataFrame, dim: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per day the memory vector, and for each row its slot.

    ``rows(day date, doc_id, embedding, ...)``. Slots are exact positions within the day, found without
    gathering a day, and memories are summed per task before the shuffle.
    """
    from echotrail.operators.ordered import ordered_positions

    placed = ordered_positions(rows, ["day"], order).withColumn("slot", F.col("pos") - 1).drop("pos")
    out = T.StructType([rows.schema["day"], T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            days = batch.column("day").to_pylist()
            slots = batch.column("slot").to_numpy(zero_copy_only=False)
            keys = np.fft.fft(unitary(to_matrix(batch.column("embedding"))), axis=1)
            bound = np.fft.ifft(keys * np.fft.fft(pointers(slots, dim), axis=1), axis=1).real
            for day in set(days):
                mine = np.array([d == day for d in days])
                sums[day] = sums.get(day, 0.0) + bound[mine].sum(axis=0)
        for day, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([day] * dim, batch_type), pa.array(np.arange(dim), pa.int32()), pa.array(total)], names=["day", "i", "x"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema["day"].dataType)
    parts = placed.select("day", "slot", "embedding").mapInArrow(partial, out)
    sums = parts.groupBy("day", "i").agg(F.sum("x").alias("x"))
    memory = sums.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("memory"))
    return memory, placed


def day_recall(queries: DataFrame, memory: DataFrame, placed: DataFrame, dim: int) -> DataFrame:
    """Best slot of each query's day: ``(query_id, day, doc_id, score)``, no row below 0.05.

    The recalled pointer is compared with the pointers of the day's slots. Rows of a busy day stay
    spread over tasks: each task scores its rows and only the maximum per query is shuffled.
    """
    from echotrail.operators.knn import scan, take_top

    asked = queries.join(memory, "day")
    schema = T.StructType([queries.schema["query_id"], queries.schema["day"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def noisy(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.fft.fft(unitary(to_matrix(batch.column("embedding"))), axis=1)
                out = np.fft.ifft(np.fft.fft(to_matrix(batch.column("memory")), axis=1) * np.conj(keys), axis=1).real
                offsets = pa.array(np.arange(len(out) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("day"), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], names=["query_id", "day", "embedding"])

    signals = asked.select("query_id", "day", "embedding", "memory").mapInArrow(noisy, schema)
    # Days become the parts of the search: a row meets only queries of its own day.
    span = memory.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span["lo"] is None:
        return queries.select("query_id", "day", F.lit(None).cast(placed.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("double").alias("score"))
    part = F.datediff("day", F.lit(span["lo"])).cast("int")
    n = (span["hi"] - span["lo"]).days + 1
    index = T.StructType([placed.schema["doc_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType())])

    def codebook(batches):
        for batch in batches:
            if batch.num_rows:
                c = pointers(batch.column("slot").to_numpy(zero_copy_only=False), dim)
                offsets = pa.array(np.arange(len(c) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(c.reshape(-1))), batch.column("part")], names=["doc_id", "embedding", "part"])

    left = signals.select("query_id", "embedding", F.array(part).alias("probes"))
    right = placed.select("doc_id", "slot", part.alias("part")).mapInArrow(codebook, index)
    best = take_top(scan(left, right, 1, tolerance=None, parts=n), 1)
    hits = best.filter(F.col("score") >= NO_MATCH).select("query_id", "doc_id", F.round("score", ROUND).alias("score"))
    return queries.select("query_id", "day").join(hits, "query_id", "left")
