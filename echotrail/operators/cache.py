"""Associative cache over stored vectors: single-best lookup and soft readout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.functions import vectors as vx
from echotrail.operators.kernels import to_ids, to_matrix
from echotrail.operators.knn import knn, stream_shape, streamed
from echotrail.session import BROADCAST_BYTES, small_side, written

PAIRS_AT_ONCE = 65_536


def cache_lookup(queries: DataFrame, cache: DataFrame, threshold: float = 0.95, tolerance: float = 0.5, **options) -> DataFrame:
    """Value of the nearest key if its cosine reaches the threshold and its entropy is near enough.

    The gate comes after taking the single best key: a near key of other entropy is a miss, it does
    not make room for the second best. ``cache(doc_id, embedding, value)``.
    """
    best = knn(queries, cache.select("doc_id", "embedding"), 1, tolerance=None, **options).filter(F.col("score") >= threshold)
    left = queries.select("query_id", vx.vector_entropy(F.col("embedding")).alias("_q"))
    right = cache.select("doc_id", "value", vx.vector_entropy(F.col("embedding")).alias("_d"))
    hits = right.join(small_side(best, 64), "doc_id").join(left, "query_id")
    return hits.filter(F.round(F.abs(F.col("_q") - F.col("_d")), 9) <= tolerance).select("query_id", "doc_id", "score", "value")


def hopfield_readout(queries: DataFrame, cache: DataFrame, beta: float = 8.0, top_k: int = 64, min_confidence: float = 0.70,
                     max_entropy_ratio: float = 0.65, min_similarity: float = 0.0, tolerance: float = 0.5, **options) -> DataFrame:
    """Softmax-weighted value over the entropy-compatible nearest keys, with the reason when refused.

    At most ``top_k`` neighbours per query travel on, so the windows and the weighted sum are small.
    """
    # Kept aside: the size checks below would search again.
    near = written(knn(queries, cache.select("doc_id", "embedding"), top_k, tolerance=tolerance, **options).select("query_id", "doc_id", "score"))
    mine = Window.partitionBy("query_id")
    raw = F.exp(beta * (F.col("score") - F.max("score").over(mine)))
    weighted = near.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(mine)).drop("_raw")
    stats = weighted.groupBy("query_id").agg(
        F.count("*").alias("k"), F.max("weight").alias("max_probability"), F.max("score").alias("max_similarity"),
        (-F.sum(F.col("weight") * F.log(F.greatest("weight", F.lit(1e-12))))).alias("_h"))
    ratio = F.when(F.col("k") <= 1, 0.0).otherwise(F.col("_h") / F.log(F.col("k").cast("double")))
    stats = stats.withColumn("entropy_ratio", ratio).drop("_h")
    all_queries = queries.select("query_id").join(stats, "query_id", "left")
    reason = (
        F.when(F.col("k").isNull(), "no_entropy_compatible_candidates").when(F.col("max_similarity") < min_similarity, "low_similarity")
        .when(F.col("max_probability") < min_confidence, "low_confidence").when(F.col("entropy_ratio") > max_entropy_ratio, "high_entropy")
        .otherwise("accepted"))
    judged = all_queries.withColumn("reason", reason)
    accepted = weighted.join(small_side(judged.filter("reason = 'accepted'").select("query_id"), 16), "query_id", "left_semi")
    readout = weighted_values(accepted.select("query_id", "doc_id", "weight"), cache.select("doc_id", "value"), options.get("limit"))
    return judged.join(readout, "query_id", "left")


def weighted_values(weighted: DataFrame, cache: DataFrame, limit: int | None = None) -> DataFrame:
    """``query_id, readout``: the sum of ``weight * value`` over the rows of ``weighted(query_id, doc_id, weight)``.

    Blocks of queries with their weights meet the values as they stream past, so that no value travels once per pair.
    """
    lists = written(weighted.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "weight")).alias("pairs")).select(
        "query_id", F.col("pairs.doc_id").alias("docs"), F.col("pairs.weight").alias("weights")))
    values = cache.filter("value IS NOT NULL").select("doc_id", vx.doubles(F.col("value")).alias("value"))
    size = values.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("value")).alias("d")).first()
    asked = lists.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("docs")).alias("k")).first()
    out = T.StructType([T.StructField("query_id", lists.schema["query_id"].dataType), T.StructField("readout", T.ArrayType(T.DoubleType()))])
    shape = stream_shape(asked["n"], size["n"], 8 * (size["d"] or 1), asked["k"] or 1, BROADCAST_BYTES if limit is None else limit, cache.sparkSession.sparkContext.defaultParallelism)

    def sums(table, batches):
        docs = table.column("docs").combine_chunks()
        owner, wanted = pc.list_parent_indices(docs).to_numpy(zero_copy_only=False), to_ids(docs.flatten())
        weight = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(wanted, kind="stable")
        owner, wanted, weight = owner[order], wanted[order], weight[order]
        total, seen = None, np.zeros(table.num_rows, bool)
        for batch in batches:
            ids, value = to_ids(batch.column("doc_id")), to_matrix(batch.column("value"))
            total = np.zeros((table.num_rows, value.shape[1])) if total is None else total
            first, last = np.searchsorted(wanted, ids, side="left"), np.searchsorted(wanted, ids, side="right")
            row = np.repeat(np.arange(len(ids)), last - first)
            pair = np.arange(len(row)) + np.repeat(last - np.cumsum(last - first), last - first)
            for at in range(0, len(row), PAIRS_AT_ONCE):
                p, r = pair[at:at + PAIRS_AT_ONCE], row[at:at + PAIRS_AT_ONCE]
                by = np.argsort(owner[p], kind="stable")
                p, r = p[by], r[by]
                start = np.flatnonzero(np.diff(owner[p], prepend=-1))
                total[owner[p[start]]] += np.add.reduceat(value[r] * weight[p][:, None], start, axis=0)
                seen[owner[p[start]]] = True
        for at in range(0, table.num_rows, 4096):
            some = np.flatnonzero(seen[at:at + 4096]) + at
            if len(some):
                held = total[some]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * held.shape[1], pa.int32()), pa.array(held.reshape(-1)))
                yield pa.RecordBatch.from_arrays([table.column("query_id").combine_chunks().take(pa.array(some)), lists], names=["query_id", "readout"])

    # One stream past each block: a sum is whole in its task.
    return streamed(lists, values, max(1, min(asked["n"], shape[0] * shape[1])), 1, sums, out)
