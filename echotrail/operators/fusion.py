"""Reciprocal-rank fusion of a dense and a lexical ranking, without ranking a whole corpus per query."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators.kernels import cosine_scores, to_ids, to_matrix
from echotrail.operators.knn import knn, scan, take_top
from echotrail.operators.lexical import bm25_rankings, overlap_rankings
from echotrail.operators.term_index import TermIndex, best_of, ranks_from_slots, ranks_of, slots_before
from echotrail.session import BROADCAST_BYTES, cut_lineage, fits_broadcast, small_side

RRF = 60
# Bound of a query with its vector and its sorted candidates.
QUERY_BYTES = 64 * 1024


def dense_ranks(queries: DataFrame, corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact cosine rank of ``wanted(query_id, doc_id)`` over the whole corpus, counted batch by batch.

    The wanted rows' scores are sorted per query and broadcast; each task only returns, per query and
    slot, how many of its rows fall before that slot.
    """
    spark = corpus.sparkSession
    score_rows = _pair_scores(queries, corpus, wanted)
    # A few rows per query, read several times below.
    marks = cut_lineage(score_rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), F.col("doc_id").alias("doc_id")))).alias("marks")))
    packed = queries.select("query_id", "embedding").join(marks, "query_id")
    if not fits_broadcast(packed, QUERY_BYTES):
        # One counting pass over the corpus for each batch of queries that fits a broadcast.
        size = max(1, BROADCAST_BYTES // (2 * QUERY_BYTES))
        batches = -(-packed.count() // size)
        bucket = F.pmod(F.xxhash64("query_id"), F.lit(batches))
        parts = [dense_ranks(queries.filter(bucket == b), corpus, wanted.filter(bucket == b)) for b in range(batches)]
        return reduce(DataFrame.unionByName, parts)
    table = packed.toArrow()
    id_type = corpus.schema["doc_id"].dataType
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])
    if table.num_rows == 0:
        return spark.createDataFrame([], T.StructType([out[0], T.StructField("doc_id", id_type), T.StructField("rank", T.LongType())]))
    costs, ids = [], []
    for row in table.column("marks").to_pylist():
        costs.append(np.array([m["cost"] for m in row]))
        ids.append(np.array([m["doc_id"] for m in row]))
    shared = spark.sparkContext.broadcast((to_ids(table.column("query_id")), to_matrix(table.column("embedding")), costs, ids))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def count(batches):
        query_ids, q, cost_marks, id_marks = shared.value
        totals = [np.zeros(len(m) + 1, dtype=np.int64) for m in cost_marks]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            doc_ids = to_ids(batch.column("doc_id"))
            scores = -cosine_scores(q, to_matrix(batch.column("embedding")))
            for j in range(len(query_ids)):
                totals[j] += np.bincount(slots_before(scores[:, j], doc_ids, cost_marks[j], id_marks[j]), minlength=len(totals[j]))
        for j, query in enumerate(query_ids):
            used = np.nonzero(totals[j])[0]
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query, len(used))).cast(arrow.field(0).type), pa.array(used), pa.array(totals[j][used])], schema=arrow)

    slots = corpus.select("doc_id", "embedding").mapInArrow(count, out).groupBy("query_id", "slot").agg(F.sum("n").alias("n"))
    return ranks_from_slots(marks, slots)


def _pair_scores(queries: DataFrame, corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cosine of each wanted pair: the few pairs fetch their two vectors by id."""
    pairs = small_side(wanted.select("query_id", "doc_id"), 64)
    rows = corpus.select("doc_id", F.col("embedding").alias("x")).join(pairs, "doc_id")
    rows = rows.join(small_side(queries.select("query_id", F.col("embedding").alias("q")), 8192), "query_id")
    out = T.StructType([rows.schema["query_id"], rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches):
        from echotrail.operators.kernels import ROUND, unit_rows

        for batch in batches:
            if batch.num_rows:
                q, x = unit_rows(to_matrix(batch.column("q"))), unit_rows(to_matrix(batch.column("x")))
                values = np.round(np.einsum("ij,ij->i", q, x), ROUND)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("doc_id"), pa.array(values)], names=["query_id", "doc_id", "score"])

    return rows.select("query_id", "doc_id", "q", "x").mapInArrow(score, out)


def fuse(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Sum ``1 / (60 + rank)`` over the two rank lists and keep the best ``k`` per query."""
    both = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank")).join(
        lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank")), ["query_id", "doc_id"], "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("lexical_rank")), F.lit(0.0))
    fused = both.withColumn("score", F.round(score, 12))
    return take_top(fused, k).select("query_id", "rank", "doc_id", "score", "dense_rank", "lexical_rank")


def rrf_hybrid_search(queries: DataFrame, docs: DataFrame | TermIndex, vectors: DataFrame, k: int = 10,
                      tolerance: float | None = 0.5, allowed: DataFrame | None = None) -> DataFrame:
    """Dense list of ``max(2k, 50)`` fused with the full term ranking.

    ``queries(query_id, text, embedding)``, ``docs(doc_id, text)`` or their index, ``vectors(doc_id, embedding)``.

    A document outside the dense list can only reach the top ``k`` with a term rank up to ``k``, so
    exact term ranks are needed for the dense list and the first ``k`` of the term list alone.
    """
    corpus = vectors if allowed is None else vectors.join(small_side(allowed.select("doc_id"), 64), "doc_id", "left_semi")
    dense = knn(queries.select("query_id", "embedding"), corpus, max(2 * k, 50), tolerance=tolerance)
    lexical = bm25_rankings(docs, queries.select("query_id", "text"), allowed)
    # Both lists are read several times below and hold few rows per query.
    dense = cut_lineage(dense)
    head = cut_lineage(take_top(best_of(lexical, k), k).select("query_id", "doc_id", "rank"))
    rest = ranks_of(lexical, dense.join(head, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id"))
    return fuse(dense, head.unionByName(rest.withColumn("rank", F.col("rank").cast("int"))), k).withColumn("distance", 1.0 - F.col("score"))


def scoped_fusion_search(queries: DataFrame, docs: DataFrame | TermIndex, vectors: DataFrame, k: int = 10,
                         scope: DataFrame | None = None) -> DataFrame:
    """Fusion over all documents of a scope. ``vectors(doc_id, embedding)`` and ``docs(doc_id, text)`` are scoped
    before; an index of more documents takes their ids as ``scope``. Both ranks are scope-local.

    A document outside the first ``60 + 2k`` of both lists scores below ``1 / (60 + k)``, which ``k``
    dense results already reach. So candidates are those two heads, and a counting pass gives each
    its exact rank in the other list.
    """
    if not 1 <= k <= 100:
        raise ValueError("limit must be between 1 and 100")
    depth = RRF + 2 * k
    probes = queries.select("query_id", "embedding")
    # Both heads are read several times below and hold `depth` rows per query at most.
    dense_head = cut_lineage(take_top(scan(probes, vectors, depth, tolerance=None), depth).select("query_id", "doc_id", "rank"))
    rankings = overlap_rankings(docs, queries.select("query_id", "text"), scope)
    lexical_head = cut_lineage(take_top(best_of(rankings, depth), depth).select("query_id", "doc_id", "rank"))
    only_lexical = lexical_head.join(dense_head, ["query_id", "doc_id"], "left_anti")
    only_dense = dense_head.join(lexical_head, ["query_id", "doc_id"], "left_anti")
    dense = dense_head.unionByName(dense_ranks(probes, vectors, only_lexical).withColumn("rank", F.col("rank").cast("int")))
    lexical = lexical_head.unionByName(ranks_of(rankings, only_dense.select("query_id", "doc_id")).withColumn("rank", F.col("rank").cast("int")))
    return fuse(dense, lexical, k)


def search_then_filter_kind(hits: DataFrame, kinds: DataFrame) -> DataFrame:
    """First hit of each query whose document kind is the one asked for.

    ``hits(query_id, rank, doc_id, ...)`` are at most ten per query; ``kinds(doc_id, kind)`` is joined
    to those few rows, and ``wanted`` is a column of ``hits``.
    """
    hydrated = small_side(hits, 128).join(kinds, "doc_id").filter(F.col("kind") == F.col("wanted"))
    best = hydrated.groupBy("query_id").agg(F.min(F.struct("rank", "doc_id", "score")).alias("hit"))
    return best.select("query_id", "hit.rank", "hit.doc_id", "hit.score")


def why(matches: DataFrame, newest: DataFrame) -> DataFrame:
    """Search matches and the newest events side by side, tagged."""
    return matches.select("query_id", F.lit("match").alias("part"), "rank", "doc_id", "score").unionByName(
        newest.select(F.lit(None).cast(matches.schema["query_id"].dataType).alias("query_id"), F.lit("recent").alias("part"),
                      "rank", "doc_id", F.lit(None).cast("double").alias("score")))
