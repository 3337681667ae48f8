"""Staged search over index settings: measure a grid, rank it, take the best on to more rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.operators.evaluation import as_lists, mrr_at_k, ndcg_at_k, rank_configurations, recall_at_k
from echotrail.operators.ivf import ivf_build, ivf_rerank_knn
from echotrail.operators.knn import knn
from echotrail.session import cut_lineage


def quality(expected: DataFrame, actual: DataFrame, k: int) -> dict[str, float]:
    """Mean recall, reciprocal rank and gain of one ranking against the exact one."""
    both = as_lists(expected, k, "expected").join(as_lists(actual, k, "actual"), "query_id", "left")
    got = F.coalesce("actual", F.slice("expected", 1, 0))
    row = both.agg(*[F.avg(fn(F.col("expected"), got, k)).alias(fn.__name__) for fn in (recall_at_k, mrr_at_k, ndcg_at_k)])
    return row.first().asDict()


def _timed(job) -> tuple[DataFrame, float]:
    start = time.perf_counter()
    out = cut_lineage(job())
    return out, (time.perf_counter() - start) * 1000.0


def ivf_knob_search(queries: DataFrame, stages: list[tuple[str, DataFrame]], grid: list[dict], k: int = 10,
                    recall_gate: float = 0.95, promote: int = 2, tolerance: float | None = None) -> DataFrame:
    """One row per tried setting and stage with quality, speed-up, size, place and promotion.

    ``stages`` name growing corpora; ``grid`` holds ``parts``, ``probes`` and ``iterations``. Settings
    that pass the recall gate go on, best first. Only measurements come to the driver.
    """
    spark = queries.sparkSession
    report, active = None, list(grid)
    for name, corpus in stages:
        expected, base_ms = _timed(lambda: knn(queries, corpus, k, tolerance=tolerance))
        size = corpus.count()
        rows = []
        for i, knobs in enumerate(active):
            assigned, centroids = ivf_build(corpus, knobs.get("parts"), knobs.get("iterations", 1))
            assigned = cut_lineage(assigned)
            found, ms = _timed(lambda: ivf_rerank_knn(
                queries, assigned, centroids, k, knobs.get("probes", 8), tolerance, full_scan=bool(knobs.get("full_scan", False))))
            q = quality(expected, found, k)
            rows.append((name, i, str(knobs), q["recall_at_k"], q["mrr_at_k"], q["ndcg_at_k"], ms, base_ms / ms, size * 4 + centroids.size * 8))
        results = spark.createDataFrame(
            rows, "stage string, setting int, knobs string, recall_at_k double, mrr_at_k double, ndcg_at_k double, p95_ms double, p95_speedup double, storage_bytes bigint")
        ranked = cut_lineage(rank_configurations(results, recall_gate, promote))
        report = ranked if report is None else report.unionByName(ranked)
        winners = [r["setting"] for r in ranked.filter("promoted").orderBy("place").collect()]
        active = [active[i] for i in winners]
        if not active:
            break
    return report
