"""Searches of an index in cells: a query travels once per group of parts, and what it knows of its best is used."""

import numpy as np
from pyspark.sql import functions as F

from echotrail.operators import ivf, kernels as kn, knn as nn
from echotrail.operators.knn import take_top


def tables(spark, n=1200, parts=30):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 8))
    x[100:160] = x[3]  # copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    assigned, centroids = ivf.ivf_build(rows, parts)
    asked = rows.select(F.col("doc_id").alias("query_id"), "embedding")
    return asked, assigned.cache(), centroids


def test_groups_hold_every_part_once_and_split_large_ones():
    rng = np.random.default_rng(1)
    rows, asked = rng.integers(0, 500, 60).tolist(), rng.integers(0, 2000, 60).tolist()
    rows[7], asked[7], asked[9] = 9000, 5, 0
    first, count = nn.part_groups(rows, asked, 10, 2000)
    held = {}
    for p in range(60):
        assert (count[p] > 0) == (rows[p] > 0 and asked[p] > 0)
        for g in range(first[p], first[p] + count[p]):
            held.setdefault(g, []).append(p)
    assert sorted(held) == list(range(len(held)))
    assert count[7] >= 5 and all(held[g] == [7] for g in range(first[7], first[7] + count[7]))
    assert all(sum(rows[p] / count[p] for p in g) <= 2000 for g in held.values())


def test_a_query_travels_once_to_a_group_of_parts(spark):
    asked, assigned, centroids = tables(spark)
    tagged = ivf.probe_lists(asked, centroids, 20)
    left, right, cells = nn._cells(tagged, assigned, 64, 5, 64 * 1024 * 1024, len(centroids))
    assert left.count() < 4 * 1200 and right.count() < 4 * 1200  # a copy per part would be 24,000


def test_cells_of_groups_find_what_one_task_finds(spark):
    asked, assigned, centroids = tables(spark)
    found = [ivf.ivf_rerank_knn(asked, assigned, centroids, 5, probes=6, limit=limit).orderBy("query_id", "rank").collect()
             for limit in (None, 30_000)]
    assert len(found[0]) > 4000 and found[0] == found[1]


def test_rows_below_a_known_score_are_not_handed_on(spark):
    asked, assigned, _ = tables(spark)
    rows = assigned.drop("part")
    whole = take_top(nn.scan(asked, rows, 5, tolerance=None, limit=30_000), 5)
    least = whole.groupBy("query_id").agg(F.min("score").alias("least"))
    known = asked.join(least, "query_id")
    for limit in (None, 30_000):
        again = nn.scan(known, rows, 5, tolerance=None, limit=limit)
        assert again.count() < 2 * 6000
        best = take_top(again, 5)
        assert best.orderBy("query_id", "rank").collect() == whole.orderBy("query_id", "rank").collect()


def test_entropy_of_many_rows_is_taken_in_pieces(monkeypatch):
    from echotrail.functions import vectors as vx

    sizes, own = [], vx.entropy_of_rows
    monkeypatch.setattr(vx, "entropy_of_rows", lambda v, s, c: sizes.append(len(c)) or own(v, s, c))
    x = np.random.default_rng(2).standard_normal((20_000, 4))
    assert len(kn.matrix_entropy(x)) == 20_000 and max(sizes) <= 8192
