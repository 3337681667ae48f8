"""Searches of a stored table against itself, cut into cells."""

import numpy as np

from echotrail.operators import knn as nn
from echotrail.operators.embedding_space import CayleyRotation, leakage_report
from echotrail.session import cut_lineage


def vectors(spark, n, dim=32):
    x = np.random.default_rng(4).standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc_id bigint, embedding array<double>")


def test_a_stored_table_is_searched_against_itself_in_cells(spark):
    rows = cut_lineage(vectors(spark, 60))
    asked = rows.withColumnRenamed("doc_id", "query_id")
    whole = nn.knn(asked, rows, 3, tolerance=None, exclude_self=True).collect()
    cells = nn.knn(asked, rows, 3, tolerance=None, exclude_self=True, limit=3000).collect()
    assert sorted(whole) == sorted(cells) and len(cells) == 180


def test_leakage_report_where_searches_run_in_cells(spark, monkeypatch):
    rows = vectors(spark, 60)
    want = {r["metric"]: r["value"] for r in leakage_report(rows, CayleyRotation(32, seed=3), 3).collect()}
    monkeypatch.setattr(nn, "BROADCAST_BYTES", 3000)
    got = {r["metric"]: r["value"] for r in leakage_report(rows, CayleyRotation(32, seed=3), 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_a_task_that_met_all_rows_hands_on_final_rows_only(spark):
    rows = cut_lineage(vectors(spark, 300))
    asked = rows.withColumnRenamed("doc_id", "query_id")
    found = nn.scan(asked, rows, 50, "int8", True, tolerance=None, limit=40_000, final=3)
    assert found.count() == 300 * 3
    want = nn.rerank_knn(asked, rows, 3, "int8", 50, tolerance=None).collect()
    assert sorted(nn.rerank_knn(asked, rows, 3, "int8", 50, tolerance=None, limit=40_000).collect()) == sorted(want) and len(want) == 900


def test_readout_streams_values_past_blocks(spark, monkeypatch):
    """Before, the search ran once for every size check, and every value was exploded for every pair."""
    from echotrail.operators import cache as ca

    searched = []
    knn = ca.knn
    monkeypatch.setattr(ca, "knn", lambda *a, **k: searched.append(knn(*a, **k).withColumn("score", nn.F.col("score"))) or searched[-1])
    monkeypatch.setattr(ca, "PAIRS_AT_ONCE", 100)
    rows = cut_lineage(vectors(spark, 120, 8))
    cache = rows.withColumn("value", nn.F.slice("embedding", 1, 3)).withColumn("value", nn.F.when(nn.F.col("doc_id") != 7, nn.F.col("value")))
    asked = rows.withColumnRenamed("doc_id", "query_id")
    x = {r["doc_id"]: r["value"] for r in cache.collect()}
    plain = np.array([r["embedding"] for r in rows.orderBy("doc_id").collect()])
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    for limit in (None, 3000):
        got = {r["query_id"]: r for r in ca.hopfield_readout(asked, cache, beta=8.0, top_k=5, tolerance=9.0, limit=limit).collect()}
        assert len(got) == 120
        for i, r in got.items():
            score = np.round(unit @ unit[i], 9)
            near = np.lexsort((np.arange(120), -score))[:5]
            w = np.exp(8.0 * score[near]) / np.exp(8.0 * score[near]).sum()
            if r["reason"] == "accepted":
                want = sum(p * np.array(x[int(j)]) for p, j in zip(w, near) if x[int(j)] is not None)
                assert np.allclose(r["readout"], want)
            else:
                assert r["readout"] is None
        assert any(r["reason"] == "accepted" for r in got.values()) and any(r["reason"] != "accepted" for r in got.values())


def test_codes_travel_without_common_bits(spark):
    """Before, every copy of a row carried all 10,000 bits of its code, and every cell handed on all candidates."""
    from echotrail.operators import codes

    rows = cut_lineage(vectors(spark, 200))
    asked = rows.withColumnRenamed("doc_id", "query_id").limit(90)
    full = codes.flyhash_index(rows).orderBy("doc_id").collect()
    short = [t.collect() for t in codes.without_common_bits(codes.flyhash_index(asked), codes.flyhash_index(rows))]
    assert {len(r["code"]) for part in short for r in part} == {len(short[0][0]["code"])} and len(short[0][0]["code"]) < 60
    bits = [np.array([np.frombuffer(r["code"], np.uint8) for r in t]) for t in (full, sorted(short[1], key=lambda r: r["doc_id"]))]
    far = [np.bitwise_count(b[:, None] ^ b[None]).sum(axis=2, dtype=int) for b in bits]
    assert (far[0] == far[1]).all()
    same = spark.createDataFrame([(1, [1.0] * 32), (2, [2.0] * 32)], "doc_id bigint, embedding array<double>")
    assert [len(r["code"]) for r in codes.without_common_bits(codes.flyhash_index(same))[0].collect()] == [0, 0]
    found = [codes.flyhash_rerank_knn(asked, rows, 4, 60, tolerance=None, limit=limit).orderBy("query_id", "rank").collect() for limit in (None, 30_000)]
    assert found[0] == found[1] and len(found[0]) == 360
    pair = codes.hamming_knn(same.withColumnRenamed("doc_id", "query_id"), same, 2, tolerance=None).collect()
    assert {r["distance"] for r in pair} == {0.0} and len(pair) == 4
