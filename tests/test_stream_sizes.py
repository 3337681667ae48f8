"""Work of the streams follows rows and buckets, not keys; searches behind a report run once."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echotrail.operators import evaluation as ev, temporal as tp
from echotrail.operators.ordered import fold_ordered
from echotrail.streaming import jobs, processors as ps
from tests.test_streams import many_files


def test_keys_share_calls_and_state_rows(spark):
    """5000 keys in two batches: no more state rows than buckets, and the verdicts of the batch twin."""
    df = spark.range(20000).select((F.col("id") % 2).alias("b"), (F.col("id") % 5000).alias("k"), F.col("id").alias("t"),
                                   (F.rand(3) * 0.5).alias("residual"), F.lit("cloud").alias("route"), F.lit(True).alias("is_aligned")).cache()
    stream = jobs.drift_guard_stream(many_files(spark, df, "b", 2), "k", ["b", "t"])
    out = "memory_guard"
    with ps.state_partitions(spark):
        job = stream.writeStream.format("memory").queryName(out).trigger(availableNow=True).start()
    job.awaitTermination()
    assert job.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= ps.BUCKETS
    names = ["k", "t", "drift_active", "drift_reason", "drift_baseline"]
    got, want = spark.table(out).select(*names), tp.residual_drift_guard(df, "k", ["b", "t"]).select(*names)
    assert got.count() == 20000 and got.exceptAll(want).count() == 0


def test_walk_equals_vectors():
    rng, s = np.random.default_rng(0), tp.DriftSettings()
    for _ in range(200):
        one, other = tp.Guard(), tp.Guard()
        for _ in range(3):
            n = int(rng.integers(1, 120))
            rows = pd.DataFrame({"residual": np.abs(rng.normal(rng.choice([0.2, 0.5]), rng.choice([0.01, 0.1, 0.3]), n)),
                                 "route": rng.choice(["cloud", "x"], n, p=[0.7, 0.3]), "is_aligned": rng.random(n) < 0.9})
            want = tp.drift_rows(rows, one, s)
            got, after = tp.drift_keys(rows, [0], [other.dump()], s)
            other = tp.Guard.load(after[0])
            assert one == other and (got["drift_reason"] == want["drift_reason"]).all()
            assert got["drift_baseline"].equals(want["drift_baseline"])


def test_short_keys_share_tasks(spark):
    calls = spark.sparkContext.accumulator(0)

    def many(rows, starts, before):
        calls.add(1)
        assert before == [None] * len(starts)
        return rows.assign(nth=np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))), [""] * len(starts)

    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("t"))
    got = fold_ordered(df, ["k"], ["t"], None, df.withColumn("nth", F.lit(0).cast("long")).schema, 1000, many)
    assert got.filter("nth <> floor(t / 1000)").count() == 0 and got.count() == 3000
    assert calls.value <= 2 * 12


def test_report_searches_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def search(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = spark.range(40).select(F.lit("m").alias("method"), F.floor(F.col("id") / 10).alias("query_id"), (F.col("id") % 10 + 1).alias("rank"), F.col("id").alias("doc_id"))
    cases = spark.range(4).select(F.col("id").alias("query_id"), F.lit("s").alias("split"), F.array(F.col("id") * 10 + 2).alias("relevant"))
    got = ev.hit_report(cases, rows.mapInArrow(search, rows.schema)).first()
    assert got["answerable_queries"] == 4 and abs(got["mrr_at_10"] - 1 / 3) < 1e-9
    assert calls.value == 40


def test_ingest_counts_follow_the_contract(spark, folder):
    from echotrail.sources.vault import Vault, ingest_documents

    vault = Vault(spark, folder)
    rows = spark.range(60).select(F.col("id").alias("pos"), F.lit("main").alias("collection"), F.concat(F.lit("d"), F.col("id") % 40).alias("doc_id"),
                                  F.lit("text").alias("document"), F.array(F.when(F.col("id") % 9 == 4, float("nan")).otherwise(1.0).cast("float")).alias("embedding"))
    vault.ingest(rows.filter("pos < 10"))
    vault.forget(spark.createDataFrame([("d1",), ("d2",)], "doc_id string"), "main")
    want = {k: v.count() for k, v in ingest_documents(rows, vault._read("documents", Vault.SCHEMA), vault.tombstones()).items()}
    assert vault.ingest(rows) == want and min(want.values()) > 0
    assert vault.ingest(rows)["accepted"] == 0


def test_capture_reads_only_stored_events_that_come_again(spark, folder, monkeypatch):
    from echotrail.functions import vectors as vx
    from echotrail.sources.vault import Vault

    vault, seen = Vault(spark, folder), []
    plain = jobs.add_events
    monkeypatch.setattr(jobs, "add_events", lambda batch, existing: seen.append(existing.count()) or plain(batch, existing))
    sink = jobs.capture_sink(vault, lambda t: vx.hash_embedding(t, 8))
    for batch_id, (low, high) in enumerate([(0, 50), (50, 90), (85, 100)]):
        sink(spark.range(low, high).select(
            F.col("id").alias("pos"), F.concat(F.lit("clip_"), F.col("id")).alias("id"), F.lit("clipboard").alias("type"), F.lit("s").alias("source"),
            F.lit(None).cast("string").alias("project"), F.lit("text").alias("text"), F.lit("{}").alias("metadata"), F.lit(None).cast("timestamp").alias("timestamp")), batch_id)
    assert seen == [0, 0, 5] and vault.rows("main").count() == 100
