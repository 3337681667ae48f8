"""Streams over several micro-batches give what one batch gives; restarts add nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.plans.stream_queries import finish, run_batches
from echotrail.sources.files import scratch_path
from echotrail.sources.vault import Vault
from echotrail.streaming import jobs


def many_files(spark, df, key, files):
    """One file per micro-batch, in order."""
    path = scratch_path(spark, "in")
    for part in range(files):
        df.filter(F.col(key) % files == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_drift_state_survives_batches(spark):
    from echotrail.operators.temporal import residual_drift_guard

    rows = [(b, k, b * 100 + i, 0.2 if b < 3 else 0.7, "cloud", True) for b in range(6) for k in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "b int, k int, t int, residual double, route string, is_aligned boolean")
    got = finish(jobs.drift_guard_stream(many_files(spark, df, "b", 6), "k", ["t"])).select("k", "t", "drift_active", "drift_reason")
    want = residual_drift_guard(df, "k", ["t"]).select("k", "t", "drift_active", "drift_reason")
    assert got.count() == 120 and got.exceptAll(want).count() == 0 and got.filter("drift_active").count() > 0


def test_nonces_are_remembered_across_batches(spark):
    rows = [(b, i, "n1", f"x{i}", "k", "s") for b in range(3) for i in range(5)] + [(2, 99, "n2", "x", "k", "s")]
    df = spark.createDataFrame(rows, "b int, t int, node_id string, nonce string, public_key string, signature string")
    known = spark.createDataFrame([("n1", "k", False), ("n2", "k", True)], "node_id string, public_key string, revoked boolean")
    got = finish(jobs.replay_guard(many_files(spark, df, "b", 3), known, ["b", "t"])).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"verified": 5, "replay nonce": 10, "device is not trusted": 1}


def test_capture_to_vault_twice(spark):
    rows = [(i, "u", f"text {i // 2}", "clipboard", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, host string, text string, source string, b int")
    vault, hot = Vault(spark, scratch_path(spark, "v")), Vault(spark, scratch_path(spark, "h"))
    sink = jobs.capture_sink(vault, lambda t: vx.hash_embedding(t, 8), mirror=hot, quarantine=f"{vault.path}/refused")
    for _ in range(2):
        stream = jobs.capture_stream(many_files(spark, df.withColumn("b", F.lit(0)), "b", 1), "host", ["event_id"])
        events = stream.select(
            F.col("event_id").alias("pos"), F.concat(F.lit("clip_"), F.col("event_id").cast("string")).alias("id"), F.lit("clipboard").alias("type"), "source",
            F.lit(None).cast("string").alias("project"), "text", F.lit("{}").alias("metadata"), F.lit(None).cast("timestamp").alias("timestamp"))
        run_batches(events, sink)
    assert vault.rows("main").count() == 15 and hot.rows("hot").count() == 15


def test_budget_resets_by_day(spark):
    rows = [(i, "a", datetime(2024, 1, 1) + timedelta(hours=6 * i), i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id int, k string, ts timestamp, b int")
    stream = many_files(spark, df.withColumn("b", F.when(F.col("event_id") < 3, 0).otherwise(1)), "b", 2)
    got = {r["event_id"]: r["allowed"] for r in finish(jobs.daily_cap_stream(stream, "k", "ts", ["event_id"], 2)).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, True, True, False, False]


def test_history_window_crosses_batches(spark):
    lines = ["make", "ls", "make", ": 1700000000:0;git push", "git push", "q"] + [f"run {i}" for i in range(20)] + ["make"]
    df = spark.createDataFrame([(i, "h", v, 0 if i < 4 else 1) for i, v in enumerate(lines)], "i int, host string, value string, b int")
    got = [r["text"] for r in finish(jobs.shell_history_stream(many_files(spark, df, "b", 2), "host", ["i"])).orderBy("i").collect()]
    assert got == ["make", "git push"] + [f"run {i}" for i in range(20)] + ["make"]


def test_counting_trigger_ignores_repeats(spark):
    vault, fired = Vault(spark, scratch_path(spark, "v")), []
    sink = jobs.consolidation_trigger(vault, fired.append, every=10)
    batch = spark.range(7)
    for batch_id in (0, 1, 1, 2):
        sink(batch, batch_id)
    assert len(fired) == 2


def test_consolidation_runs_once_per_trigger(spark):
    from pyspark.sql import functions as F

    from echotrail.functions import vectors as vx
    from echotrail.operators.consolidate import consolidate_clusters
    from echotrail.operators.governance import enrichment_queue

    vault = Vault(spark, scratch_path(spark, "v"))
    sink = jobs.consolidation_sink(vault, every=10)
    rows = spark.range(24).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("document"))
    rows = rows.withColumn("embedding", vx.hash_embedding(F.col("document"), 16)).cache()
    for batch_id in (0, 1, 1, 2, 0, 3, 3):  # 6 + 6 set one off, 6 do not, 6 more do
        sink(rows.filter(F.floor(F.col("doc_id") / 6) == batch_id), batch_id)
    assert sorted({r["batch_id"] for r in jobs.consolidated(vault, "queue").collect()}) == [1, 3]
    for batch_id, part in ((1, rows.filter("doc_id < 12")), (3, rows.filter("doc_id >= 12"))):
        summaries, replaced = consolidate_clusters(part.withColumnRenamed("document", "text"))
        own = lambda name: jobs.consolidated(vault, name).filter(F.col("batch_id") == batch_id).drop("batch_id")
        assert sorted(r["text"] for r in own("summaries").collect()) == sorted(r["text"] for r in summaries.collect())
        assert {r["doc_id"] for r in own("replaced").collect()} == {r["doc_id"] for r in replaced.collect()}
        assert {r["doc_id"] for r in own("queue").collect()} == {r["doc_id"] for r in enrichment_queue(part).collect()}


def test_budget_state_holds_open_days_only(spark):
    """Two keys over thirty days, one batch a day, one row four days late and one a day late."""
    rows = [(d * 10 + i, k, datetime(2024, 1, 1) + timedelta(days=d, hours=i), d) for d in range(30) for k in ("a", "b") for i in range(3)]
    rows += [(9001, "a", datetime(2024, 1, 15, 12), 15), (9002, "a", datetime(2024, 1, 11, 12), 15)]
    df = spark.createDataFrame(rows, "event_id int, k string, ts timestamp, b int")
    out = scratch_path(spark, "out")
    stream = jobs.daily_cap_stream(many_files(spark, df, "b", 30), "k", "ts", ["event_id"], 2, late="2 days")
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {(r["event_id"], r["k"]): r["allowed"] for r in spark.read.parquet(out).collect()}
    assert got[(9001, "a")] is False and (9002, "a") not in got
    assert len(got) == 30 * 3 * 2 + 1 and sum(got.values()) == 30 * 2 * 2
    held = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert held[-1] <= 3 * max(held[:4])
