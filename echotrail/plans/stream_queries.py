"""Streams run to completion over files derived from the tables, with the batch SQL as their twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.plans.governance_queries import QUEUE_CTE, planted
from echotrail.plans.inputs import table
from echotrail.plans.registry import SQL, query
from echotrail.plans.report_queries import states
from echotrail.plans.search_queries import BM25_CTE, TERMS, terms
from echotrail.plans.vault_queries import history_lines
from echotrail.sources.files import scratch_path
from echotrail.sources.vault import Vault
from echotrail.streaming import jobs
from echotrail.streaming.processors import state_partitions


FILE_ROWS, FILES_PER_BATCH = 500_000, 2


def as_stream(spark: SparkSession, rows: DataFrame, *order: str) -> DataFrame:
    """Write rows to files in arrival order and read those files as a stream, two per micro-batch.

    Files are ranges of ``order`` and get modification times in that order, which is how the file
    source sorts them. So a micro-batch, and with it any key's share of it, is bounded.
    """
    path = scratch_path(spark, "stream-in")
    files = max(4, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, *order).write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(parts):
        stamp = 1_700_000_000_000 + 1000 * i
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), stamp, stamp)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def finish(stream: DataFrame) -> DataFrame:
    """Run a stream over all available files into Parquet, and return what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    with state_partitions(spark):
        job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, sink) -> None:
    state = scratch_path(stream.sparkSession, "stream-state")
    with state_partitions(stream.sparkSession):
        job = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    job.awaitTermination()


@query("drift_guard_stream", SQL["residual_drift_guard"])
def _drift(spark, sf):
    s = as_stream(spark, states(spark, sf).drop("aligned"), "ts", "event_id")
    out = finish(jobs.drift_guard_stream(s, "user_id", ["ts", "event_id"]))
    baseline = F.when(F.isnan("drift_baseline"), None).otherwise(F.round("drift_baseline", 6))
    return out.select("event_id", "user_id", "drift_active", "drift_reason", baseline.alias("drift_baseline"))


@query("shell_history_stream", SQL["shell_history"])
def _history(spark, sf):
    s = as_stream(spark, history_lines(spark, sf), "ts", "event_id")
    return finish(jobs.shell_history_stream(s, "user_id", ["ts", "event_id"])).select("user_id", "event_id", "text")


@query("daily_cap_stream", SQL["daily_request_cap"])
def _cap(spark, sf):
    s = as_stream(spark, table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", "event_id")
    return finish(jobs.daily_cap_stream(s, "user_id", "ts", ["ts", "event_id"], 3)).select("event_id", "user_id", "allowed")


CAPTURED_SQL = """captured AS (SELECT event_id, user_id, ts, event_type AS source, CASE event_type WHEN 'click' THEN 'press ' || user_id % 2 ELSE event_type || ' ' || (value::INT % 3) END AS text FROM events)"""


def captured(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("press "), (F.col("user_id") % 2).cast("string"))).otherwise(
        F.concat(kind, F.lit(" "), (F.bround("value").cast("int") % 3).cast("string")))
    return e.select("event_id", "user_id", "ts", kind.alias("source"), text.alias("text"))


@query("capture_stream", f"""WITH {CAPTURED_SQL}, kept AS (SELECT * FROM captured WHERE source <> 'signup' AND NOT contains(lower(text), 'view 2')),
   marked AS (SELECT *, lag(text) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM kept)
   SELECT event_id, text, source FROM marked WHERE previous IS NULL OR previous <> text""")
def _capture(spark, sf):
    """Source to vault: exclusions, consecutive repeats, event contract, idempotent append, mirror."""
    stream = jobs.capture_stream(as_stream(spark, captured(spark, sf), "ts", "event_id"), "user_id", ["ts", "event_id"], ["signup"], ["VIEW 2"])
    rows = stream.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("clip_"), F.col("event_id").cast("string")).alias("id"), F.lit("clipboard").alias("type"), "source",
        F.lit(None).cast("string").alias("project"), "text", F.lit("{}").alias("metadata"), F.col("ts").cast("timestamp").alias("timestamp"))
    vault, hot = Vault(spark, scratch_path(spark, "vault")), Vault(spark, scratch_path(spark, "hot"))
    sink = jobs.capture_sink(vault, lambda t: vx.hash_embedding(t, 8), mirror=hot)
    run_batches(rows, sink)
    both = vault.rows("main").join(hot.rows("hot").select("doc_id"), "doc_id", "left_semi")
    return both.select(F.substring("doc_id", 6, 20).cast("bigint").alias("event_id"), F.col("document").alias("text"),
                       F.get_json_object("metadata", "$.source").alias("source"))


CONTRACT_SQL = """b AS (SELECT doc_id AS pos, 'e' || (doc_id % 300) AS id, CASE WHEN doc_id % 41 = 0 THEN 'poem' ELSE 'note' END AS type, source,
     CASE WHEN doc_id % 300 < 200 THEN 'same' ELSE lang END AS text FROM documents),
   good AS (SELECT * FROM b WHERE type = 'note'), first AS (SELECT id, min(pos) AS pos FROM good GROUP BY id), f AS (SELECT g.* FROM good g JOIN first USING (id, pos))"""


@query("add_event_contract", f"""WITH {CONTRACT_SQL}
   SELECT b.pos, CASE WHEN b.type <> 'note' THEN 'invalid' WHEN b.pos = f.pos THEN 'accepted' WHEN b.text = f.text AND b.source = f.source THEN 'same' ELSE 'conflict' END AS outcome
   FROM b LEFT JOIN f ON f.id = b.id""")
def _contract(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    batch = d.select(
        n.alias("pos"), F.concat(F.lit("e"), (n % 300).cast("string")).alias("id"), F.when(n % 41 == 0, "poem").otherwise("Note").alias("type"), "source",
        F.lit(None).cast("string").alias("project"), F.when(n % 300 < 200, "same").otherwise(F.col("lang")).alias("text"),
        F.lit('{"k":1}').alias("metadata"), F.lit(None).cast("timestamp").alias("timestamp"))
    nothing = batch.filter("pos < 0").select("id", "type", "source", "project", "text", "metadata", "timestamp")
    out = None
    for name, part in jobs.add_events(batch, nothing).items():
        piece = part.select("pos", F.lit(name).alias("outcome"))
        out = piece if out is None else out.unionByName(piece)
    return out


PAYLOAD_SQL = """p AS (SELECT event_id, 'n' || (user_id % 12) AS node_id, 'x' || (value::INT % 25) AS nonce, CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE 'k' || (user_id % 12) END AS public_key,
     CASE WHEN event_id % 23 = 0 THEN '' ELSE 's' END AS signature, ts, event_type AS target_error, 'do ' || event_id AS fix_script FROM events),
   j AS (SELECT *, CASE WHEN signature = '' THEN 'missing node_id, signature, or nonce' WHEN node_id IN ('n9', 'n10', 'n11') THEN 'device is not trusted' WHEN public_key <> 'k' || substr(node_id, 2) THEN 'public key mismatch' END AS refusal FROM p),
   v AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN row_number() OVER (PARTITION BY node_id, nonce, refusal ORDER BY ts, event_id) > 1 THEN 'replay nonce' ELSE 'verified' END AS verdict FROM j)"""


def payloads(spark, sf):
    e = table(spark, sf, "events")
    node = (F.col("user_id") % 12).cast("string")
    return e.select(
        "event_id", F.concat(F.lit("n"), node).alias("node_id"), F.concat(F.lit("x"), (F.bround("value").cast("int") % 25).cast("string")).alias("nonce"),
        F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.concat(F.lit("k"), node)).alias("public_key"),
        F.when(F.col("event_id") % 23 == 0, "").otherwise("s").alias("signature"), "ts", F.col("event_type").alias("target_error"),
        F.concat(F.lit("do "), F.col("event_id").cast("string")).alias("fix_script"))


def devices(spark, sf):
    """Nodes seen in the events: the last ones are unknown, one is revoked."""
    node = (F.col("user_id") % 12).cast("int")
    seen = table(spark, sf, "events").select(node.alias("n")).distinct().filter("n < 11")
    return seen.select(F.concat(F.lit("n"), F.col("n").cast("string")).alias("node_id"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("public_key"),
                       (F.col("n") >= 9).alias("revoked"))


@query("replay_guard", f"WITH {PAYLOAD_SQL} SELECT event_id, node_id, verdict FROM v")
def _replay(spark, sf):
    s = as_stream(spark, payloads(spark, sf), "ts", "event_id")
    return finish(jobs.replay_guard(s, devices(spark, sf), ["ts", "event_id"])).select("event_id", "node_id", "verdict")


@query("knowledge_inbox", f"WITH {PAYLOAD_SQL} SELECT event_id, node_id, fix_script, 'pending' AS status, sha256(target_error) AS target_error_hash FROM v WHERE verdict = 'verified'")
def _inbox(spark, sf):
    s = as_stream(spark, payloads(spark, sf), "ts", "event_id")
    return finish(jobs.knowledge_inbox(s, devices(spark, sf), ["ts", "event_id"])).select("event_id", "node_id", "fix_script", "status", "target_error_hash")


@query("import_increment", """SELECT 'd' || (doc_id % 700) AS doc_id, count(*) AS offered FROM documents WHERE doc_id % 5 <> 2 GROUP BY 1""")
def _import(spark, sf):
    """Packets of five devices; our own are skipped, known ids are skipped."""
    d = table(spark, sf, "documents")
    path = scratch_path(spark, "packets")
    d.select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("id"), F.col("text").alias("document"), F.lit("{}").alias("metadata"),
             F.concat(F.lit("dev"), (F.col("doc_id") % 5).cast("string")).alias("device")).write.partitionBy("device").json(path)
    own = _prefix_files(spark, path)
    vault = Vault(spark, scratch_path(spark, "vault"))
    stream = jobs.increment_source(spark, own, "dev2")
    run_batches(stream, jobs.import_sink(vault, lambda t: vx.hash_embedding(t, 8)))
    # An id of our own device would show with no foreign offer, a repeated import as a second row.
    offered = d.filter("doc_id % 5 <> 2").groupBy(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("doc_id")).agg(F.count("*").alias("offered"))
    return vault.rows("main").select("doc_id").join(offered, "doc_id", "left").fillna(0, ["offered"])


def _prefix_files(spark, path: str) -> str:
    """Name each packet file after its device, as exporters do."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            device = folder.getPath().getName().split("=")[1]
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("part-"):
                    fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"{device}_{name}"))
    return path


@query("retention_sweep", """SELECT 'clip_' || event_id AS doc_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 DAY""")
def _sweep(spark, sf):
    """Fill a vault, forget what is older than twelve days, show what is left."""
    e = table(spark, sf, "events")
    vault = Vault(spark, scratch_path(spark, "vault"))
    rows = e.select(
        F.col("event_id").alias("pos"), F.lit("main").alias("collection"), F.concat(F.lit("clip_"), F.col("event_id").cast("string")).alias("doc_id"),
        F.col("event_type").alias("document"), F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("embedding"),
        F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))).alias("metadata"))
    vault.ingest(rows)
    jobs.apply_retention(vault, 12, e.agg(F.max("ts")).first()[0])
    return vault.rows("main").select("doc_id")


@query("consolidation_run", f"WITH {QUEUE_CTE} SELECT doc_id, class, outgoing FROM queue")
def _consolidation_run(spark, sf):
    """Documents arrive in batches that each set off a consolidation: the queue of all runs, as far as summaries stand for what they replaced."""
    rows = planted(spark, sf).select("doc_id", F.col("text").alias("document"))
    arriving = as_stream(spark, rows, "doc_id").withColumn("embedding", vx.hash_embedding(F.coalesce("document", F.lit("")), 64))
    vault = Vault(spark, scratch_path(spark, "vault"))
    run_batches(arriving, jobs.consolidation_sink(vault, every=1))
    stood_for = jobs.consolidated(vault, "summaries").agg(F.sum("n")).first()[0]
    replaced = jobs.consolidated(vault, "replaced")
    if stood_for is not None and stood_for != replaced.select("doc_id").distinct().count():
        raise ValueError("summaries and replaced documents differ")
    return jobs.consolidated(vault, "queue").select("doc_id", "class", "outgoing")


@query("consolidation_trigger", """SELECT (count(*) // 500)::BIGINT AS runs, count(*) AS events FROM events""")
def _trigger(spark, sf):
    """Events arrive in several files; each five hundred set off one consolidation."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    vault = Vault(spark, scratch_path(spark, "vault"))
    fired: list[int] = []
    run_batches(as_stream(spark, e, "event_id"), jobs.consolidation_trigger(vault, fired.append))
    total = spark.read.parquet(f"{vault.path}/counters").agg(F.sum("n").alias("events"))
    return total.select(F.lit(sum(fired)).cast("long").alias("runs"), "events")


TRACEBACK_SQL = BM25_CTE.replace(
    f"SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark",
    f"""SELECT DISTINCT query_id, unnest({TERMS}) AS term FROM (
      SELECT event_id AS query_id, array_to_string(list_slice(string_split(body, chr(10)), -10, -1), chr(10)) AS text FROM (
        SELECT *, lag(body) OVER (PARTITION BY conv_id ORDER BY event_id) AS before FROM (
          SELECT conv_id * 1000 + turn AS event_id, conv_id, text || chr(10) || 'Exception: ' || role AS body FROM conversations))
      WHERE before IS NULL OR before <> body)""")


@query("traceback_lookup", f"WITH {TRACEBACK_SQL} SELECT query_id, rank, doc_id, round(score, 9) AS score FROM bmr WHERE rank <= 1")
def _lookup(spark, sf):
    """Turns that show an exception, searched by their last ten lines; hits follow the term ranking."""
    c = table(spark, sf, "conversations")
    shown = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "conv_id", F.concat(F.col("text"), F.lit("\nException: "), F.col("role")).alias("text"))
    stream = jobs.traceback_triggers(as_stream(spark, shown, "event_id"), "conv_id", ["event_id"])
    out = scratch_path(spark, "hits")
    run_batches(stream, jobs.traceback_sink(terms(spark, sf, "bm25"), out))
    return spark.read.parquet(out).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))
