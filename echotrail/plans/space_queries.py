"""Embedding-space analytics, loops, consolidation and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.operators import aggregates as ag, consolidate as co, embedding_space as es, evaluation as q, topology as tda
from echotrail.operators.moments import map_vectors
from echotrail.plans.inputs import table
from echotrail.plans.registry import query
from echotrail.plans.search_queries import corpus, hash_sql
from echotrail.session import spread

DIM = 64


def aligned_pairs(spark, sf):
    """Each vector beside a rotated, shifted and slightly jittered copy: the copy is the cloud space."""
    e = table(spark, sf, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("local"))
    key = es.CayleyRotation(DIM, seed=3)
    turned = map_vectors(e.withColumn("_x", F.col("local")), "_x", "cloud", key.rotate).drop("_x")
    return turned.withColumn("cloud", F.transform("cloud", lambda x, i: x + 0.5 + 0.01 * F.sin(i * 7 + F.col("vec_id"))))


@query("procrustes_fit")
def _fit(spark, sf):
    """Fit report; the SVD has no SQL form."""
    fit = es.procrustes_fit(aligned_pairs(spark, sf))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in fit.metrics.items()], "metric string, value double")


@query("procrustes_apply")
def _apply(spark, sf):
    pairs = aligned_pairs(spark, sf)
    fit = es.procrustes_fit(pairs, report=False)
    back = es.procrustes_apply(es.procrustes_apply(pairs, fit), fit, "aligned", "returned", inverse=True)
    gap = vx.norm(F.zip_with("returned", "cloud", lambda x, y: x - y))
    return back.select("vec_id", F.round(F.col("aligned")[0], 6).alias("first"), (gap < 1e-9).alias("round_trip"))


@query("procrustes_score")
def _score(spark, sf):
    pairs = aligned_pairs(spark, sf)
    s = es.procrustes_score(pairs, es.procrustes_fit(pairs, report=False))
    return s.select(F.round("correlation", 6).alias("correlation"), F.round("mse", 6).alias("mse"), "pairs")


@query("alignment_drift_check")
def _check(spark, sf):
    fit = es.procrustes_fit(aligned_pairs(spark, sf))
    beyond = es.alignment_drift_check(fit.metrics, DIM)
    return spark.createDataFrame([(m, m in beyond) for m in ("entropy", "condition_number", "mse", "correlation")], "metric string, beyond boolean")


@query("procrustes_leak_probe")
def _probe(spark, sf):
    plain = corpus(spark, sf)
    secret = es.rotate_corpus(plain.withColumn("embedding", vx.doubles(F.col("embedding"))), es.CayleyRotation(DIM, seed=9))
    return es.procrustes_leak_probe(plain, secret).withColumn("mean_cosine", F.round("mean_cosine", 6))


@query("rotate_corpus", "SELECT vec_id AS doc_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, true AS restored FROM embeddings")
def _rotate(spark, sf):
    """A rotation keeps norms and its inverse restores the vectors, which plain SQL can state."""
    key = es.CayleyRotation(DIM, seed=11)
    base = corpus(spark, sf).select("doc_id", vx.doubles(F.col("embedding")).alias("plain"))
    turned = map_vectors(base, "plain", "turned", key.rotate)
    back = map_vectors(turned, "turned", "back", key.inverse)
    gap = vx.norm(F.zip_with("back", "plain", lambda x, y: x - y))
    return back.select("doc_id", F.round(vx.norm(F.col("turned")), 6).alias("norm"), (gap < 1e-9).alias("restored"))


@query("sketch_corpus")
def _sketch(spark, sf):
    key = es.CayleyRotation(DIM, seed=11)
    both = es.srht_corpus(es.sketch_corpus(corpus(spark, sf), key), 32, 5, target="mixed")
    return both.select("doc_id", F.size("sketch").alias("subspace_dim"), F.size("mixed").alias("srht_dim"), F.round(vx.norm(F.col("mixed")), 6).alias("srht_norm"))


@query("quantize_corpus", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
   s AS (SELECT *, (list_max(v) - list_min(v)) / 255.0::DOUBLE AS scale FROM v), z AS (SELECT *, round_even(-list_min(v) / scale, 0) - 128 AS zp FROM s),
   c AS (SELECT *, list_transform(v, lambda x: greatest(-128, least(127, round_even(x / scale, 0) + zp))) AS code FROM z)
   SELECT vec_id AS doc_id, round(scale, 9) AS scale, zp AS zero_point, list_sum(code)::BIGINT AS code_sum,
     round(list_avg(list_transform(v, lambda x, i: abs(x - scale * (code[i] - zp)))), 9) AS error,
     round(len(list_filter(v, lambda x: abs(x) < 0.05)) / 64.0::DOUBLE, 6) AS sparsity FROM c""")
def _quantize(spark, sf):
    z = es.quantize_corpus(corpus(spark, sf))
    _, ratio = es.sparsify(F.col("embedding"), 0.05)
    return z.select("doc_id", F.round("scale", 9).alias("scale"), "zero_point", F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"),
                    F.round("error", 9).alias("error"), F.round(ratio, 6).alias("sparsity"))


@query("corpus_norm_stats", """SELECT vec_id AS doc_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE 1 / sqrt(list_dot_product(v, v)) END, 6) AS inverse
   FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def _norms(spark, sf):
    n = vx.norm(vx.doubles(F.col("embedding")))
    return corpus(spark, sf).select("doc_id", F.round(n, 6).alias("norm"), F.round(F.when(n == 0, 0.0).otherwise(1.0 / n), 6).alias("inverse"))


@query("gated_correction_model")
def _gate(spark, sf):
    pairs = aligned_pairs(spark, sf)
    r = es.gated_correction_model(pairs, ["vec_id"])
    return spark.createDataFrame([(r["samples"], r["train_samples"], r["holdout_samples"], r["graduated"], r["reason"])],
                                 "samples bigint, train_samples bigint, holdout_samples bigint, graduated boolean, reason string")


@query("replay_gate_report")
def _replay(spark, sf):
    """Stable and drifted tails made from the vectors; the newest quarter drifts."""
    e = table(spark, sf, "embeddings")
    newest = e.agg((F.max("vec_id") * 0.75).alias("edge"))
    zero = F.transform(vx.doubles(F.col("embedding")), lambda x: x * 0.0)
    pairs = e.crossJoin(F.broadcast(newest)).select(
        "vec_id", vx.doubles(F.col("embedding")).alias("local"), zero.alias("steady"),
        F.transform(zero, lambda x: x + F.when(F.col("vec_id") >= F.col("edge"), 5.0).otherwise(0.0)).alias("drifted"))
    report = es.replay_gate_report(pairs, ["vec_id"], es.GateSettings(loss=0.5, holdout_fraction=0.25))
    return report.withColumn("holdout_loss", F.round("holdout_loss", 4))


@query("leakage_report")
def _leakage(spark, sf):
    return es.leakage_report(corpus(spark, sf), es.CayleyRotation(DIM, seed=21)).withColumn("value", F.round("value", 4))


@query("loop_detection")
def _loops(spark, sf):
    """Loops among the turns of each conversation; persistence has no SQL form."""
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id").select(
        "conv_id", F.col("turn").alias("doc_id"), vx.hash_embedding(F.col("text"), DIM).alias("embedding"))
    return tda.loop_detection(turns, "conv_id", ["doc_id"], span=0.02).withColumn("loop_docs", F.array_join(F.col("loop_docs").cast("array<string>"), ","))


@query("consolidate_clusters")
def _consolidate(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumn("embedding", vx.hash_embedding(F.col("text"), DIM))
    summaries, replaced = co.consolidate_clusters(d)
    return summaries.select("cluster", "n", F.length("text").alias("n_chars"))


MODES_SQL = """modes AS (SELECT event_type AS mode, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, round(1 - avg(value) / 400, 6) AS recall_at_k,
   count(*) * 100 AS storage_bytes FROM events GROUP BY event_type)"""


def modes(spark, sf):
    """Events as measured runs: one mode per event type, the value as latency."""
    e = table(spark, sf, "events")
    return measured(e.select(F.col("event_type").alias("mode"), "value"), "mode").withColumn("storage_bytes", F.col("n") * 100)


def measured(runs, group):
    """Latency percentiles and a recall stand-in per group of runs."""
    quality = runs.groupBy(group).agg(F.round(1 - F.avg("value") / 400, 6).alias("recall_at_k"))
    return ag.latency_summary(runs, group, "value").join(quality, group)


@query("mode_leaderboard", f"""WITH {MODES_SQL}, b AS (SELECT p50_ms AS b50, p95_ms AS b95 FROM modes WHERE mode = 'view'),
   s AS (SELECT modes.*, CASE WHEN mode = 'view' THEN 1.0 ELSE b50 / p50_ms END AS s50, CASE WHEN mode = 'view' THEN 1.0 ELSE b95 / p95_ms END AS s95 FROM modes, b),
   w AS (SELECT max_by(mode, (s95, mode)) AS best FROM s WHERE mode NOT IN ('view', 'click'))
   SELECT mode, round(s50, 6) AS p50_speedup, round(s95, 6) AS p95_speedup, best AS best_mode, mode = best AS is_best,
     mode = best AND recall_at_k >= 0.8 AND s50 >= 0.9 AND s95 >= 0.9 AND p95_ms <= 500 AND storage_bytes <= 100000000 AS achieved FROM s, w""")
def _leaderboard(spark, sf):
    gates = {"recall": 0.8, "speedup": 0.9, "latency_ms": 500.0, "storage_bytes": 100_000_000}
    out = q.mode_leaderboard(modes(spark, sf), "view", ["click"], gates)
    return out.select("mode", F.round("p50_speedup", 6).alias("p50_speedup"), F.round("p95_speedup", 6).alias("p95_speedup"), "best_mode", "is_best", "achieved")


@query("rank_configurations", """WITH r AS (SELECT 's' || (user_id % 3) AS stage, event_type AS config, quantile_cont(value, 0.95) AS p95_ms, 1000 / quantile_cont(value, 0.5) AS p95_speedup,
     round(1 - avg(value) / 400, 6) AS recall_at_k, count(*) AS storage_bytes FROM events GROUP BY ALL),
   o AS (SELECT *, recall_at_k >= 0.87 AS ok, row_number() OVER (PARTITION BY stage ORDER BY (recall_at_k >= 0.87) DESC, p95_speedup DESC, p95_ms, storage_bytes) AS place FROM r)
   SELECT stage, config, ok AS pass_recall, place, ok AND sum(ok::INT) OVER (PARTITION BY stage ORDER BY place) <= 2 AS promoted FROM o""")
def _configs(spark, sf):
    e = table(spark, sf, "events")
    stage = F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))
    runs = e.select(F.concat_ws("|", stage, "event_type").alias("run"), "value")
    r = measured(runs, "run").select(
        F.split("run", r"\|")[0].alias("stage"), F.split("run", r"\|")[1].alias("config"), "p95_ms", (1000 / F.col("p50_ms")).alias("p95_speedup"),
        "recall_at_k", F.col("n").alias("storage_bytes"))
    return q.rank_configurations(r, 0.87, 2).select("stage", "config", "pass_recall", "place", "promoted")


@query("smoke_gates", f"""WITH {MODES_SQL} SELECT mode, p95_ms < 100 AS p95_search_under_100ms, recall_at_k >= 0.98 AS recall_at_10_gte_0_98,
   p50_ms * 100 < 5000 AS cold_open_under_5s, p50_ms / 30 <= 1.25 AS insert_regression_under_25pct FROM modes""")
def _smoke(spark, sf):
    m = modes(spark, sf).withColumn("cold_open_ms", F.col("p50_ms") * 100).withColumn("insert_ratio", F.col("p50_ms") / 30)
    return q.smoke_gates(m)
