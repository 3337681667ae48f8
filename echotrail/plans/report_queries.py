"""Telemetry windows, hash chains, reports and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.operators import aggregates as ag, chain as ch, evaluation as q, temporal as tp
from echotrail.operators.knn import knn, truncated
from echotrail.plans.inputs import events_sql, table, vault_events
from echotrail.plans.registry import query
from echotrail.plans.search_queries import COSINE, all_vectors, corpus, knn_sql, pairs_sql
from echotrail.session import cut_lineage

# --- telemetry ----------------------------------------------------------------------------

STATES_CTE = """states AS (SELECT event_id, user_id, ts, sqrt(value) / 10 AS residual,
   CASE WHEN event_type IN ('view','click') THEN 'cloud' WHEN event_type = 'error' THEN 'local' WHEN event_type = 'signup' THEN 'cache' ELSE 'flash' END AS route,
   event_type <> 'error' AS is_aligned, sqrt(event_id % 10) AS adaptive_alpha, sqrt(value) / 5 AS entropy FROM events)"""


def states(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    route = F.when(kind.isin("view", "click"), "cloud").when(kind == "error", "local").when(kind == "signup", "cache").otherwise("flash")
    return e.select(
        "event_id", "user_id", "ts", (F.sqrt("value") / 10).alias("residual"), route.alias("route"),
        (kind != "error").alias("is_aligned"), F.when(kind != "error", F.lit(1)).alias("aligned"),
        F.sqrt(F.col("event_id") % 10).alias("adaptive_alpha"), (F.sqrt("value") / 5).alias("entropy"))


TREND_CTE = STATES_CTE + """, numbered AS (SELECT *, sum(is_aligned::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x,
     CASE WHEN is_aligned THEN residual END AS y FROM states),
   sums AS (SELECT *, count(y) OVER w AS n, count(*) OVER w AS window_rows, regr_slope(y, CASE WHEN is_aligned THEN x::DOUBLE END) OVER w AS slope
     FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
   trends AS (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE coalesce(slope, 0.0) END AS trend FROM sums)"""


def trends(spark, sf):
    return tp.rolling_trend(states(spark, sf), "user_id", ["ts", "event_id"])


@query("rolling_residual_trend", f"WITH {TREND_CTE} SELECT event_id, user_id, round(trend, 6) AS trend, window_rows FROM trends")
def _trend(spark, sf):
    return trends(spark, sf).select("event_id", "user_id", F.round("trend", 6).alias("trend"), "window_rows")


# The drift guard as a recursive walk along each key, all keys at once.
DRIFT_CTE = STATES_CTE.replace("states AS", "raw_states AS", 1) + """,
  states AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM raw_states),
  cloudy AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM states WHERE route = 'cloud' AND is_aligned),
  walk(user_id, i, recent, seen, mean, total, low, baseline, active, recov, reason) AS (
    SELECT DISTINCT user_id, 0::BIGINT, []::DOUBLE[], 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, false, 0::BIGINT, 'insufficient_samples' FROM cloudy
    UNION ALL
    SELECT user_id, i, recent,
      CASE WHEN done THEN 0 ELSE seen END, CASE WHEN done THEN 0.0 ELSE mean END, CASE WHEN done THEN 0.0 ELSE total END, CASE WHEN done THEN 0.0 ELSE low END,
      CASE WHEN n < 8 THEN baseline WHEN baseline IS NULL THEN level WHEN done THEN level
           WHEN active OR triggered THEN baseline ELSE 0.95 * baseline + 0.05 * level END,
      CASE WHEN n < 8 OR baseline IS NULL THEN active WHEN active THEN NOT done ELSE triggered END,
      CASE WHEN n < 8 OR baseline IS NULL THEN recov WHEN active THEN CASE WHEN good THEN recov + 1 ELSE 0 END WHEN triggered THEN 0 ELSE recov END,
      CASE WHEN n < 8 THEN 'insufficient_samples' WHEN baseline IS NULL THEN 'baseline_established'
           WHEN active THEN CASE WHEN done THEN 'recovered' WHEN good THEN 'recovering' ELSE 'residual_drift' END
           WHEN triggered THEN 'residual_drift' ELSE 'stable' END
    FROM (SELECT *, coalesce(active AND good AND recov + 1 >= 3 AND n >= 8 AND baseline IS NOT NULL, false) AS done,
        coalesce((level - baseline) / greatest(abs(baseline), 1e-8) >= 0.15 OR halves >= 0.15 OR total - low >= 0.05, false) AS triggered
      FROM (SELECT *, least(low0, total) AS low, level <= baseline * 1.075 AS good, CASE WHEN n < 16 THEN 0.0 ELSE
          (list_avg(recent[n//2+1:]) - list_avg(recent[:n//2])) / greatest(abs(list_avg(recent[:n//2])), 1e-8) END AS halves
        FROM (SELECT *, total0 + (v - mean - 0.002) AS total, list_sum(recent) / n AS level
          FROM (SELECT *, mean0 + (v - mean0) / seen AS mean, len(recent) AS n
            FROM (SELECT w.user_id, c.i, greatest(0.0, c.residual) AS v, list_append(w.recent, greatest(0.0, c.residual))[-16:] AS recent,
                w.seen + 1 AS seen, w.mean AS mean0, w.total AS total0, w.low AS low0, w.baseline, w.active, w.recov
              FROM walk w JOIN cloudy c ON c.user_id = w.user_id AND c.i = w.i + 1)))))
  ),
  guarded AS (SELECT s.event_id, s.user_id, s.pos, w.active AS drift_active, w.reason AS drift_reason, w.baseline AS drift_baseline
    FROM (SELECT event_id, user_id, pos, (SELECT count(*) FROM cloudy c WHERE c.user_id = s0.user_id AND c.pos <= s0.pos) AS i FROM states s0) s
    JOIN (SELECT * FROM walk UNION ALL SELECT DISTINCT user_id, 0, [], 0, 0, 0, 0, NULL, false, 0, 'insufficient_samples' FROM states
          WHERE user_id NOT IN (SELECT user_id FROM cloudy)) w ON w.user_id = s.user_id AND w.i = s.i)"""


def guarded(spark, sf):
    return tp.residual_drift_guard(states(spark, sf).drop("aligned"), "user_id", ["ts", "event_id"])


@query("residual_drift_guard", f"WITH RECURSIVE {DRIFT_CTE} SELECT event_id, user_id, drift_active, drift_reason, round(drift_baseline, 6) AS drift_baseline FROM guarded")
def _drift(spark, sf):
    g = guarded(spark, sf)
    baseline = F.when(F.isnan("drift_baseline"), None).otherwise(F.round("drift_baseline", 6))
    return g.select("event_id", "user_id", "drift_active", "drift_reason", baseline.alias("drift_baseline"))


HEALTH_CTE = DRIFT_CTE.replace(STATES_CTE.replace("states AS", "raw_states AS", 1), "", 1).lstrip(", \n")
BOTH_CTE = TREND_CTE.replace("states AS", "raw_states AS", 1).replace("FROM states)", "FROM raw_states)", 1) + ", " + HEALTH_CTE


@query("rolling_health", f"""WITH RECURSIVE {BOTH_CTE}
   SELECT event_id, CASE WHEN drift_active THEN 'drift' WHEN window_rows < 3 THEN 'cold' WHEN trend < -0.01 THEN 'converging'
     WHEN trend > 0.02 THEN 'degrading' ELSE 'healthy' END AS health FROM trends JOIN guarded USING (event_id)""")
def _health(spark, sf):
    both = trends(spark, sf).join(guarded(spark, sf).select("event_id", "drift_active"), "event_id")
    return both.select("event_id", tp.health(F.col("drift_active"), F.col("window_rows"), F.col("trend")).alias("health"))


@query("speculative_threshold", f"""WITH RECURSIVE {BOTH_CTE},
   m AS (SELECT *, 0.2 * (1 + greatest(-1, least(1, -trend * 2))) AS moved FROM trends JOIN guarded USING (event_id))
   SELECT event_id, round(CASE WHEN window_rows < 3 THEN 0.2 WHEN drift_active THEN greatest(0.01, least(0.6, least(moved, 0.05)))
     ELSE greatest(0.1, least(0.6, moved)) END, 6) AS threshold FROM m""")
def _threshold(spark, sf):
    both = trends(spark, sf).join(guarded(spark, sf).select("event_id", "drift_active"), "event_id")
    value = tp.speculative_threshold(F.lit(0.2), F.col("drift_active"), F.col("window_rows"), F.col("trend"))
    return both.select("event_id", F.round(value, 6).alias("threshold"))


@query("similarity_baseline_alert", """WITH s AS (SELECT event_id, user_id, greatest(0, 1 - value / 60) AS similarity, row_number() OVER w AS pos,
     avg(greatest(0, 1 - value / 60)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
     FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   b AS (SELECT user_id, m AS baseline FROM s WHERE pos = 20)
   SELECT event_id, round(CASE WHEN pos >= 20 THEN m END, 6) AS mean, coalesce(pos > 20 AND baseline > 1e-5 AND m < baseline * 0.85, false) AS alert
   FROM s LEFT JOIN b USING (user_id)""")
def _alert(spark, sf):
    e = table(spark, sf, "events").withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("value") / 60))
    out = tp.similarity_baseline_alert(e.select("event_id", "user_id", "ts", "similarity"), "user_id", ["ts", "event_id"])
    return out.select("event_id", F.round("mean", 6).alias("mean"), "alert")


@query("route_report", f"""WITH {STATES_CTE}, r AS (SELECT user_id, route, count(*) AS n FROM states GROUP BY ALL),
   s AS (SELECT user_id, string_agg(route || ':' || n, ',' ORDER BY route) AS routes FROM r GROUP BY user_id)
   SELECT user_id, count(*) AS rows, any_value(s.routes) AS routes, round(avg((route IN ('local','speculative','distilled','cache'))::INT), 6) AS skip_rate,
     round(avg(adaptive_alpha), 6) AS mean_alpha, round(avg(entropy), 6) AS mean_entropy,
     round(coalesce(avg(CASE WHEN is_aligned THEN residual END), 0), 6) AS mean_residual FROM states JOIN s USING (user_id) GROUP BY user_id""")
def _routes(spark, sf):
    out = tp.route_report(states(spark, sf), "user_id")
    names = F.array_join(F.transform("routes", lambda r: F.concat(r["route"], F.lit(":"), F.round(r["share"] * F.col("rows"), 0).cast("bigint").cast("string"))), ",")
    return out.select("user_id", "rows", names.alias("routes"), *[F.round(c, 6).alias(c) for c in ("skip_rate", "mean_alpha", "mean_entropy", "mean_residual")])


PAIR_CTE = """pairs0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS a,
   list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.3 * ((i + vec_id) % 3)) + 0.02) AS b FROM embeddings)"""


def state_pairs(spark, sf):
    """Each vector with a shifted and unevenly stretched copy of itself as its aligned counterpart."""
    e = table(spark, sf, "embeddings").withColumn("local", vx.doubles(F.col("embedding")))
    stretched = F.transform("local", lambda x, i: x * (1 + 0.3 * ((i + 1 + F.col("vec_id")) % 3)) + 0.02)
    return e.select("vec_id", "label", "local", stretched.alias("aligned"))


@query("residual_metrics", f"""WITH {PAIR_CTE} SELECT vec_id, round(list_distance(a, b) / sqrt(list_dot_product(a, a)), 6) AS residual,
   round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-8), 6) AS similarity FROM pairs0""")
def _residuals(spark, sf):
    p = state_pairs(spark, sf)
    return p.select("vec_id", F.round(tp.residual(F.col("local"), F.col("aligned")), 6).alias("residual"),
                    F.round(tp.similarity(F.col("local"), F.col("aligned")), 6).alias("similarity"))


@query("blend_states", f"""WITH {PAIR_CTE}, w AS (SELECT *, 0.5 / (1 + exp(list_distance(a, b) / (sqrt(list_dot_product(a, a)) + 1e-8) - 1)) AS alpha FROM pairs0)
   SELECT vec_id, round(alpha, 6) AS alpha, round(list_sum(list_transform(a, lambda x, i: (1 - alpha) * x + alpha * b[i])), 6) AS total,
     round((1 - alpha) * a[1] + alpha * b[1], 6) AS first FROM w""")
def _blend(spark, sf):
    b = tp.blend_states(state_pairs(spark, sf))
    return b.select("vec_id", F.round("effective_alpha", 6).alias("alpha"),
                    F.round(F.aggregate("blended", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("blended")[0], 6).alias("first"))


@query("momentum_vector", f"""WITH {PAIR_CTE}, g AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, list_transform(b, lambda x, i: x - a[i]) AS gap FROM pairs0),
   m AS (SELECT n.label, n.vec_id, n.pos, sum(pow(0.85, n.pos - o.pos) * o.gap[1]) / sum(pow(0.85, n.pos - o.pos)) AS m1,
       sum(pow(0.85, n.pos - o.pos) * list_sum(o.gap)) / sum(pow(0.85, n.pos - o.pos)) AS ms
     FROM g n JOIN g o ON n.label = o.label AND o.pos BETWEEN n.pos - 15 AND n.pos GROUP BY ALL)
   SELECT vec_id, CASE WHEN pos > 1 THEN round(m1, 6) END AS first, CASE WHEN pos > 1 THEN round(ms, 6) END AS total FROM m""")
def _momentum(spark, sf):
    m = tp.momentum(state_pairs(spark, sf), "label", ["vec_id"])
    return m.select("vec_id", F.round(F.col("momentum")[0], 6).alias("first"),
                    F.round(F.aggregate("momentum", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("momentum_correction", f"""WITH {PAIR_CTE}, g AS (SELECT vec_id, label, a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, list_transform(b, lambda x, i: x - a[i]) AS gap FROM pairs0),
   parts AS (SELECT n.label, n.pos, i, sum(pow(0.85, n.pos - o.pos) * o.gap[i]) / sum(pow(0.85, n.pos - o.pos)) AS m
     FROM g n JOIN g o ON n.label = o.label AND o.pos BETWEEN n.pos - 15 AND n.pos, range(1, 65) t(i) WHERE n.pos > 1 GROUP BY ALL),
   moms AS (SELECT label, pos, list(m ORDER BY i) AS m FROM parts GROUP BY ALL),
   st AS (SELECT label, pos, m, coalesce(greatest(0, list_cosine_similarity(m, lag(m) OVER (PARTITION BY label ORDER BY pos))), 0) AS stability FROM moms)
   SELECT g.vec_id, round(coalesce(stability, 0), 6) AS stability,
     round(list_sum(a) + CASE WHEN stability >= 0.5 THEN 0.3 * (stability - 0.5) / 0.5 * list_sum(m) ELSE 0 END, 6) AS total FROM g LEFT JOIN st USING (label, pos)""")
def _correction(spark, sf):
    m = tp.momentum(state_pairs(spark, sf), "label", ["vec_id"])
    return m.select("vec_id", F.round("stability", 6).alias("stability"),
                    F.round(F.aggregate("corrected", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- chains -------------------------------------------------------------------------------

def chain_rows(spark, sf):
    """Fingerprint blocks made from events: each block is linked by a digest of its predecessor's core."""
    from echotrail.operators.ordered import chunk_window, ordered_chunks, own_rows

    e = table(spark, sf, "events").select(
        F.col("user_id").alias("chain"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), "ts",
        "event_type", F.sha2(F.concat(F.lit("s"), F.col("event_id").cast("string")), 256).alias("content_fingerprint"))
    placed = ordered_chunks(e, ["chain"], ["ts", "event_id"], 1).withColumn("seq", F.col("pos") - 1).withColumnRenamed("pos", "position")
    # A block's stored link is the previous row's fingerprint; its digest covers that link.
    link = F.lag("content_fingerprint").over(chunk_window(["chain"], "position"))
    return own_rows(placed.withColumn("_link", link)).withColumn("prev_hash", F.coalesce("_link", F.lit(ch.ZERO_HASH))).drop("_link", "ts")


@query("chain_verify", """WITH base AS (SELECT user_id, event_id, row_number() OVER w - 1 AS seq, epoch_us(ts)::VARCHAR AS stamp, event_type,
     sha256('s' || event_id) AS fp, coalesce(lag(sha256('s' || event_id)) OVER w, repeat('0', 64)) AS prev
     FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   damaged AS (SELECT user_id, seq AS pos, CASE WHEN user_id % 5 = 1 AND seq = 7 THEN seq + 1 ELSE seq END AS seq, stamp,
       CASE WHEN user_id % 5 = 2 AND seq = 11 THEN 'forged' ELSE event_type END AS event_type, fp,
       CASE WHEN user_id % 5 = 3 AND seq = 5 THEN repeat('f', 64) ELSE prev END AS prev,
       sha256(seq || ':' || stamp || ':' || event_type || ':' || fp || ':' || prev) AS core FROM base),
   checked AS (SELECT user_id AS chain, pos, CASE WHEN seq <> pos THEN 'sequence'
       WHEN prev <> coalesce(lag(fp) OVER (PARTITION BY user_id ORDER BY pos), repeat('0', 64)) THEN 'link'
       WHEN core <> sha256(seq || ':' || stamp || ':' || event_type || ':' || fp || ':' || prev) THEN 'digest' END AS fault FROM damaged)
   SELECT chain, count(*) AS records, count(fault) = 0 AS ok, min(pos) FILTER (fault IS NOT NULL) AS at,
     min_by(fault, pos) FILTER (fault IS NOT NULL) AS fault FROM checked GROUP BY chain""")
def _chain(spark, sf):
    rows = chain_rows(spark, sf).withColumn("core", ch.block_hash())
    chain, seq = F.col("chain"), F.col("seq")
    damaged = rows.select(
        "chain", "position", F.when((chain % 5 == 1) & (seq == 7), seq + 1).otherwise(seq).alias("seq"), "timestamp",
        F.when((chain % 5 == 2) & (seq == 11), "forged").otherwise(F.col("event_type")).alias("event_type"), "content_fingerprint",
        F.when((chain % 5 == 3) & (seq == 5), "f" * 64).otherwise(F.col("prev_hash")).alias("prev_hash"), "core")
    # The link column of these rows is the fingerprint, so it stands where a stored digest would.
    linked = ch._with_previous(damaged, "chain", "content_fingerprint", None).withColumn("expected_seq", F.col("pos") - 1)
    fault = (F.when(F.col("seq") != F.col("expected_seq"), "sequence")
             .when(F.col("prev_hash") != F.coalesce("_before", F.lit(ch.ZERO_HASH)), "link")
             .when(F.col("core") != ch.block_hash(), "digest"))
    return ch._verdict(linked.withColumn("fault", fault), "chain")


# --- reports ------------------------------------------------------------------------------


@query("latency_summary", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
   round(quantile_cont(value, 0.99), 6) AS p99_ms, max(value) AS max_ms FROM events GROUP BY event_type""")
def _latency(spark, sf):
    out = ag.latency_summary(table(spark, sf, "events").select("event_type", "value"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "max_ms")


@query("latency_summary_nearest", """SELECT event_type, count(*) AS n,
   list_sort(list(value))[round_even(0.5 * (count(*) - 1), 0)::INT + 1] AS p50, list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95
   FROM events GROUP BY event_type""")
def _nearest(spark, sf):
    return ag.latency_summary_nearest(table(spark, sf, "events").select("event_type", "value"), "event_type", "value")


@query("daily_request_cap", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS allowed FROM events""")
def _cap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ag.daily_request_cap(e, "user_id", "ts", ["ts", "event_id"], 3).select("event_id", "user_id", "allowed")


QUEUE_SQL = "(SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'error' THEN 'pending' WHEN 'click' THEN 'approved' ELSE 'rejected' END AS status FROM events)"


def repair_rows(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", "pending").when(kind == "click", "approved").otherwise("rejected")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"))


@query("repair_queue_report", f"SELECT id, status FROM {QUEUE_SQL} WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 20")
def _repairs(spark, sf):
    return ag.repair_queue_report(repair_rows(spark, sf), "pending", 20).select("id", "status")


@query("repair_status_counts", f"SELECT status, count(*) AS n FROM {QUEUE_SQL} GROUP BY status")
def _repair_counts(spark, sf):
    return ag.repair_status_counts(repair_rows(spark, sf))


def recovery_sql(seconds: int) -> str:
    return f"""WITH c AS (SELECT e.user_id, CASE c.event_id % 4 WHEN 0 THEN 'ls' WHEN 1 THEN 'make test' WHEN 2 THEN 'git status' ELSE 'fix ' || c.user_id % 3 END AS command
     FROM events e JOIN events c ON e.user_id = c.user_id AND e.event_type = 'error' AND c.event_type = 'click' AND c.ts >= e.ts AND c.ts <= e.ts + INTERVAL {seconds} SECOND),
   n AS (SELECT user_id, command, count(*) AS n, command IN ('ls','clear','pwd','cd','shadow doctor','shadow search','git status') AS trivial FROM c GROUP BY ALL),
   k AS (SELECT * FROM n WHERE NOT trivial OR user_id NOT IN (SELECT user_id FROM n WHERE NOT trivial))
   SELECT user_id, command, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, command) AS rank FROM k"""


def recovery(spark, sf, seconds):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    slot = F.col("event_id") % 4
    command = F.when(slot == 0, "ls").when(slot == 1, "make test").when(slot == 2, "git status").otherwise(
        F.concat(F.lit("fix "), (F.col("user_id") % 3).cast("string")))
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", command.alias("command"))
    return ag.recovery_commands(e.filter("event_type = 'error'"), clicks, "user_id", seconds)


@query("recovery_commands", recovery_sql(300))
def _recovery(spark, sf):
    return recovery(spark, sf, 300)


@query("recovery_commands_two_days", recovery_sql(172800))
def _recovery_wide(spark, sf):
    return recovery(spark, sf, 172800)


@query("extractive_summary", events_sql("""SELECT source, sum(n)::BIGINT AS event_count, sum(n) || ' event(s): ' || string_agg(type || '=' || n, ', ' ORDER BY type)
     || '. Most recent: ' || max_by(lead, newest_at) AS summary FROM (SELECT source, type, count(*) AS n, max_by(id || ' [' || type || ']: ' || text, (timestamp, id)) AS lead,
     max((timestamp, id)) AS newest_at FROM ev GROUP BY ALL) GROUP BY source"""))
def _extract(spark, sf):
    return ag.extractive_summary(vault_events(spark, sf), "source")


# --- joins --------------------------------------------------------------------------------


@query("hydrate_hits", f"""{knn_sql()[:knn_sql().rindex('SELECT query_id')]} SELECT query_id, rank, doc_id, d.lang, d.n_chars FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 10""")
def _hydrate(spark, sf):
    hits = knn(all_vectors(spark, sf), corpus(spark, sf), 10).select("query_id", "rank", "doc_id")
    return ag.hydrate(hits, table(spark, sf, "documents").select("doc_id", "lang", "n_chars"))


# --- retrieval metrics --------------------------------------------------------------------

EVAL_CTE = f"""{pairs_sql(COSINE, False)},
   exact AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 10),
   short0 AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.v[1:16], c.v[1:16]), 9) AS score FROM vecs q, vecs c),
   short AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM short0) WHERE rank <= 10)"""


def both_lists(spark, sf):
    exact = knn(all_vectors(spark, sf), corpus(spark, sf), 10, tolerance=None)
    short = knn(truncated(all_vectors(spark, sf), 16), truncated(corpus(spark, sf), 16), 10, tolerance=None)
    return q.as_lists(exact, 10, "expected").join(q.as_lists(short, 10, "actual"), "query_id")


@query("recall_at_k", f"WITH {EVAL_CTE} SELECT e.query_id, round(count(s.doc_id) / 10.0::DOUBLE, 6) AS recall FROM exact e LEFT JOIN short s USING (query_id, doc_id) GROUP BY 1")
def _recall(spark, sf):
    return both_lists(spark, sf).select("query_id", F.round(q.recall_at_k(F.col("expected"), F.col("actual"), 10), 6).alias("recall"))


@query("mrr_at_k", f"WITH {EVAL_CTE} SELECT e.query_id, round(coalesce(1.0::DOUBLE / min(s.rank), 0), 6) AS mrr FROM exact e LEFT JOIN short s USING (query_id, doc_id) GROUP BY 1")
def _mrr(spark, sf):
    return both_lists(spark, sf).select("query_id", F.round(q.mrr_at_k(F.col("expected"), F.col("actual"), 10), 6).alias("mrr"))


@query("ndcg_at_k", f"""WITH {EVAL_CTE}, ideal AS (SELECT sum(1 / log2(r + 1)) AS best FROM range(1, 11) t(r))
   SELECT e.query_id, round(coalesce(sum(1 / log2(s.rank + 1)), 0) / any_value(best), 6) AS ndcg FROM ideal, exact e LEFT JOIN short s USING (query_id, doc_id) GROUP BY 1""")
def _ndcg(spark, sf):
    return both_lists(spark, sf).select("query_id", F.round(q.ndcg_at_k(F.col("expected"), F.col("actual"), 10), 6).alias("ndcg"))


@query("neighbour_overlap", f"""WITH {EVAL_CTE}, c AS (SELECT e.query_id, count(s.doc_id) AS n FROM exact e LEFT JOIN short s USING (query_id, doc_id) GROUP BY 1)
   SELECT round(avg(n / (20.0::DOUBLE - n)), 6) AS mean_jaccard, count(*) AS queries FROM c""")
def _overlap(spark, sf):
    j = both_lists(spark, sf).select(q.neighbour_overlap(F.col("expected"), F.col("actual")).alias("j"))
    return j.agg(F.round(F.avg("j"), 6).alias("mean_jaccard"), F.count("*").alias("queries"))


@query("binary_auc", """WITH j AS (SELECT lang, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
   r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rk FROM j),
   s AS (SELECT lang, count(*) AS rows, sum(label)::BIGINT AS positives, sum(rk * label) AS rs FROM r GROUP BY lang)
   SELECT lang, rows, positives, round(CASE WHEN positives = 0 OR positives = rows THEN 0.5 ELSE (rs - positives * (positives + 1) / 2) / (positives * (rows - positives)) END, 6) AS auc FROM s""")
def _auc(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = q.binary_auc(j.select("lang", F.col("n_chars").cast("double").alias("score"), "quality"), "lang", "score", "quality")
    return out.withColumn("auc", F.round("auc", 6))


# Relevance cases: a query's third and seventh exact neighbours; no answer for label 9.
CASES_CTE = """cases AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'heldout' ELSE 'development' END AS split, label FROM embeddings)"""


@query("hit_report", f"""WITH {EVAL_CTE}, {CASES_CTE},
   ranks AS (SELECT 'exact' AS method, * FROM exact UNION ALL SELECT 'prefix', * FROM short),
   answers AS (SELECT query_id, doc_id FROM exact JOIN cases USING (query_id) WHERE rank IN (3, 7) AND label <> 9),
   firsts AS (SELECT method, r.query_id, min(rank) FILTER (a.doc_id IS NOT NULL) AS first FROM ranks r LEFT JOIN answers a USING (query_id, doc_id) GROUP BY 1, 2)
   SELECT method, split, count(*) FILTER (label <> 9) AS answerable_queries, count(*) FILTER (label = 9) AS no_answer_queries,
     round(avg(CASE WHEN label <> 9 THEN coalesce((first <= 5)::INT, 0) END), 6) AS hit_at_5,
     round(avg(CASE WHEN label <> 9 THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr_at_10,
     count(*) FILTER (label = 9) AS no_answer_top5_nonempty, count(*) FILTER (label <> 9 AND (first IS NULL OR first > 5)) AS failures
   FROM firsts JOIN cases USING (query_id) GROUP BY ALL""")
def _hits(spark, sf):
    # Cases and report both read the exact list, which is searched once.
    exact = cut_lineage(knn(all_vectors(spark, sf), corpus(spark, sf), 10, tolerance=None).withColumn("method", F.lit("exact")))
    short = knn(truncated(all_vectors(spark, sf), 16), truncated(corpus(spark, sf), 16), 10, tolerance=None).withColumn("method", F.lit("prefix"))
    answers = exact.filter("rank IN (3, 7)").groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant"))  # two ids each
    split = F.when(F.col("vec_id") % 3 == 0, "heldout").otherwise("development")
    none = F.array().cast("array<bigint>")
    cases = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), split.alias("split"), "label").join(answers, "query_id", "left").select(
        "query_id", "split", F.when(F.col("label") == 9, none).otherwise(F.coalesce("relevant", none)).alias("relevant"))
    out = q.hit_report(cases, exact.unionByName(short))
    return out.withColumn("hit_at_5", F.round("hit_at_5", 6)).withColumn("mrr_at_10", F.round("mrr_at_10", 6))
