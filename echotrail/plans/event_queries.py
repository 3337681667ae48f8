"""Event view: normalising, scoping, paging, grants, capture and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from echotrail.operators import events as ev
from echotrail.plans.inputs import event_log, events_sql, iso_sql, rows_sql, table, vault_events, vault_rows
from echotrail.plans.registry import query
from echotrail.sources.event_log import EventLog
from echotrail.sources.files import scratch_path

PAGE_COLUMNS = f"id, type, source, {iso_sql('timestamp')} AS timestamp, project"


def page_view(df):
    return df.select("id", "type", "source", ev.iso(F.col("timestamp")).alias("timestamp"), "project")


@query("normalize_events", events_sql(
    f"""SELECT id, type, source, {iso_sql('timestamp')} AS timestamp, {iso_sql('captured_at')} AS captured_at,
        timestamp_inferred, project, text FROM ev"""))
def _normalize(spark, sf):
    e = vault_events(spark, sf)
    return e.select(
        "id", "type", "source", ev.iso(F.col("timestamp")).alias("timestamp"),
        ev.iso(F.col("captured_at")).alias("captured_at"), "timestamp_inferred", "project", "text",
    )


@query("filter_scope", events_sql(
    f"""SELECT {PAGE_COLUMNS} FROM ev WHERE (project IN ('p1','p2','p3') OR project IS NULL)
        AND source IN ('click','error','view') AND timestamp >= TIMESTAMP '2024-01-05 00:00:00'
        AND timestamp < TIMESTAMP '2024-01-20 12:00:00'"""))
def _scope(spark, sf):
    return page_view(event_log(spark, sf).scan(
        projects=["p1", "p2", "p3", None], sources=["click", "error", "view"],
        since="2024-01-05T00:00:00Z", until="2024-01-20T12:00:00Z"))


@query("filter_metadata", rows_sql(
    """SELECT doc_id, metadata FROM vault WHERE json_type((metadata::JSON)->'k') IN ('UBIGINT','BIGINT','DOUBLE')
       AND ((metadata::JSON)->>'k')::DOUBLE = 42 AND ((metadata::JSON)->>'source') = 'view'
       AND ((metadata::JSON)->>'project') IS NULL"""))
def _metadata(spark, sf):
    rows = vault_rows(spark, sf)
    return ev.filter_metadata(rows, {"k": 42, "source": "view", "project": None}).select("doc_id", "metadata")


@query("restrict_candidates", events_sql(
    """SELECT id, type FROM ev WHERE id IN (SELECT 'ev_' || doc_id FROM labels WHERE quality = 1)"""))
def _restrict(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 1").select(
        F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("id"))
    return ev.restrict_candidates(vault_events(spark, sf), ids).select("id", "type")


@query("lookup_ids", events_sql(
    """SELECT w.pos, id, type, source FROM ev JOIN
       (SELECT 'ev_' || doc_id AS wid, min(p) AS pos FROM (
          SELECT doc_id, doc_id AS p FROM labels UNION ALL SELECT doc_id, doc_id + 1000000 FROM labels) GROUP BY 1) w
       ON id = wid WHERE source IN ('click','view','signup')"""))
def _lookup(spark, sf):
    labels = table(spark, sf, "labels")
    ids = labels.select(F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("pos"))
    ids = ids.unionByName(ids.withColumn("pos", F.col("pos") + 1_000_000))
    return ev.lookup_ids(vault_events(spark, sf), ids, sources=["click", "view", "signup"]).select(
        "pos", "id", "type", "source")


@query("capture_filter",
       """SELECT doc_id, source FROM documents WHERE length(text) > 3 AND length(text) < 1000000
          AND source NOT IN ('src3','src7') AND NOT contains(lower(text), 'password') AND NOT contains(lower(text), 'license')""")
def _capture(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(ev.should_capture(F.col("text"), F.col("source"), ["src3", "src7"], ["Password", "LICENSE"])).select(
        "doc_id", "source")


@query("retention_select", events_sql(
    """SELECT id, project FROM ev WHERE timestamp < (SELECT max(ts) FROM events) - INTERVAL 10 DAY
       AND source IN ('click','purchase')"""))
def _retention(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    events = vault_events(spark, sf)
    return ev.retention_select(events, 10, F.lit(now).cast("timestamp"), sources=["click", "purchase"]).select("id", "project")


@query("select_pending", rows_sql(
    """SELECT doc_id, created_at::VARCHAR AS created FROM vault
       WHERE NOT ((metadata::JSON->>'k')::INT < 50) ORDER BY created_at, doc_id LIMIT 50"""))
def _pending(spark, sf):
    rows = vault_rows(spark, sf)
    k = ev.meta("metadata", "k").cast("int")
    flagged = rows.withColumn("metadata", F.when(
        k < 50, F.concat(F.lit('{"dreamed":true,'), F.substring("metadata", 2, 1 << 20))).otherwise(F.col("metadata")))
    return ev.select_pending(flagged, 50).select("doc_id", F.col("created_at").cast("string").alias("created"))


@query("select_day", rows_sql("SELECT row_id, doc_id FROM vault WHERE created_at::DATE = DATE '2024-01-09'"))
def _day(spark, sf):
    return ev.select_day(vault_rows(spark, sf), "2024-01-09").select("row_id", "doc_id")


@query("relative_period_scope", events_sql(
    """SELECT 'today' AS period, count(*) AS n FROM ev WHERE timestamp >= TIMESTAMP '2024-01-28 00:00:00'
       UNION ALL SELECT '7d', count(*) FROM ev WHERE timestamp >= TIMESTAMP '2024-01-21 15:00:00'
       UNION ALL SELECT '30d', count(*) FROM ev WHERE timestamp >= TIMESTAMP '2023-12-29 15:00:00'"""))
def _period(spark, sf):
    as_of = datetime(2024, 1, 28, 15)
    events = vault_events(spark, sf)
    counts = events.agg(*[
        F.count_if(ev.scope_condition(since=ev.period_since(p, as_of))).alias(p) for p in ("today", "7d", "30d")])
    return counts.unpivot([], ["today", "7d", "30d"], "period", "n")


GRANTS_SQL = """
grants AS (SELECT event_type AS grant_id,
    list_sort(list_distinct(list('p' || user_id))) AS projects_all,
    list_sort(list_distinct(list('p' || user_id) FILTER (user_id % 3 <> 0))) AS projects_now,
    min(ts) + INTERVAL 2 DAY AS ceiling_since, min(ts) + INTERVAL 5 DAY AS current_since, max(ts) - INTERVAL 1 DAY AS until_at,
    CASE WHEN event_type = 'error' THEN min(ts) ELSE NULL END AS asked_until
  FROM events GROUP BY event_type),
resolved AS (SELECT grant_id,
    CASE WHEN greatest(ceiling_since, current_since) >= least(until_at, coalesce(asked_until, until_at)) THEN []::VARCHAR[]
         ELSE projects_now END AS projects,
    CASE WHEN grant_id = 'view' THEN ['view'] ELSE [grant_id, 'click'] END AS sources,
    greatest(ceiling_since, current_since) AS since, least(until_at, coalesce(asked_until, until_at)) AS until_at, 7 AS lim
  FROM grants)"""


def grants(spark, sf):
    """One sharing grant per event type, derived from the events table."""
    e = table(spark, sf, "events")
    project = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    g = e.groupBy(F.col("event_type").alias("grant_id")).agg(
        F.collect_set(project).alias("everyone"),
        F.collect_set(F.when(F.col("user_id") % 3 != 0, project)).alias("some"),
        F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi"))
    own = F.array("grant_id", F.lit("click"), F.lit("view"))
    asked_sources = F.when(F.col("grant_id") == "view", F.array(F.lit("view"))).otherwise(F.array("grant_id", F.lit("click")))
    day = F.expr("INTERVAL 1 DAY")
    none = F.lit(None).cast("timestamp")
    return g.select(
        "grant_id",
        F.struct(F.col("everyone").alias("projects"), own.alias("sources"), (F.col("lo") + 2 * day).alias("since"),
                 (F.col("hi") - day).alias("until"), F.lit(20).alias("limit")).alias("ceiling"),
        F.struct(F.col("some").alias("projects"), own.alias("sources"), (F.col("lo") + 5 * day).alias("since"),
                 none.alias("until"), F.lit(7).alias("limit")).alias("current"),
        F.struct(F.lit(None).cast("array<string>").alias("projects"), F.array_distinct(asked_sources).alias("sources"),
                 none.alias("since"), F.when(F.col("grant_id") == "error", F.col("lo")).alias("until")).alias("requested"),
    )


@query("resolve_grant_scope", f"""WITH {GRANTS_SQL.strip()}
    SELECT grant_id, array_to_string(list_sort(projects), ',') AS projects,
      array_to_string(list_sort(list_distinct(sources)), ',') AS sources,
      {iso_sql('since')} AS since, {iso_sql('until_at')} AS until, lim AS "limit" FROM resolved""")
def _resolve(spark, sf):
    return ev.resolve_grant_scope(grants(spark, sf)).select(
        "grant_id", F.array_join(F.sort_array("projects"), ",").alias("projects"),
        F.array_join(F.sort_array("sources"), ",").alias("sources"),
        ev.iso(F.col("since")).alias("since"), ev.iso(F.col("until")).alias("until"), "limit")


@query("grant_visible_events", events_sql(f""", {GRANTS_SQL.strip()},
    hits AS (SELECT grant_id, lim, id, timestamp FROM ev JOIN resolved r ON list_contains(r.sources, ev.source)
       AND list_contains(r.projects, ev.project) AND timestamp >= r.since AND timestamp < r.until_at),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY grant_id ORDER BY timestamp DESC, id DESC) AS rank,
       count(*) OVER (PARTITION BY grant_id) AS eligible FROM hits)
    SELECT grant_id, rank, id, {iso_sql('timestamp')} AS timestamp, eligible FROM ranked WHERE rank <= lim"""))
def _visible(spark, sf):
    scopes = ev.resolve_grant_scope(grants(spark, sf))
    bounds = scopes.agg(F.min("since"), F.max("until"), F.count_if(F.col("since").isNull()), F.count_if(F.col("until").isNull())).first()
    events = event_log(spark, sf).scan(since=None if bounds[2] else bounds[0], until=None if bounds[3] else bounds[1])
    return ev.grant_visible_events(events, scopes).withColumn("timestamp", ev.iso(F.col("timestamp")))


@query("error_like_filter", """SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text),
    'error|exception|traceback|failed|exit code|err!|fatal|undefined|crash')
    OR len(regexp_split_to_array(regexp_replace(text, '(\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}])$', ''),
       '\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]')) > 5""")
def _errors(spark, sf):
    from echotrail.functions.text import looks_like_error

    return table(spark, sf, "documents").filter(looks_like_error(F.col("text"))).select("doc_id", "source")


@query("open_target_column", """SELECT page_id,
    CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/tmp/' || page_id WHEN 2 THEN url ELSE NULL END AS target FROM pages""")
def _target(spark, sf):
    p = table(spark, sf, "pages")
    way = F.col("page_id") % 4
    metadata = F.when(way == 0, F.to_json(F.struct("url"))).when(
        way == 1, F.to_json(F.struct(F.lit("").alias("url"), F.concat(F.lit("/tmp/"), F.col("page_id")).alias("file")))
    ).otherwise("{}")
    text = F.when(way == 2, F.concat(F.lit("\n "), F.col("url"), F.lit("\nmore"))).otherwise(F.col("html"))
    return p.select("page_id", ev.open_target(metadata, text).alias("target"))


@query("timeline_page", events_sql(
    f"""SELECT {PAGE_COLUMNS} FROM ev WHERE source IN ('click','view','error')
        AND (timestamp, id) < (TIMESTAMP '2024-01-20 00:00:00', 'ev_5') ORDER BY ev.timestamp DESC, id DESC LIMIT 101"""))
def _page(spark, sf):
    return page_view(event_log(spark, sf).page(100, ("2024-01-20T00:00:00Z", "ev_5"), sources=["click", "view", "error"]))


@query("scan_page", rows_sql("SELECT row_id, doc_id FROM vault WHERE row_id > 250 ORDER BY row_id LIMIT 500"))
def _scan(spark, sf):
    return ev.scan_page(vault_rows(spark, sf), 250, 500).select("row_id", "doc_id")


@query("recent", rows_sql("SELECT row_id, doc_id, document FROM vault ORDER BY created_at DESC, row_id DESC LIMIT 20"))
def _recent(spark, sf):
    return ev.recent(vault_rows(spark, sf), 20).select("row_id", "doc_id", "document")


SUMMARY_SQL = """SELECT sum(n)::BIGINT AS count, string_agg(type || '=' || n, ', ' ORDER BY type) AS types,
    {hi} AS newest, {lo} AS oldest FROM (SELECT type, count(*) AS n, max(timestamp) AS hi, min(timestamp) AS lo FROM {src} GROUP BY type)"""


def summary_view(df):
    types = F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit("="), t["n"].cast("string"))), ", ")
    return df.select("count", types.alias("types"), ev.iso(F.col("newest")).alias("newest"), ev.iso(F.col("oldest")).alias("oldest"))


@query("event_summary", events_sql(SUMMARY_SQL.format(hi=iso_sql("max(hi)"), lo=iso_sql("min(lo)"), src="ev")))
def _summary(spark, sf):
    return summary_view(event_log(spark, sf).summary())


@query("current_context", events_sql(SUMMARY_SQL.format(
    hi=iso_sql("max(hi)"), lo=iso_sql("min(lo)"), src="(SELECT * FROM ev ORDER BY timestamp DESC, id DESC LIMIT 20)")))
def _context(spark, sf):
    return summary_view(event_log(spark, sf).newest_summary(20))


LEFT = "(SELECT * FROM ev WHERE NOT coalesce(source = 'click' AND project = 'p3', false) AND id NOT LIKE '%7')"


@query("event_log_updates", events_sql(f"""SELECT 'page' AS part, id AS key, {iso_sql('timestamp')} AS value, 1 AS n FROM (
      SELECT * FROM {LEFT} WHERE source IN ('click','signup') ORDER BY timestamp DESC, id DESC LIMIT 51)
    UNION ALL SELECT 'count', type, {iso_sql('max(timestamp)')}, count(*) FROM {LEFT} GROUP BY type
    UNION ALL SELECT 'cell', source || ':' || coalesce(project, '-'), NULL, count(*) FROM {LEFT} GROUP BY source, project"""))
def _log_updates(spark, sf):
    """A log that grew by three ingests that overlap in time and lost rows twice: a page, its types and its counts."""
    events = vault_events(spark, sf)
    log = EventLog(spark, scratch_path(spark, "log"))
    for part in range(3):
        log.append(events.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part), rows_per_file=4096)
    log.forget(events.filter("source = 'click' AND project = 'p3'").select("id"))
    log.forget(events.filter("id LIKE '%7'").select("id"))
    page = log.page(50, sources=["click", "signup"]).select(F.lit("page").alias("part"), F.col("id").alias("key"), ev.iso(F.col("timestamp")).alias("value"), F.lit(1).cast("long").alias("n"))
    types = log.summary().select(F.explode("types").alias("t")).select("t.type", "t.n")
    highs = log.scan().groupBy("type").agg(F.max("timestamp").alias("high"))
    counts = types.join(highs, "type").select(F.lit("count"), "type", ev.iso(F.col("high")), "n")
    cells = log.counts(["source", "project"]).select(
        F.lit("cell"), F.concat_ws(":", "source", F.coalesce("project", F.lit("-"))), F.lit(None).cast("string"), "n")
    return page.union(counts).union(cells)


@query("id_set_union", events_sql(
    """SELECT id, min(part) AS part FROM (SELECT id, 0 AS part FROM ev WHERE source = 'error'
       UNION ALL SELECT id, 1 FROM ev WHERE type = 'clipboard' OR source = 'click') GROUP BY id"""))
def _union(spark, sf):
    e = vault_events(spark, sf).withColumn("pos", F.col("row_id"))
    both = ev.id_set_union(e.filter("source = 'error'"), e.filter("type = 'clipboard' OR source = 'click'"))
    return both.select("id", F.col("place.part").alias("part"))
