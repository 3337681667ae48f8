"""How the supplied tables play the reference's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.operators.events import normalize_events
from echotrail.session import spread
from echotrail.sources.event_log import EventLog
from echotrail.sources.files import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored event rows made from ``events``: JSON metadata with and without each optional key."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    kind = F.col("event_type")
    stamp = F.col("ts")
    shifted = F.date_format(stamp + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    zulu = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    declared = (
        F.when(kind == "click", ',"event_type":"Terminal"')
        .when(kind == "signup", ',"event_type":"note"')
        .when(kind == "view", ',"event_type":"url"')
        .otherwise("")
    )
    project = F.when(F.col("user_id") % 7 == 0, "").otherwise(
        F.concat(F.lit(',"project":"p'), F.col("user_id").cast("string"), F.lit('"'))
    )
    occurred = F.when(F.col("user_id") % 5 == 0, "").otherwise(
        F.concat(F.lit(',"timestamp":"'), F.when(F.col("event_id") % 2 == 0, shifted).otherwise(zulu), F.lit('"'))
    )
    return e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.when(kind == "purchase", "cmd_").otherwise("ev_"), F.col("event_id").cast("string")).alias("doc_id"),
        F.lit("main").alias("collection"),
        F.concat(kind, F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string")).alias("document"),
        F.concat(
            F.lit('{"source":"'), kind, F.lit('"'), declared, project, occurred,
            F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"),
        ).alias("metadata"),
        stamp.cast("timestamp").alias("created_at"),
        (stamp + F.expr("INTERVAL 1 HOUR") * F.pmod(F.col("event_id") * 37, F.lit(1000)).cast("int")).cast("timestamp").alias("last_accessed"),
    )


# Indexes and logs that this application has made from its input tables, by name and state of the tables.
_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, tables: list[str], name: str, build):
    """``build()``, once per application and state of ``tables``: what a service ingests once and then searches."""
    key = [spark.sparkContext.applicationId, name]
    for t in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = place.getFileSystem(spark._jsc.sc().hadoopConfiguration())
        key += [f"{sf_dir}/{t}", files.getContentSummary(place).getLength(), files.getFileStatus(place).getModificationTime()]
    if tuple(key) not in _KEPT:
        _KEPT[tuple(key)] = build()
    return _KEPT[tuple(key)]


def event_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """The events as a stored log, ingested by the first query that asks for it."""

    def build() -> EventLog:
        log = EventLog(spark, scratch_path(spark, "log"))
        log.append(vault_events(spark, sf_dir), rows_per_file=8192)
        return log

    return kept(spark, sf_dir, ["events"], "event log", build)


def vault_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(vault_rows(spark, sf_dir))


ROWS_CTE = """
vault AS (
  SELECT event_id AS row_id,
    CASE WHEN event_type = 'purchase' THEN 'cmd_' ELSE 'ev_' END || event_id::VARCHAR AS doc_id,
    'main' AS collection,
    event_type || ' ' || value::DECIMAL(18,2)::VARCHAR AS document,
    '{"source":"' || event_type || '"'
      || CASE event_type WHEN 'click' THEN ',"event_type":"Terminal"' WHEN 'signup' THEN ',"event_type":"note"'
           WHEN 'view' THEN ',"event_type":"url"' ELSE '' END
      || CASE WHEN user_id % 7 = 0 THEN '' ELSE ',"project":"p' || user_id::VARCHAR || '"' END
      || CASE WHEN user_id % 5 = 0 THEN '' ELSE ',"timestamp":"' ||
           CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f+02:00')
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END || '"' END
      || ',"k":' || (props::JSON->>'k') || '}' AS metadata,
    ts AS created_at,
    ts + INTERVAL 1 HOUR * ((event_id * 37) % 1000) AS last_accessed
  FROM events)"""

EVENTS_CTE = ROWS_CTE + """,
ev AS (
  SELECT row_id, doc_id AS id, collection, last_accessed,
    CASE WHEN declared IN ('clipboard','terminal','ambient','file','url','app','repair','sync','model_call','note')
         THEN declared WHEN starts_with(doc_id, 'cmd_') THEN 'terminal' ELSE 'clipboard' END AS type,
    coalesce(nullif(m->>'source', ''), 'unknown') AS source,
    coalesce(make_timestamp(epoch_us(CAST(m->>'timestamp' AS TIMESTAMPTZ))), created_at) AS timestamp,
    coalesce(make_timestamp(epoch_us(CAST(m->>'captured_at' AS TIMESTAMPTZ))), created_at) AS captured_at,
    (m->>'timestamp') IS NULL AS timestamp_inferred,
    m->>'project' AS project, document AS text, metadata
  FROM (SELECT *, metadata::JSON AS m,
          lower(coalesce(nullif(metadata::JSON->>'event_type',''), nullif(metadata::JSON->>'source',''), '')) AS declared
        FROM vault))"""


def events_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE.strip()} {body}"


def rows_sql(body: str) -> str:
    return f"WITH {ROWS_CTE.strip()} {body}"


def iso_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"
