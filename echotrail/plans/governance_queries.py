"""Text governance over the documents, with fixed strings planted by doc_id so that every rule fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import text as tx
from echotrail.operators import governance as gov
from echotrail.operators.events import iso, select_pending
from echotrail.plans.inputs import events_sql, iso_sql, table, vault_events
from echotrail.plans.registry import query
from echotrail.session import spread

# One string per secret pattern and personal-data label, then an opaque string and an empty text.
PLANTED = [
    "api_key: " + "a1b2" * 4 + " SSN 123-45-6789",
    "AKIA" + "ABCD" * 4 + " on 2024-03-05 or March 3rd, 2021",
    "aws_secret_access_key = " + "zz9" * 5,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- Dr. Ada Lovelace wrote",
    "postgres://user:secretpw@db/x from 10.0.0.1",
    "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 8,
    "ssh-rsa " + "A" * 48,
    "Password = hunter22",
    "ghp_" + "a" * 36,
    "glpat-" + "b" * 20,
    "xoxb-" + "1" * 12,
    "sk_live_" + "d" * 24,
    "sk-" + "e" * 24,
    "AIza" + "f" * 35,
    "token=" + "0f" * 20 + " card 4111-1111-1111-1111",
    'token = "' + "0f" * 20 + '" call +1 415-555-0100',
    "Mr. John Smith, 1/2/2024, fe80:0:0:1:2:3:4:5, a.b@example.org",
    "nothing special",
]
OPAQUE = "Ab9_" * 12


def planted(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    slot = F.pmod("doc_id", F.lit(20)).cast("int")
    extra = F.element_at(F.array(*[F.lit(p) for p in PLANTED]), F.least(slot, F.lit(17)) + 1)
    text = F.when(slot == 18, OPAQUE).when(slot == 19, "").otherwise(F.concat("text", F.lit("\n"), extra))
    return d.select("doc_id", "source", "lang", text.alias("text"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PLANTED_CTE = f"""planted AS (SELECT doc_id, source, lang,
  CASE doc_id % 20 WHEN 18 THEN {lit(OPAQUE)} WHEN 19 THEN ''
  ELSE text || chr(10) || ([{', '.join(lit(p) for p in PLANTED)}])[least(doc_id % 20, 17)::INT + 1] END AS text
  FROM documents)"""

RE2_SECRETS = tx.secret_patterns(tx.RE2)
HITS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN length(text) >= 3 AND regexp_matches(text, {lit(p)}) THEN '{n}' END" for n, p in RE2_SECRETS.items()
) + "], lambda x: x IS NOT NULL)"
CLASSED_CTE = PLANTED_CTE + f""",
classed AS (SELECT *, CASE WHEN len(hits) > 0 THEN 'sensitive'
   WHEN length(text) > 32 AND regexp_full_match(text, '[A-Za-z0-9+/=_\\-]+\\n?') THEN 'unknown' ELSE 'safe' END AS class
   FROM (SELECT *, {HITS_SQL} AS hits FROM planted))"""


def redact_sql(col: str) -> str:
    tokens = f"regexp_replace({col}, {lit(tx.redact_token_pattern(tx.RE2))}, '[REDACTED]', 'g')"
    return f"regexp_replace({tokens}, {lit(tx.redact_assignment_pattern(tx.RE2))}, '\\1[REDACTED]', 'g')"


@query("sensitivity_report", f"""WITH {CLASSED_CTE}
   SELECT source, class, pattern, count(*) AS n FROM
   (SELECT source, class, unnest(list_concat(['*'], hits)) AS pattern FROM classed) GROUP BY ALL""")
def _report(spark, sf):
    return gov.sensitivity_report(planted(spark, sf))


@query("redact_secrets", f"""WITH {PLANTED_CTE}
   SELECT doc_id, r <> text AS changed, length(r) AS n_chars, sha256(r) AS digest
   FROM (SELECT *, {redact_sql('text')} AS r FROM planted)""")
def _redact(spark, sf):
    return gov.redact_secrets(planted(spark, sf)).select(
        "doc_id", "changed", F.length("redacted").cast("bigint").alias("n_chars"), F.sha2("redacted", 256).alias("digest"))


def scrub_sql() -> str:
    stages, previous = [], "s0 AS (SELECT doc_id, text AS t0 FROM planted)"
    stages.append(previous)
    patterns = dict(tx.pii_patterns(tx.RE2), TICKET=r"TCK-[0-9]+|nothing special")
    for i, (label, p) in enumerate(patterns.items()):
        stages.append(
            f"s{i + 1} AS (SELECT *, len(regexp_extract_all(t{i}, {lit(p)})) AS n_{label.lower()}, "
            f"regexp_replace(t{i}, {lit(p)}, '[REDACTED_{label}]', 'g') AS t{i + 1} FROM s{i})")
    n = len(patterns)
    counts = ", ".join(f"n_{label.lower()}" for label in patterns)
    return f"WITH {PLANTED_CTE}, {', '.join(stages)} SELECT doc_id, {counts}, sha256(t{n}) AS digest FROM s{n}"


@query("scrub_pii", scrub_sql())
def _scrub(spark, sf):
    out = gov.scrub_pii(planted(spark, sf), {"ticket": r"TCK-[0-9]+|nothing special"})
    counts = [F.col(c).cast("bigint").alias(c) for c in out.columns if c.startswith("n_")]
    return out.select("doc_id", *counts, F.sha2("scrubbed", 256).alias("digest"))


SHARE_CTE = PLANTED_CTE + """,
shared AS (SELECT CASE doc_id % 20 WHEN 8 THEN 'ghp_' || repeat('a', 36) ELSE 'doc ' || doc_id || '/é*~' END AS id,
  source, lang AS project, text, 'https://x.org/?token=' || doc_id AS url, 'T' || doc_id AS title FROM planted)"""


@query("share_view", f"""WITH {SHARE_CTE}
   SELECT id, source, project, sha256(t) AS digest, 'memory://event/' || url_encode(id) AS citation,
     m_url AS url, title, true AS redacted
   FROM (SELECT *, {redact_sql('left(text, 4096)')} AS t, {redact_sql('url')} AS m_url FROM shared)
   WHERE {redact_sql('id')} = id""")
def _share(spark, sf):
    d = planted(spark, sf)
    number = F.col("doc_id").cast("string")
    events = d.select(
        F.when(F.col("doc_id") % 20 == 8, "ghp_" + "a" * 36).otherwise(F.concat(F.lit("doc "), number, F.lit("/é*~"))).alias("id"),
        F.lit("note").alias("type"), "source", F.col("lang").alias("project"), "text",
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("timestamp").alias("captured_at"),
        F.to_json(F.struct(F.concat(F.lit("https://x.org/?token="), number).alias("url"),
                           F.concat(F.lit("T"), number).alias("title"), F.lit("s").alias("secret_note"))).alias("metadata"))
    out = gov.share_view(events)
    return out.select("id", "source", "project", F.sha2("text", 256).alias("digest"), "citation",
                      F.get_json_object("metadata", "$.url").alias("url"),
                      F.get_json_object("metadata", "$.title").alias("title"), "redacted")


@query("plaintext_leak_scan", f"""WITH {CLASSED_CTE},
   stored AS (SELECT lang AS collection, 'd' || doc_id AS doc_id, class = 'sensitive' AND source <> 'src1' AS leaked FROM classed),
   ids AS (SELECT collection, string_agg(doc_id, ',' ORDER BY doc_id) AS hit_ids FROM
     (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY doc_id) AS rn FROM stored WHERE leaked) WHERE rn <= 10 GROUP BY 1)
   SELECT collection, count(*) AS checked, count(*) FILTER (leaked) AS sensitive_hits, any_value(hit_ids) AS hit_ids
   FROM stored LEFT JOIN ids USING (collection) GROUP BY collection""")
def _leaks(spark, sf):
    d = planted(spark, sf)
    rows = d.select(
        F.col("lang").alias("collection"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(F.col("source") == "src1", F.concat(F.lit("enc:"), F.hex("text"))).otherwise(F.col("text")).alias("document"))
    return gov.plaintext_leak_scan(rows).withColumn("hit_ids", F.array_join("hit_ids", ","))


QUEUE_CTE = CLASSED_CTE + f""",
sorted_out AS (SELECT doc_id, CASE WHEN length(trim(text)) < 3 THEN 'trivial' ELSE class END AS class, text FROM classed),
bodies AS (SELECT *, CASE class WHEN 'unknown' THEN {redact_sql('text')} WHEN 'safe' THEN text END AS body FROM sorted_out),
queue AS (SELECT doc_id, class, CASE WHEN length(body) > 500 THEN left(body, 500) || '...' ELSE body END AS outgoing FROM bodies)"""


def queue(spark, sf):
    return gov.enrichment_queue(planted(spark, sf).withColumnRenamed("text", "document"))


@query("enrichment_queue", f"""WITH {QUEUE_CTE} SELECT doc_id, class, outgoing,
   CASE class WHEN 'sensitive' THEN 'sensitive' END AS tags, CASE class WHEN 'sensitive' THEN 'credential' END AS category FROM queue""")
def _queue(spark, sf):
    return queue(spark, sf).select("doc_id", "class", "outgoing", F.array_join("tags", ",").alias("tags"), "category")


@query("apply_enrichment", f"""WITH {QUEUE_CTE} SELECT q.doc_id, class,
   CASE WHEN class IN ('safe','unknown') THEN CASE WHEN quality = 1 THEN 'a,q1' ELSE '' END WHEN class = 'sensitive' THEN 'sensitive' END AS tags,
   CASE WHEN class IN ('safe','unknown') THEN CASE WHEN quality = 1 THEN 'prose' ELSE 'other' END WHEN class = 'sensitive' THEN 'credential' END AS category,
   CASE WHEN class IN ('safe','unknown') THEN CASE WHEN quality = 1 THEN 'doc ' || q.doc_id ELSE '' END
        WHEN class = 'sensitive' THEN '(sensitive content — not sent to LLM)' END AS summary
   FROM queue q LEFT JOIN labels l ON q.doc_id = l.doc_id""")
def _apply(spark, sf):
    labels = table(spark, sf, "labels")
    answer = F.concat(F.lit('```json\n{"tags":["a","q1"],"category":"prose","summary":"doc '), F.col("doc_id").cast("string"), F.lit('"}\n```'))
    responses = labels.select("doc_id", F.when(F.col("quality") == 1, answer).otherwise("not json").alias("response"))
    out = gov.apply_enrichment(queue(spark, sf), responses)
    return out.select("doc_id", "class", F.array_join("tags", ",").alias("tags"), "category", "summary")


@query("content_dedupe", """SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type,
   lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
   WHERE previous IS NULL OR previous <> event_type""")
def _dedupe(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("text"))
    return gov.content_dedupe(e, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query("content_fingerprint", "SELECT doc_id, sha256('salt-1'::BLOB || text::BLOB) AS fingerprint FROM "
       "(SELECT doc_id, encode(text) AS text FROM documents)")
def _fingerprint(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", gov.content_fingerprint(F.col("text"), b"salt-1").alias("fingerprint"))
