"""Corpus-level text governance: sensitivity, redaction, sharing views, enrichment, de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.functions import text as tx
from echotrail.operators.ordered import chunk_window, ordered_chunks, own_rows

SHARE_CHARS = 4096  # the share view is bounded by definition
SHARED_KEYS = ["title", "url", "path", "application", "timestamp_inferred", "provenance"]
ENRICH_CHARS = 500


def secret_hits(text: Column) -> Column:
    """Names of the secret patterns found in a text; each pattern is searched once."""
    names = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in tx.secret_patterns().items()])
    return F.when(F.length(text) < 3, F.array().cast("array<string>")).otherwise(F.array_compact(names))


def sensitivity_report(docs: DataFrame, group: str = "source") -> DataFrame:
    """Rows per (group, class, pattern); pattern ``*`` counts every row of the class."""
    hits = docs.select(group, F.col("text"), secret_hits(F.col("text")).alias("hits"))
    opaque = (F.length("text") > 32) & F.col("text").rlike(r"^[A-Za-z0-9+/=_\-]+\n?$")
    label = F.when(F.size("hits") > 0, tx.SENSITIVE).when(opaque, tx.UNKNOWN).otherwise(tx.SAFE)
    each = hits.select(group, label.alias("class"), F.explode(F.concat(F.array(F.lit("*")), "hits")).alias("pattern"))
    return each.groupBy(group, "class", "pattern").agg(F.count("*").alias("n"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    clean = docs.withColumn("redacted", tx.redact(F.col("text")))
    return clean.withColumn("changed", F.col("redacted") != F.col("text"))


def scrub_pii(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Replace personal data label by label, counting the hits that each stage sees.

    ``extra`` adds or replaces labels with caller patterns, applied after the built-in order. Most texts have no hit of
    most labels; they are searched once by a stage and not rewritten.
    """
    patterns = dict(tx.pii_patterns())
    for label, pattern in (extra or {}).items():
        patterns[label.upper()] = pattern
    out = docs.withColumn("scrubbed", F.col("text"))
    for label, pattern in patterns.items():
        count = F.regexp_count("scrubbed", F.lit(pattern))
        if label in tx.PII_NEEDS and label.lower() not in {e.lower() for e in extra or {}}:
            some = reduce(Column.__or__, [F.col("scrubbed").contains(needed) for needed in tx.PII_NEEDS[label]])
            count = F.when(~some, 0).otherwise(count)
        name = f"n_{label.lower()}"
        out = out.withColumn(name, count)
        out = out.withColumn("scrubbed", F.when(F.col(name) > 0, F.regexp_replace("scrubbed", pattern, f"[REDACTED_{label}]")).otherwise(F.col("scrubbed")))
    return out


def percent_encode(value: Column) -> Column:
    form = F.url_encode(value)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _shared_field(value: Column, key: str) -> Column:
    """``"key":value`` as JSON with its type kept, and whether sharing changed it; null for an absent key.

    Strings are clipped and redacted. Objects and lists are redacted as JSON text and withheld if that
    breaks them. Numbers and booleans cannot hold a secret.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    clean = tx.redact(F.substring(text, 1, SHARE_CHARS))
    quoted = F.to_json(F.array(clean))
    nested = F.to_json(value)
    redacted = tx.redact(nested)
    plain = kind.isin("BOOLEAN", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    shown = F.when(kind == "STRING", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).when(plain, nested).when(
        F.try_parse_json(redacted).isNotNull(), redacted)
    changed = F.when(kind == "STRING", clean != text).when(plain, False).otherwise(redacted != nested)
    return F.when(kind.isNotNull() & (kind != "VOID"), F.struct(
        F.concat(F.lit(f'"{key}":'), shown).alias("shown"), changed.alias("changed")))


def share_view(events: DataFrame, citation_prefix: str = "memory://event/") -> DataFrame:
    """What a sharing bridge may show of an event: clipped, redacted, few keys, with a citation.

    Rows whose id itself redacts are withheld, since the citation would carry the id.
    """
    m = F.col("metadata")
    out = events.filter(tx.redact(F.col("id")) == F.col("id"))
    out = out.withColumn("clean_text", tx.redact(F.substring("text", 1, SHARE_CHARS)))
    out = out.withColumn("clean_source", tx.redact(F.substring("source", 1, SHARE_CHARS)))
    out = out.withColumn("clean_project", tx.redact(F.substring("project", 1, SHARE_CHARS)))
    out = out.withColumn("parsed", F.try_parse_json(m))
    fields = [_shared_field(F.try_variant_get("parsed", f"$.{k}", "variant"), k) for k in SHARED_KEYS]
    out = out.withColumn("fields", F.array_compact(F.array(*fields)))
    dropped = F.size(F.array_except(F.json_object_keys(m), F.array(*[F.lit(k) for k in SHARED_KEYS]))) > 0
    changed = (
        (F.col("clean_text") != F.col("text"))
        | (F.col("clean_source") != F.col("source"))
        | F.coalesce(F.col("clean_project") != F.col("project"), F.lit(False))
        | F.exists("fields", lambda f: f["changed"])
        | F.coalesce(dropped, F.lit(False))
    )
    return out.select(
        "id", "type", "timestamp", "captured_at",
        F.col("clean_source").alias("source"), F.col("clean_project").alias("project"),
        F.col("clean_text").alias("text"), 
        F.concat(F.lit("{"), F.array_join(F.array_compact(F.transform("fields", lambda f: f["shown"])), ","), F.lit("}")).alias("metadata"),
        F.concat(F.lit(citation_prefix), percent_encode(F.col("id"))).alias("citation"), changed.alias("redacted"),
    )


def plaintext_leak_scan(rows: DataFrame, sample: int = 10) -> DataFrame:
    """Per collection: rows checked, sensitive rows stored in the clear, and the first few ids."""
    text = F.col("document")
    leaked = ~text.startswith("enc:") & (tx.sensitivity(text) == tx.SENSITIVE)
    marked = rows.select("collection", "doc_id", F.coalesce(leaked, F.lit(False)).alias("leaked"))
    counts = marked.groupBy("collection").agg(F.count("*").alias("checked"), F.count_if("leaked").alias("sensitive_hits"))
    # The rank filter keeps `sample` rows per task and collection before the shuffle.
    first = Window.partitionBy("collection").orderBy("doc_id")
    ids = (
        marked.filter("leaked").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= sample)
        .groupBy("collection").agg(F.sort_array(F.collect_list("doc_id")).alias("hit_ids"))
    )
    return counts.join(ids, "collection", "left").withColumn(
        "hit_ids", F.coalesce("hit_ids", F.array().cast("array<string>")))


def enrichment_queue(pending: DataFrame) -> DataFrame:
    """Sort pending rows into trivial, sensitive, and rows whose (redacted, clipped) text may go out."""
    text = F.col("document")
    trivial = text.isNull() | (F.length(tx.strip(text)) < 3)
    out = pending.withColumn("class", F.when(trivial, "trivial").otherwise(tx.sensitivity(text)))
    body = F.when(F.col("class") == tx.UNKNOWN, tx.redact(text)).when(F.col("class") == tx.SAFE, text)
    out = out.withColumn("body", body)
    sensitive = F.col("class") == tx.SENSITIVE
    return out.select(
        "doc_id", "class",
        F.when(F.length("body") > ENRICH_CHARS, F.concat(F.substring("body", 1, ENRICH_CHARS), F.lit("..."))).otherwise(F.col("body")).alias("outgoing"),
        F.when(sensitive, F.array(F.lit("sensitive"))).alias("tags"),
        F.when(sensitive, "credential").alias("category"),
        F.when(sensitive, "(sensitive content — not sent to LLM)").alias("summary"),
    )


ENRICHMENT = "struct<tags:array<string>,category:string,summary:string>"


def apply_enrichment(queue: DataFrame, responses: DataFrame) -> DataFrame:
    """Metadata updates from model answers ``(doc_id, response)``; fences are stripped, gaps defaulted."""
    fenced = F.regexp_replace(F.trim("response"), r"^```[^\n]*\n|\n```\s*$", "")
    parsed = responses.select("doc_id", F.from_json(fenced, ENRICHMENT, {"mode": "PERMISSIVE"}).alias("a"))
    joined = queue.join(parsed, "doc_id", "left")
    asked = F.col("class").isin(tx.SAFE, tx.UNKNOWN)
    empty = F.array().cast("array<string>")
    return joined.select(
        "doc_id", F.lit(True).alias("dreamed"), "class",
        F.when(asked, F.coalesce("a.tags", empty)).otherwise(F.col("tags")).alias("tags"),
        F.when(asked, F.coalesce("a.category", F.lit("other"))).otherwise(F.col("category")).alias("category"),
        F.when(asked, F.coalesce("a.summary", F.lit(""))).otherwise(F.col("summary")).alias("summary"),
    )


def content_dedupe(rows: DataFrame, keys: list[str], order: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Drop a row whose trimmed text equals that of the row before it in its key."""
    hashed = rows.withColumn("_hash", tx.content_hash(F.col("text")))
    chunks = ordered_chunks(hashed, keys, order, 1, chunk_rows)
    previous = F.lag("_hash").over(chunk_window(keys))
    return own_rows(chunks.withColumn("_previous", previous)).filter(
        F.col("_previous").isNull() | (F.col("_previous") != F.col("_hash"))
    ).drop("_previous", "_hash")


def content_fingerprint(text: Column, salt: bytes) -> Column:
    """Salted SHA-256 that proves possession of a text without showing it."""
    return F.sha2(F.concat(F.unhex(F.lit(salt.hex())), F.encode(text, "utf-8")), 256)
