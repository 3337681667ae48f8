"""Checking hash-chained logs: sequence, links and recomputed digests, one row at a time with its predecessor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.operators.ordered import chunk_window, ordered_chunks, own_rows

ZERO_HASH = "0" * 64


def block_hash() -> Column:
    """Digest of a fingerprint-chain block; ``timestamp`` is text, so its literal survives."""
    return F.sha2(F.concat_ws(":", F.col("seq").cast("string"), "timestamp", "event_type", "content_fingerprint", "prev_hash"), 256)


def audit_event_hash() -> Column:
    """Digest of an audit record's core as key-sorted JSON without blanks."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    core = F.concat(
        F.lit('{"event_type":'), quoted("event_type"), F.lit(',"payload_hash":'), quoted("payload_hash"),
        F.lit(',"prev_root":'), quoted("prev_root"), F.lit(',"seq":'), F.col("seq").cast("string"),
        F.lit(',"timestamp":'), F.col("timestamp"), F.lit("}"))
    return F.sha2(core, 256)


def _with_previous(log: DataFrame, chain: str, column: str, chunk_rows: int | None) -> DataFrame:
    chunks = ordered_chunks(log, [chain], ["position"], 1, chunk_rows)
    return own_rows(chunks.withColumn("_before", F.lag(column).over(chunk_window([chain]))))


def _verdict(checked: DataFrame, chain: str) -> DataFrame:
    """First violation per chain. Minimum and count combine before the shuffle."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("expected_seq", "fault"))).alias("first")
    out = checked.groupBy(chain).agg(F.count("*").alias("records"), first)
    return out.select(chain, "records", F.col("first").isNull().alias("ok"), F.col("first.expected_seq").alias("at"),
                      F.col("first.fault").alias("fault"))


def verify_fingerprint_chain(log: DataFrame, chain: str = "chain", chunk_rows: int | None = None) -> DataFrame:
    """``log(chain, position, seq, timestamp, event_type, content_fingerprint, prev_hash, block_hash)``.

    A block links to the *recomputed* digest of the one before, which the previous row's own check
    proves equal to its stored digest; up to the first fault both readings agree.
    """
    rows = _with_previous(log, chain, "block_hash", chunk_rows).withColumn("expected_seq", F.col("pos") - 1)
    fault = (
        F.when(F.col("seq") != F.col("expected_seq"), "sequence")
        .when(F.col("prev_hash") != F.coalesce("_before", F.lit(ZERO_HASH)), "link")
        .when(F.col("block_hash") != block_hash(), "digest"))
    return _verdict(rows.withColumn("fault", fault), chain)


def verify_audit_log(log: DataFrame, chain: str = "chain", chunk_rows: int | None = None) -> DataFrame:
    """``log(chain, position, seq, timestamp, event_type, payload, payload_hash, prev_root, event_hash, root_hash)``
    with ``payload`` as key-sorted JSON text. Signatures are outside this check."""
    rows = _with_previous(log, chain, "root_hash", chunk_rows).withColumn("expected_seq", F.col("pos") - 1)
    event = audit_event_hash()
    root = F.sha2(F.concat_ws(":", "prev_root", event), 256)
    fault = (
        F.when(F.col("seq") != F.col("expected_seq"), "sequence")
        .when(F.col("prev_root") != F.coalesce("_before", F.lit(ZERO_HASH)), "link")
        .when(F.col("payload_hash") != F.sha2("payload", 256), "payload")
        .when((F.col("event_hash") != event) | (F.col("root_hash") != root), "root"))
    return _verdict(rows.withColumn("fault", fault), chain)
