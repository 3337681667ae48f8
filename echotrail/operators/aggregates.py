"""Reports over events, latencies, queues and requests; the interval join behind repair suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.functions import text as tx
from echotrail.operators.ordered import ordered_positions, running_total
from echotrail.session import small_side

# Commands that are never offered as a fix while others exist.
IGNORED_COMMANDS = ["ls", "clear", "pwd", "cd", "shadow doctor", "shadow search", "git status"]


def summary_line(doc_id: Column, kind: Column, text: Column) -> Column:
    """One clipped, cleaned line per event."""
    label = tx.sensitivity(text)
    clean = F.when(label == tx.SENSITIVE, "[SENSITIVE CONTENT OMITTED]").when(label == tx.UNKNOWN, tx.redact(text)).otherwise(text)
    flat = tx.one_line(clean)
    clipped = F.when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 297), F.lit("..."))).otherwise(flat)
    return F.concat(doc_id, F.lit(" ["), kind, F.lit("]: "), clipped)


def extractive_summary(events: DataFrame, group: str) -> DataFrame:
    """Per group: count per type and the newest event's line. Only the newest text is cleaned."""
    newest = F.max_by(F.struct("id", "type", "text"), F.struct("timestamp", "id")).alias("lead")
    per_type = events.groupBy(group, "type").agg(F.count("*").alias("n"), newest, F.max(F.struct("timestamp", "id")).alias("at"))
    out = per_type.groupBy(group).agg(
        F.sum("n").alias("event_count"),
        F.sort_array(F.collect_list(F.struct("type", "n"))).alias("types"),  # one entry per event type
        F.max_by("lead", "at").alias("lead"))
    names = F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit("="), t["n"].cast("string"))), ", ")
    line = summary_line(F.col("lead.id"), F.col("lead.type"), F.col("lead.text"))
    return out.select(group, "event_count", F.concat(
        F.col("event_count").cast("string"), F.lit(" event(s): "), names, F.lit(". Most recent: "), line).alias("summary"))


def _values_at(df: DataFrame, group: str, value: str, indexes: dict, chunk_rows: int | None = None) -> DataFrame:
    """Per group the sorted values at given 0-based indexes, without sorting a group in one task.

    Rows collapse to counts per distinct value first; an index falls on the first value whose running
    count exceeds it. ``indexes`` maps names to expressions over the group's size ``n``.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("_c"))
    placed = running_total(ordered_positions(counts, [group], [value]), [group], "_c", "_upto", chunk_rows)
    sizes = counts.groupBy(group).agg(F.sum("_c").alias("n"), F.max(value).alias("max_ms")).withColumnRenamed(group, "_g")
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    picks = [F.min(F.when(F.col("_upto") > index, F.col(value))).alias(name) for name, index in indexes.items()]
    return joined.groupBy(group).agg(F.max("n").alias("n"), F.max("max_ms").alias("max_ms"), *picks)


def latency_summary(df: DataFrame, group: str, value: str, chunk_rows: int | None = None) -> DataFrame:
    """Linearly interpolated p50, p95, p99 and the maximum per group."""
    points = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    rank = {name: (F.col("n") - 1) * F.lit(p) for name, p in points.items()}
    indexes = {}
    for name, r in rank.items():
        indexes[f"_{name}_lo"] = F.floor(r)
        indexes[f"_{name}_hi"] = F.least(F.floor(r) + 1, F.col("n") - 1)
    found = _values_at(df, group, value, indexes, chunk_rows)
    out = []
    for name, r in rank.items():
        weight = r - F.floor(r)
        out.append((F.col(f"_{name}_lo") * (1.0 - weight) + F.col(f"_{name}_hi") * weight).alias(name))
    return found.select(group, "n", *out, "max_ms")


def latency_summary_nearest(df: DataFrame, group: str, value: str, percents=(50, 95), chunk_rows: int | None = None) -> DataFrame:
    """Nearest-rank percentiles, the rank rounded half to even."""
    indexes = {
        f"p{p}": F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(F.lit(p / 100.0) * (F.col("n") - 1)).cast("bigint")))
        for p in percents}
    return _values_at(df, group, value, indexes, chunk_rows).drop("max_ms")


def daily_request_cap(requests: DataFrame, key: str, ts: str, order: list[str], cap: int = 50) -> DataFrame:
    """Mark the first ``cap`` requests of each key and day as allowed.

    The rank filter keeps at most ``cap`` rows per task before the shuffle; rows beyond it are refused
    and get their mark from the anti side of the join.
    """
    day = F.to_date(ts)
    rows = requests.withColumn("day", day)
    first = Window.partitionBy(key, "day").orderBy(*order)
    allowed = rows.select(key, "day", *order).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= cap)
    marks = allowed.select(*[F.col(o).alias(f"_{o}") for o in order], F.col(key).alias("_key"), F.lit(True).alias("_ok"))
    condition = F.col(key).eqNullSafe(F.col("_key"))
    for o in order:
        condition = condition & (F.col(o) == F.col(f"_{o}"))
    return rows.join(marks, condition, "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop(
        "_ok", "_key", *[f"_{o}" for o in order])


def repair_queue_report(queue: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    rows = queue.filter(F.col("status") == status) if status else queue
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, int(limit)))


def repair_status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def recovery_commands(errors: DataFrame, commands: DataFrame, key: str, seconds: int = 300, top: int | None = None,
                      chunk_rows: int | None = None) -> DataFrame:
    """Per key the commands run within ``seconds`` after its errors, by how often that happened.

    A command at time u follows as many errors as lie in [u - seconds, u]. That is the running count of
    errors at u minus the one just before u - seconds, so each command contributes two lookup points on
    the key's time line and no (error, command) pair is ever formed. Trivial commands are offered only
    if nothing else remains; ties go to the smaller text. All commands are ranked; ``top`` keeps the first ones.
    """
    when = F.unix_micros(F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("string")
    width = seconds * 1_000_000
    line = errors.select(key, when.alias("_t"), F.lit(1).alias("_kind"), none.alias("command"), F.lit(1).alias("_error"))
    for shift, kind in ((width, 0), (0, 2)):  # before the errors of its instant, and after them
        line = line.unionByName(commands.select(
            key, (when - shift).alias("_t"), F.lit(kind).alias("_kind"), "command", F.lit(0).alias("_error")))
    line = line.groupBy(key, "_t", "_kind", "command").agg(F.count("*").alias("_n"), F.sum("_error").alias("_error"))
    placed = ordered_positions(line, [key], ["_t", "_kind", "command"])
    counted = running_total(placed, [key], "_error", "_errors", chunk_rows).filter("_kind <> 1")
    signed = F.when(F.col("_kind") == 2, F.col("_errors")).otherwise(-F.col("_errors")) * F.col("_n")
    counts = counted.groupBy(key, "command").agg(F.sum(signed).alias("n")).filter("n > 0")
    trivial = F.trim("command").isin(IGNORED_COMMANDS)
    useful = counts.filter(~trivial).groupBy(key).agg(F.lit(True).alias("_useful")).withColumnRenamed(key, "_k")
    kept = counts.join(useful, F.col(key).eqNullSafe(F.col("_k")), "left").filter(
        ~trivial | F.col("_useful").isNull()).drop("_useful", "_k")
    order = Window.partitionBy(key).orderBy(F.desc("n"), "command")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def hydrate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach document columns to search hits; hits whose document is gone drop out."""
    return docs.join(small_side(hits, 128), "doc_id")
