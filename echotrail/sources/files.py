"""Readers for document files, vector matrices, hash-chained logs and shell history."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.functions import text as tx
from echotrail.operators.ordered import ordered_positions


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    from echotrail.session import prepare

    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document, metadata)`` from JSON files (an array or one object) or from text lines.

    Array items that are objects give their ``document`` and ``metadata`` keys; other items become
    text. All other files, whatever their suffix, give one document per non-blank line. One JSON file is one array, so it is
    parsed by one task; a collection is read in parallel over its files.
    """
    whole = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    body = F.trim("value")
    items = F.when(body.startswith("["), F.from_json(body, "array<variant>")).otherwise(F.array(F.try_parse_json(body)))
    item = F.col("item")
    kind = F.schema_of_variant(item)
    is_object = kind.startswith("OBJECT")
    flag = F.when(F.try_variant_get(item, "$", "boolean"), "True").otherwise("False")
    scalar = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", flag).otherwise(F.to_json(item))
    scalar = F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).otherwise(scalar)
    from_json = whole.select(F.explode(items).alias("item")).select(
        F.when(is_object, F.coalesce(F.try_variant_get(item, "$.document", "string"), F.lit(""))).otherwise(scalar).alias("document"),
        F.when(is_object, F.coalesce(F.to_json(F.try_variant_get(item, "$.metadata", "variant")), F.lit("{}"))).otherwise("{}").alias("metadata"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(~F.lower("_metadata.file_name").endswith(".json"))
    from_text = lines.select(tx.strip(F.col("value")).alias("document"), F.lit("{}").alias("metadata")).filter("document <> ''")
    return from_json.unionByName(from_text)


def read_vector_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(row, vector)`` from CSV: one vector per line, numbered in file order.

    Lines are numbered from each split's offset and the order inside it, without a single-task pass.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("value"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    placed = ordered_positions(lines, [], ["_file", "_start", "_line"], pos="row")
    return placed.select((F.col("row") - 1).alias("row"), F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double")).alias("vector"))


AUDIT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()), T.StructField("payload_hash", T.StringType()), T.StructField("prev_root", T.StringType()),
    T.StructField("event_hash", T.StringType()), T.StructField("root_hash", T.StringType())])
BLOCK_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("content_fingerprint", T.StringType()), T.StructField("prev_hash", T.StringType()), T.StructField("block_hash", T.StringType())])


def read_log(spark: SparkSession, path: str, schema: T.StructType = AUDIT_SCHEMA) -> DataFrame:
    """JSON-lines log with a fixed schema; one chain per file. Times stay text, so digests can be redone."""
    rows = spark.read.schema(schema).json(path)
    return rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("chain"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("position"), "*")


# History lines that are never captured.
TRIVIAL_COMMANDS = ["ls", "cd", "pwd", "clear", "exit", "logout", "q", "fg", "bg", "jobs", "history", "which", "whoami", "shadow"]
TRIVIAL_PREFIXES = ["cd ", "ls ", "echo ", "cat ", "shadow "]
REMEMBERED = 20


def parse_history(lines: DataFrame) -> DataFrame:
    """Split ``: <epoch>:<n>;<command>`` or bare lines; blank, short and trivial commands drop out."""
    line = tx.strip(F.col("value"))
    extended = r"^:[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*(\p{Nd}+):\p{Nd}+;(.*)$"
    is_extended = line.rlike(extended)
    command = F.when(is_extended, tx.strip(F.regexp_extract(line, extended, 2))).otherwise(line)
    epoch = F.when(is_extended, F.regexp_extract(line, extended, 1).try_cast("double"))
    rows = lines.withColumn("text", command).withColumn("epoch", epoch)
    trivial: Column = (F.length("text") < 3) | F.col("text").isin(TRIVIAL_COMMANDS)
    for prefix in TRIVIAL_PREFIXES:
        trivial = trivial | F.col("text").startswith(prefix)
    return rows.filter(~trivial).drop("value")


def _fresh(commands: list[str], state: str | None) -> tuple[list[bool], str]:
    """Which commands are not among the last 20 kept ones, and those kept in the end."""
    import json

    kept: list[str] = json.loads(state) if state else []
    mask = []
    for command in commands:
        fresh = command not in kept
        mask.append(fresh)
        if fresh:
            kept = (kept + [command])[-REMEMBERED:]
    return mask, json.dumps(kept)


def keep_new(rows, state: str | None):
    """Drop commands among the last 20 kept ones. ``rows`` is an ordered pandas frame of one key."""
    mask, after = _fresh(rows["text"].tolist(), state)
    return rows[mask], after


def keep_new_of_keys(rows, starts: list[int], before: list[str | None]):
    """``keep_new`` for many keys at once: the rows of key ``i`` begin at ``starts[i]``."""
    commands = rows["text"].tolist()
    done = [_fresh(commands[a:b], state) for a, b, state in zip(starts, [*starts[1:], len(commands)], before)]
    return rows[[fresh for mask, _ in done for fresh in mask]], [state for _, state in done]


def shell_history(lines: DataFrame, key: str, order: list[str], slice_rows: int | None = None) -> DataFrame:
    """Batch form of the history source: parsed commands per key without recent repeats."""
    from echotrail.operators.ordered import CHUNK_ROWS, fold_ordered

    parsed = parse_history(lines)
    return fold_ordered(parsed, [key], order, keep_new, parsed.schema, slice_rows or CHUNK_ROWS, keep_new_of_keys)
