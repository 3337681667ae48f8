"""Stored documents on Parquet: idempotent ingest, tombstones, metadata merges, snapshots, increments.

A vault folder holds ``documents`` (appended, partitioned by collection), ``tombstones`` (appended)
and ``collections``. Deletion appends ids; readers drop them by anti-join. So neither ingest nor
deletion rewrites stored rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.functions import vectors as vx
from echotrail.operators.events import MAX_METADATA_BYTES, MAX_TEXT_BYTES, instant
from echotrail.operators.term_index import TermIndex
from echotrail.session import small_side

KEY = ["collection", "doc_id"]
MAX_ID_BYTES = 1024


def default_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(text, 256), 1, 16))


def first_per_key(batch: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """First row of each key. Only (key, position) is aggregated, with partial minima per task, and the
    join back is on the unique position, so a key with many copies does not gather in one task."""
    firsts = batch.groupBy(*keys).agg(F.min(position).alias(position))
    return batch.join(firsts.select(*keys, position), [*keys, position], "left_semi")


def ingest_documents(batch: DataFrame, existing: DataFrame, tombstones: DataFrame) -> dict[str, DataFrame]:
    """Split a batch ``(pos, collection, doc_id?, document, embedding, ...)`` into what happens to it.

    ``accepted`` rows are new; ``known`` were stored before or repeat within the batch; ``forgotten``
    ids carry a tombstone (an error for the caller); ``invalid`` vectors hold NaN or infinities.
    """
    rows = batch.withColumn("doc_id", F.coalesce("doc_id", default_id(F.col("document"))))
    good = vx.is_finite_vector(F.col("embedding"))
    forgotten = rows.join(tombstones.select(*KEY), KEY, "left_semi")
    alive = rows.join(tombstones.select(*KEY), KEY, "left_anti")
    fresh = alive.filter(good).join(existing.select(*KEY), KEY, "left_anti")
    accepted = first_per_key(fresh, KEY)
    known = alive.filter(good).join(accepted.select("pos"), "pos", "left_anti")
    return {"accepted": accepted, "known": known, "forgotten": forgotten, "invalid": alive.filter(~good)}


def merge_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by key; the last incoming row of a key wins. ``incoming`` has ``pos``."""
    last = incoming.groupBy(*KEY).agg(F.max("pos").alias("pos"))
    newest = incoming.join(last, [*KEY, "pos"], "left_semi").drop("pos")
    return existing.join(last.select(*KEY), KEY, "left_anti").unionByName(newest)


def export_collection(rows: DataFrame, collection: str) -> DataFrame:
    return rows.filter(F.col("collection") == collection).select("doc_id", "document", "embedding", "metadata", "entropy")


def validate_snapshot(records: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row of violation counts over records and deleted ids; all zero means valid."""
    m = F.col("metadata")
    kinds = F.schema_of_variant
    parsed = F.try_parse_json(m)
    bad_type = F.lit(False)
    for name in ("source", "project", "event_type"):
        kind = kinds(F.try_variant_get(parsed, f"$.{name}", "variant"))
        bad_type = bad_type | ~F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    bad_time = F.lit(False)
    for name in ("timestamp", "captured_at"):
        value = F.get_json_object(m, f"$.{name}")
        bad_time = bad_time | (value.isNotNull() & instant(value).isNull())
    not_object = ~F.coalesce(kinds(parsed).startswith("OBJECT"), F.lit(False))

    def bad_id(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "") | (F.octet_length(c) > MAX_ID_BYTES)

    checks = records.agg(
        F.count("*").alias("records"), F.count_if(bad_id("id")).alias("bad_ids"),
        F.count_if(F.octet_length("text") > MAX_TEXT_BYTES).alias("long_texts"),
        F.count_if(F.octet_length("metadata") > MAX_METADATA_BYTES).alias("long_metadata"),
        F.count_if(not_object | bad_type | bad_time).alias("bad_metadata"))
    removed = deleted.agg(F.count("*").alias("deleted"), F.count_if(bad_id("id")).alias("bad_deleted_ids"))
    repeats = (
        records.select("id").unionByName(deleted.select("id")).groupBy("id").agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("duplicate_ids")))
    return checks.crossJoin(F.broadcast(removed)).crossJoin(F.broadcast(repeats))  # one row each


def snapshot_vault(rows: DataFrame, tombstones: DataFrame, path: str, key: bytes | None = None) -> None:
    """Write records and tombstones; texts are sealed with AES-GCM when the caller gives a key."""
    records = rows.select(F.col("doc_id").alias("id"), F.col("document").alias("text"), "metadata", "created_at", "last_accessed")
    if key is not None:
        records = records.withColumn("text", F.base64(F.aes_encrypt(F.col("text"), F.lit(key), F.lit("GCM"))))
    records.write.parquet(f"{path}/records")
    tombstones.select(F.col("doc_id").alias("id")).write.parquet(f"{path}/deleted")


def read_snapshot(spark: SparkSession, path: str, key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    records, deleted = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/deleted")
    if key is not None:
        opened = F.aes_decrypt(F.unbase64("text"), F.lit(key), F.lit("GCM")).cast("string")
        records = records.withColumn("text", opened)
    return records, deleted


def restore_vault(spark: SparkSession, path: str, collection: str, key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """Validated rows and tombstones of a snapshot, with both stored times kept."""
    records, deleted = read_snapshot(spark, path, key)
    counts = validate_snapshot(records, deleted).first().asDict()
    faults = {k: v for k, v in counts.items() if k not in ("records", "deleted") and v}
    if faults:
        raise ValueError(f"snapshot is invalid: {faults}")
    rows = records.select(F.lit(collection).alias("collection"), F.col("id").alias("doc_id"), F.col("text").alias("document"),
                          "metadata", "created_at", "last_accessed")
    return rows, deleted.select(F.lit(collection).alias("collection"), F.col("id").alias("doc_id"))


def export_increment(rows: DataFrame, cursor: int) -> tuple[DataFrame, int]:
    """Rows after a saved cursor and the next cursor."""
    fresh = rows.filter(F.col("row_id") > cursor)
    following = fresh.agg(F.max("row_id")).first()[0]
    packet = fresh.select("row_id", F.col("doc_id").alias("id"), "document", "metadata")
    return packet, cursor if following is None else following


def forget(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that remain, and the tombstones to append: one per removed (collection, doc_id).

    ``ids(collection, doc_id)`` removes inside the named collections only. A plain ``doc_id`` list is
    for rows that are one collection already.
    """
    keys = KEY if "collection" in ids.columns else ["doc_id"]
    chosen = small_side(ids.select(*keys).distinct(), 128)
    remaining = rows.join(chosen, keys, "left_anti")
    return remaining, rows.join(chosen, keys, "left_semi").select(*KEY).distinct()


def evict_lru(rows: DataFrame, max_entries: int) -> tuple[DataFrame, DataFrame]:
    """Keep at most ``max_entries`` rows; the least recently used go, and are remembered as deleted."""
    over = max(0, rows.count() - max_entries) if max_entries > 0 else 0
    return forget(rows, oldest(rows, over))


def oldest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` least recently accessed rows. ``n`` may be large, so the cut is found by position."""
    from echotrail.operators.ordered import ordered_positions

    if n == 0:
        return rows.select(*KEY).limit(0)
    narrow = rows.select(*KEY, "last_accessed", "row_id")
    return ordered_positions(narrow, [], ["last_accessed", "row_id"]).filter(F.col("pos") <= n).select(*KEY)


def touch(rows: DataFrame, access_log: DataFrame) -> DataFrame:
    """Latest access per row: hits are appended to a log ``(doc_id, accessed_at)`` and folded in at read."""
    latest = access_log.groupBy("doc_id").agg(F.max("accessed_at").alias("_at"))
    return rows.join(latest, "doc_id", "left").withColumn(
        "last_accessed", F.greatest("last_accessed", "_at")).drop("_at")


def merge_json(old: Column, new: Column) -> Column:
    """Object ``old`` with the keys of object ``new`` set; all other values keep their types."""
    kind = "map<string,variant>"
    empty = F.lit("{}")
    return vx.let(F.from_json(F.coalesce(F.nullif(old, F.lit("")), empty), kind), lambda a: vx.let(
        F.from_json(F.coalesce(new, empty), kind),
        lambda b: F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b))))


def update_metadata(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge ``updates(doc_id, patch)`` into the JSON metadata; ``updated`` marks the rows found."""
    joined = rows.join(updates.select("doc_id", "patch"), "doc_id", "left")
    merged = F.when(F.col("patch").isNotNull(), merge_json(F.col("metadata"), F.col("patch"))).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", merged).withColumn("updated", F.col("patch").isNotNull()).drop("patch")


def assign_project(rows: DataFrame, ids: DataFrame, project: str | None) -> DataFrame:
    """Set the project of the given ids; ``updated`` marks rows whose project differed."""
    import json

    patch = F.lit(json.dumps({"project": project}))
    chosen = small_side(ids.select("doc_id").distinct().withColumn("_chosen", F.lit(True)), 64)
    joined = rows.join(chosen, "doc_id", "left")
    differs = F.col("_chosen").isNotNull() & ~F.get_json_object("metadata", "$.project").eqNullSafe(F.lit(project).cast("string"))
    return joined.withColumn("updated", differs).withColumn(
        "metadata", F.when(F.col("updated"), merge_json(F.col("metadata"), patch)).otherwise(F.col("metadata"))).drop("_chosen")


def check_model_pin(batch: DataFrame, collections: DataFrame) -> DataFrame:
    """Mark rows whose model or dimension differs from the collection's pin; an unpinned one accepts."""
    pins = small_side(collections.select("collection", "embedding_model", "embedding_dim"), 256)
    joined = batch.join(pins, "collection", "left")
    unpinned = F.col("embedding_model").isNull()
    wrong_dim = F.size("embedding") != F.col("embedding_dim")
    wrong = ~unpinned & ((F.col("model") != F.col("embedding_model")) | wrong_dim)
    return joined.withColumn("violation", wrong).drop("embedding_model", "embedding_dim")


def rebuild_embeddings(rows: DataFrame, embed, entropy: bool = True) -> DataFrame:
    """Re-embed every document with another model; ids, metadata and times stay as they are."""
    out = rows.withColumn("embedding", embed(F.coalesce("document", F.lit(""))))
    return out.withColumn("entropy", vx.vector_entropy(F.col("embedding"))) if entropy else out


class Vault:
    """A vault folder. All methods are Spark jobs over its Parquet tables."""

    SCHEMA = T.StructType([
        T.StructField("doc_id", T.StringType()), T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()),
        T.StructField("entropy", T.DoubleType()), T.StructField("created_at", T.TimestampType()),
        T.StructField("last_accessed", T.TimestampType()), T.StructField("row_id", T.LongType()),
        T.StructField("collection", T.StringType())])
    COLLECTION = T.StructType([
        T.StructField("collection", T.StringType()), T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()), T.StructField("pinned_at", T.TimestampType())])
    TOMBSTONE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("collection", T.StringType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        folder = f"{self.path}/{name}"
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(folder)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", self.TOMBSTONE)

    def rows(self, collection: str | None = None) -> DataFrame:
        """Live rows; the collection filter prunes folders before the anti-join."""
        rows = self._read("documents", self.SCHEMA)
        if collection is not None:
            rows = rows.filter(F.col("collection") == collection)
        return rows.join(self.tombstones(), KEY, "left_anti")

    def collections(self) -> DataFrame:
        """The model and dimension that each collection is pinned to; the first pin of a collection holds."""
        pins = self._read("collections", self.COLLECTION)
        return pins.groupBy("collection").agg(
            F.min_by("embedding_model", "pinned_at").alias("embedding_model"), F.min_by("embedding_dim", "pinned_at").alias("embedding_dim"))

    def pin(self, collection: str, model: str, dim: int) -> None:
        """Pin a collection to a model. The same pin again changes nothing, another one is refused."""
        held = self.collections().filter(F.col("collection") == collection).first()
        if held is not None:
            if (held["embedding_model"], held["embedding_dim"]) != (model, dim):
                raise ValueError(f"{collection} holds vectors of {held['embedding_model']} with {held['embedding_dim']} values")
            return
        row = self.spark.createDataFrame([(collection, model, dim)], "collection string, embedding_model string, embedding_dim int")
        row.withColumn("pinned_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/collections")

    INDEXED = T.StructType([T.StructField("collection", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("folder", T.StringType())])

    def terms(self, collection: str, kind: str = "bm25") -> TermIndex:
        """The inverted index of a collection. The first call builds it; ingest and deletion then keep it."""
        held = self._read("indexed", self.INDEXED).filter((F.col("collection") == collection) & (F.col("kind") == kind)).first()
        if held is not None:
            return TermIndex.open(self.spark, held["folder"])
        folder = f"{self.path}/terms/{uuid.uuid4().hex}"
        index = TermIndex.create(self.spark, folder, kind)
        index.append(self.rows(collection).select("doc_id", F.col("document").alias("text")))
        self.spark.createDataFrame([(collection, kind, folder)], self.INDEXED).coalesce(1).write.mode("append").parquet(f"{self.path}/indexed")
        return index

    def complete_terms(self) -> None:
        """Index the stored rows that an interrupted ingest left out of their collection's indexes."""
        for r in self._read("indexed", self.INDEXED).collect():
            index = TermIndex.open(self.spark, r["folder"])
            known = index.shards().select(F.explode("ids").alias("doc_id"))
            missing = self.rows(r["collection"]).select("doc_id", F.col("document").alias("text")).join(known, "doc_id", "left_anti")
            if missing.limit(1).count():
                index.append(missing)

    def _each_index(self, rows: DataFrame, change: Callable[[TermIndex, DataFrame], int]) -> None:
        """``change`` every index of the collections in ``rows(collection, doc_id, document)``, which must be stored."""
        for r in self._read("indexed", self.INDEXED).collect():  # one row per index that a caller asked for
            mine = rows.filter(F.col("collection") == r["collection"]).select("doc_id", F.col("document").alias("text"))
            if mine.limit(1).count():
                change(TermIndex.open(self.spark, r["folder"]), mine)

    def ingest(self, batch: DataFrame, model: str | None = None) -> dict[str, int]:
        """Append the new rows of a batch and say what became of all others.

        Returns counts of ``accepted``, ``known``, ``forgotten`` and ``invalid`` rows. Running a batch
        again accepts nothing. Row ids grow over all batches: the accepted rows are numbered in batch
        order after the largest stored id. One writer at a time. With ``model`` the batch must match the
        pin of each collection it names, else nothing is written.
        """
        from echotrail.operators.ordered import ordered_positions
        from echotrail.session import cut_lineage

        if model is not None:
            wrong = check_model_pin(batch.withColumn("model", F.lit(model)), self.collections()).filter("violation").limit(1).count()
            if wrong:
                raise ValueError("the batch has vectors of another model or dimension than its collection")
        stored = self._read("documents", self.SCHEMA)
        counts, fresh = self._sort_out(batch, stored)
        if not counts["accepted"]:
            return counts
        last = stored.agg(F.max("row_id")).first()[0] or 0
        accepted = ordered_positions(fresh.drop("row_id"), [], ["pos", *KEY], "_nth")
        accepted = accepted.withColumn("row_id", F.col("_nth") + last).drop("pos", "_nth")
        defaults = {"entropy": F.lit(None).cast("double"), "metadata": F.lit("{}"), "created_at": F.current_timestamp(), "last_accessed": F.current_timestamp()}
        for name, value in defaults.items():
            if name not in accepted.columns:
                accepted = accepted.withColumn(name, value)
        typed = accepted.select(*[F.col(f.name).cast(f.dataType) for f in self.SCHEMA])
        typed.write.mode("append").partitionBy("collection").parquet(f"{self.path}/documents")
        self._each_index(fresh, TermIndex.append)
        return counts

    def _sort_out(self, batch: DataFrame, stored: DataFrame) -> tuple[dict[str, int], DataFrame]:
        """What ``ingest_documents`` says of a batch: how many rows of each kind, and the accepted ones.

        Ids of the batch choose the stored and the forgotten keys that matter, so what was stored before is read by its
        keys alone and not shuffled. Every row is made once.
        """
        from echotrail.session import cut_lineage

        rows = cut_lineage(batch.withColumns({
            "doc_id": F.coalesce("doc_id", default_id(F.col("document"))), "_good": vx.is_finite_vector(F.col("embedding"))}))
        asked = small_side(rows.select(*KEY).distinct(), 64)

        def held(keys: DataFrame, mark: str) -> DataFrame:
            return cut_lineage(keys.select(*KEY).join(asked, KEY, "left_semi").distinct().withColumn(mark, F.lit(True)))

        gone, known = held(self.tombstones(), "_gone"), held(stored, "_known")
        marked = rows.join(small_side(gone, 64), KEY, "left").join(small_side(known, 64), KEY, "left")
        marked = marked.withColumns({"_gone": F.coalesce("_gone", F.lit(False)), "_known": F.coalesce("_known", F.lit(False))})
        is_new = F.coalesce("_good", F.lit(False)) & ~F.col("_gone") & ~F.col("_known")
        accepted = cut_lineage(first_per_key(marked.filter(is_new), KEY).drop("_good", "_gone", "_known"))
        totals = marked.agg(
            F.count_if(F.col("_gone")).alias("forgotten"), F.count_if(~F.col("_gone") & ~F.col("_good")).alias("invalid"),
            F.count_if(~F.col("_gone") & F.col("_good")).alias("good")).first()
        n = accepted.count()
        return {"accepted": n, "known": totals["good"] - n, "forgotten": totals["forgotten"], "invalid": totals["invalid"]}, accepted

    def forget(self, ids: DataFrame, collection: str | None = None) -> int:
        """Remember ids as deleted, inside one collection or in those that ``ids(collection, doc_id)`` names."""
        from echotrail.session import cut_lineage

        if collection is not None:
            ids = ids.select(F.lit(collection).alias("collection"), "doc_id")
        elif "collection" not in ids.columns:
            raise ValueError("say in which collection the ids are to be forgotten")
        rows = self.rows(collection)
        _, gone = forget(rows, ids)
        gone = cut_lineage(gone.select(*[f.name for f in self.TOMBSTONE]))
        count = gone.count()
        if count:
            self._each_index(cut_lineage(rows.join(small_side(gone, 128), KEY, "left_semi").select(*KEY, "document")), TermIndex.forget)
            gone.write.mode("append").parquet(f"{self.path}/tombstones")
        return count

    def rebuild(self, collection: str, embed, target: str, model: str | None = None) -> "Vault":
        """Re-embed a collection into a new vault folder, pinned to ``model``; refuse if the source changed meanwhile.

        Readers move to the returned vault only after this succeeds, so a failed run changes nothing.
        """
        def version() -> tuple:
            rows = self.rows(collection).agg(F.count("*"), F.max("row_id"), F.max("created_at"), F.sum(F.xxhash64("doc_id", "metadata").cast("decimal(38,0)")))
            return tuple(rows.first())

        before = version()
        rebuilt = Vault(self.spark, target)
        out = rebuild_embeddings(self.rows(collection), embed)
        out.select(*[F.col(f.name).cast(f.dataType) for f in self.SCHEMA]).write.partitionBy("collection").parquet(f"{target}/documents")
        self.tombstones().filter(F.col("collection") == collection).write.parquet(f"{target}/tombstones")
        if model is not None:
            dims = [r[0] for r in rebuilt.rows(collection).select(F.size("embedding")).distinct().limit(2).collect()]
            if len(dims) > 1:
                raise ValueError("the new model gives vectors of different lengths")
            if dims:
                rebuilt.pin(collection, model, dims[0])
        if version() != before:
            raise RuntimeError("the source changed during the rebuild; keep using it and try again")
        return rebuilt
