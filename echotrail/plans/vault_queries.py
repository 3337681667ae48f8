"""Stored documents: readers, ingest, merge, snapshots, increments, deletion, metadata, model pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.operators.ordered import ordered_positions
from echotrail.plans.inputs import rows_sql, table, vault_rows
from echotrail.plans.registry import query
from echotrail.plans.search_queries import DIM, ENTROPY_SQL, hash_sql
from echotrail.session import cut_lineage
from echotrail.sources import files, npy, vault as vt


@query("read_documents", """SELECT CASE WHEN label < 4 THEN 'item ' || vec_id WHEN label < 6 THEN vec_id::VARCHAR WHEN label < 7 THEN '' ELSE 'line ' || vec_id END AS document,
   CASE WHEN label < 4 THEN label END AS tag, count(*) AS n FROM embeddings GROUP BY ALL""")
def _read_documents(spark, sf):
    """Writes JSON arrays and text lines derived from a table, then reads them back."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    number = F.col("vec_id").cast("string")
    item = F.when(F.col("label") < 4, F.to_json(F.struct(
        F.concat(F.lit("item "), number).alias("document"), F.struct(F.col("label").alias("tag")).alias("metadata")))).when(
        F.col("label") < 6, number).otherwise("{}")
    path = files.scratch_path(spark, "documents")
    parts = e.filter("label < 7").groupBy(F.floor(F.col("vec_id") / 100).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    # An array holds at most 100 items, whatever the size of the table.
    for_text = e.filter("label >= 7").select(F.concat(F.lit("  line "), number, F.lit(" \n\n")).alias("value"))
    for_text.write.text(f"{path}/lines")
    parts.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    _rename(spark, f"{path}/arrays", ".json")
    out = files.read_documents(spark, path)
    tag = F.get_json_object("metadata", "$.tag").cast("int").alias("tag")
    return out.groupBy("document", tag).agg(F.count("*").alias("n"))


def _rename(spark, folder: str, suffix: str) -> None:
    """The text writer names files .txt; give these the suffix their content has."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(place, name.replace(".txt", suffix)))


@query("read_vector_matrix", "SELECT vec_id AS row, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _matrix(spark, sf):
    path = files.scratch_path(spark, "matrix")
    e = table(spark, sf, "embeddings")
    lines = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",")
    e.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(lines.alias("value")).write.text(path)
    m = files.read_vector_matrix(spark, path)
    return m.select("row", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("read_npy_matrix", "SELECT vec_id AS row, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _npy(spark, sf):
    """Every task writes its vectors as a matrix file; all files are read back by byte ranges."""
    path = npy.local_path(files.scratch_path(spark, "npy"))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")

    def save(batches):
        import os

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from echotrail.operators.kernels import to_matrix

        parts = [to_matrix(b.column(1)) for b in batches if b.num_rows]
        if parts:
            os.makedirs(path, exist_ok=True)
            np.save(f"{path}/part-{TaskContext.get().partitionId():05d}.npy", np.concatenate(parts).astype("<f4"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(p) for p in parts)], pa.int64())})

    e.mapInArrow(save, "n long").agg(F.sum("n")).first()
    m = npy.read_npy(spark, path, split_bytes=32 * 1024)
    return m.select("row", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def batch(spark, sf):
    """Documents as an ingest batch: ids repeat for equal texts, one label's vectors are broken."""
    d = table(spark, sf, "documents")
    broken = F.when(F.col("doc_id") % 50 == 7, F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(1.0), F.col("n_chars").cast("double")))
    return d.select(
        F.col("doc_id").alias("pos"), F.lit("main").alias("collection"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), F.col("n_chars").cast("string"))).alias("doc_id"),
        F.col("text").alias("document"), broken.alias("embedding"), "lang")


@query("ingest_documents", """WITH b AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'doc_' || left(sha256(text), 16) ELSE 'n' || n_chars END AS id, doc_id % 50 <> 7 AS good, lang FROM documents),
   existing AS (SELECT 'n' || n_chars AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
   dead AS (SELECT 'n' || n_chars AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
   alive AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM dead)),
   ok AS (SELECT id, min(pos) AS pos FROM alive WHERE good AND id NOT IN (SELECT id FROM existing) GROUP BY id)
   SELECT pos, id AS doc_id, CASE WHEN id IN (SELECT id FROM dead) THEN 'forgotten' WHEN NOT good THEN 'invalid' WHEN pos IN (SELECT pos FROM ok) THEN 'accepted' ELSE 'known' END AS outcome FROM b""")
def _ingest(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.lit("main").alias("collection"), F.concat(F.lit("n"), F.col("n_chars").cast("string")).alias("doc_id"), "quality", "toxic")
    parts = vt.ingest_documents(batch(spark, sf), d.filter("quality = 0"), d.filter("toxic = 1"))
    out = None
    for name, part in parts.items():
        piece = part.select("pos", "doc_id", F.lit(name).alias("outcome"))
        out = piece if out is None else out.unionByName(piece)
    return out


@query("merge_records", """WITH e AS (SELECT doc_id AS id, 'old' AS origin, 'd' || (doc_id % 400) AS doc_id, n_chars FROM documents WHERE lang = 'en'),
   e1 AS (SELECT doc_id, origin, max(n_chars) AS n_chars FROM e GROUP BY ALL),
   i AS (SELECT 'd' || (doc_id % 400) AS doc_id, 'new' AS origin, max_by(n_chars, doc_id) AS n_chars FROM documents WHERE lang <> 'en' GROUP BY 1)
   SELECT doc_id, origin, n_chars FROM i UNION ALL SELECT doc_id, origin, n_chars FROM e1 WHERE doc_id NOT IN (SELECT doc_id FROM i)""")
def _merge(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.lit("main").alias("collection"), F.concat(F.lit("d"), (F.col("doc_id") % 400).cast("string")).alias("doc_id"), "n_chars", "lang")
    old = d.filter("lang = 'en'").groupBy("collection", "doc_id").agg(F.max("n_chars").alias("n_chars")).withColumn("origin", F.lit("old"))
    new = d.filter("lang <> 'en'").drop("lang").withColumn("origin", F.lit("new"))
    return vt.merge_records(old, new).select("doc_id", "origin", "n_chars")


@query("export_collection", f"WITH {ENTROPY_SQL} SELECT vec_id::VARCHAR AS doc_id, round(entropy, 6) AS entropy FROM entropies JOIN embeddings USING (vec_id) WHERE label = 3")
def _export(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("collection"), F.col("vec_id").cast("string").alias("doc_id"), F.lit("").alias("document"), "embedding",
        F.lit("{}").alias("metadata"), vx.vector_entropy(F.col("embedding")).alias("entropy"))
    return vt.export_collection(e, "3").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("snapshot_vault", rows_sql("SELECT doc_id, document, created_at::VARCHAR AS created, last_accessed::VARCHAR AS accessed FROM vault WHERE NOT starts_with(doc_id, 'cmd_') OR row_id % 2 = 0"))
def _snapshot(spark, sf):
    """Writes an encrypted snapshot, restores it and shows the restored rows."""
    rows = vault_rows(spark, sf)
    gone = rows.filter("startswith(doc_id, 'cmd_') AND row_id % 2 = 1")
    path = files.scratch_path(spark, "snapshot")
    vt.snapshot_vault(rows.join(gone.select("doc_id"), "doc_id", "left_anti"), gone, path, key=b"0123456789abcdef")
    restored, _ = vt.restore_vault(spark, path, "main", key=b"0123456789abcdef")
    return restored.select("doc_id", "document", F.col("created_at").cast("string").alias("created"), F.col("last_accessed").cast("string").alias("accessed"))


@query("validate_snapshot", """WITH r AS (SELECT 'd' || (doc_id % 900) AS id, octet_length(encode(text)) AS n, doc_id FROM documents),
   d AS (SELECT 'd' || doc_id AS id FROM labels WHERE toxic = 1), u AS (SELECT id FROM r UNION ALL SELECT id FROM d)
   SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM d) AS deleted, (SELECT count(*) FROM r WHERE n > 1048576) AS long_texts,
     (SELECT count(*) FROM r WHERE doc_id % 10 IN (3, 4, 5)) AS bad_metadata,
     (SELECT count(*) FROM (SELECT id FROM u GROUP BY id HAVING count(*) > 1)) AS duplicate_ids""")
def _validate(spark, sf):
    slot = F.col("doc_id") % 10
    metadata = F.when(slot == 3, '{"source": 5}').when(slot == 4, '{"timestamp": "soon"}').when(slot == 5, "[1]").otherwise('{"source": "a", "timestamp": "2024-01-01T00:00:00Z"}')
    records = table(spark, sf, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 900).cast("string")).alias("id"), "text", metadata.alias("metadata"))
    deleted = table(spark, sf, "labels").filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return vt.validate_snapshot(records, deleted).select("records", "deleted", "long_texts", "bad_metadata", "duplicate_ids")


@query("export_increment", rows_sql("SELECT row_id, doc_id AS id, document, (SELECT max(row_id) FROM vault) AS next_cursor FROM vault WHERE row_id > 800"))
def _increment(spark, sf):
    packet, cursor = vt.export_increment(vault_rows(spark, sf), 800)
    return packet.select("row_id", "id", "document", F.lit(cursor).cast("bigint").alias("next_cursor"))


def chosen_ids(spark, sf):
    labels = table(spark, sf, "labels").select(F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("doc_id"))
    return labels.unionByName(labels)


@query("forget", rows_sql("SELECT doc_id, doc_id IN (SELECT 'ev_' || doc_id FROM labels) AS forgotten FROM vault"))
def _forget(spark, sf):
    remaining, gone = vt.forget(vault_rows(spark, sf), chosen_ids(spark, sf))
    return remaining.select("doc_id", F.lit(False).alias("forgotten")).unionByName(gone.select("doc_id", F.lit(True).alias("forgotten")))


@query("assign_project", rows_sql("""SELECT doc_id, CASE WHEN doc_id IN (SELECT 'ev_' || doc_id FROM labels) THEN 'p8' ELSE (metadata::JSON->>'project') END AS project,
   (metadata::JSON->>'k')::INT AS k, doc_id IN (SELECT 'ev_' || doc_id FROM labels) AND (metadata::JSON->>'project') IS DISTINCT FROM 'p8' AS updated FROM vault"""))
def _assign(spark, sf):
    out = vt.assign_project(vault_rows(spark, sf), chosen_ids(spark, sf), "p8")
    return out.select("doc_id", F.get_json_object("metadata", "$.project").alias("project"), F.get_json_object("metadata", "$.k").cast("int").alias("k"), "updated")


@query("update_metadata", rows_sql("""SELECT v.doc_id, (metadata::JSON->>'source') AS source, CASE WHEN l.quality IS NULL THEN (metadata::JSON->>'k')::INT ELSE l.quality END AS k,
   l.toxic, l.quality IS NOT NULL AS updated FROM vault v LEFT JOIN (SELECT 'ev_' || doc_id AS doc_id, quality, toxic FROM labels) l ON l.doc_id = v.doc_id"""))
def _update(spark, sf):
    patch = F.to_json(F.struct(F.col("quality").alias("k"), "toxic"))
    updates = table(spark, sf, "labels").select(F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("doc_id"), patch.alias("patch"))
    out = vt.update_metadata(vault_rows(spark, sf), updates)
    return out.select("doc_id", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("source",)],
                      F.get_json_object("metadata", "$.k").cast("int").alias("k"), F.get_json_object("metadata", "$.toxic").cast("int").alias("toxic"), "updated")


@query("evict_lru", rows_sql("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY last_accessed, row_id) AS rn, count(*) OVER () AS n FROM vault) WHERE rn > n - 700"""))
def _evict(spark, sf):
    kept, _ = vt.evict_lru(vault_rows(spark, sf), 700)
    return kept.select("doc_id")


@query("touch", rows_sql("""SELECT v.doc_id, greatest(last_accessed, coalesce(a.at, last_accessed))::VARCHAR AS accessed FROM vault v LEFT JOIN
   (SELECT 'ev_' || user_id AS doc_id, max(ts) AS at FROM events GROUP BY 1) a ON a.doc_id = v.doc_id"""))
def _touch(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("ev_"), F.col("user_id").cast("string")).alias("doc_id"), F.col("ts").cast("timestamp").alias("accessed_at"))
    return vt.touch(vault_rows(spark, sf), log).select("doc_id", F.col("last_accessed").cast("string").alias("accessed"))


@query("check_model_pin", """SELECT vec_id, CASE WHEN label = 9 THEN false ELSE label % 2 = 1 OR (label % 3 = 0) END AS violation FROM embeddings""")
def _pin(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select("vec_id", F.col("label").cast("string").alias("collection"), F.when(F.col("label") % 2 == 1, "other").otherwise("base").alias("model"), "embedding")
    pins = e.filter("label <> 9").select("label").distinct().select(
        F.col("label").cast("string").alias("collection"), F.lit("base").alias("embedding_model"),
        F.when(F.col("label") % 3 == 0, 32).otherwise(64).alias("embedding_dim"))
    return vt.check_model_pin(rows, pins).select("vec_id", "violation")


@query("rebuild_embeddings", f"""WITH h AS (SELECT doc_id AS vec_id, embedding FROM ({hash_sql('documents', 'doc_id')})),
   {ENTROPY_SQL.replace('FROM embeddings)', 'FROM h)')} SELECT vec_id AS doc_id, lang, round(embedding[1], 6) AS first, round(entropy, 6) AS entropy
   FROM entropies JOIN h USING (vec_id) JOIN documents ON doc_id = vec_id""")
def _rebuild(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"), "lang")
    out = vt.rebuild_embeddings(d, lambda text: vx.hash_embedding(text, DIM))
    return out.select("doc_id", "lang", F.round(F.col("embedding")[0], 6).alias("first"), F.round("entropy", 6).alias("entropy"))


HISTORY_CTE = """lines AS (SELECT user_id, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'ls' WHEN 1 THEN ': ' || epoch(ts)::BIGINT || ':0;cmd ' || (value::INT % 40)
     WHEN 2 THEN ' make ' || event_type || ' ' WHEN 3 THEN ': ' || epoch(ts)::BIGINT || ':7;cd ' || event_type ELSE 'run ' || (value::INT % 40) END AS value FROM events),
   parsed AS (SELECT user_id, event_id, ts, CASE WHEN regexp_matches(trim(value), '^:\\s*[0-9]+:[0-9]+;') THEN trim(regexp_replace(trim(value), '^:\\s*[0-9]+:[0-9]+;', '')) ELSE trim(value) END AS text FROM lines),
   good AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM parsed WHERE length(text) >= 3 AND text NOT IN ('ls','history')
     AND NOT starts_with(text, 'cd ') AND NOT starts_with(text, 'ls '))"""


def history_lines(spark, sf):
    e = table(spark, sf, "events")
    slot, number = F.col("event_id") % 5, (F.bround("value").cast("int") % 40).cast("string")
    epoch = F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) / 1_000_000
    stamp = F.concat(F.lit(": "), epoch.cast("bigint").cast("string"))
    value = (F.when(slot == 0, "ls").when(slot == 1, F.concat(stamp, F.lit(":0;cmd "), number)).when(slot == 2, F.concat(F.lit(" make "), "event_type", F.lit(" ")))
             .when(slot == 3, F.concat(stamp, F.lit(":7;cd "), "event_type")).otherwise(F.concat(F.lit("run "), number)))
    return e.select("user_id", "event_id", "ts", value.alias("value"))


@query("shell_history", f"""WITH RECURSIVE {HISTORY_CTE},
   walk(user_id, i, event_id, text, fresh, kept) AS (
     SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, []::VARCHAR[] FROM good
     UNION ALL SELECT g.user_id, g.i, g.event_id, g.text, NOT list_contains(w.kept, g.text),
       CASE WHEN list_contains(w.kept, g.text) THEN w.kept ELSE list_append(w.kept, g.text)[-20:] END
     FROM walk w JOIN good g ON g.user_id = w.user_id AND g.i = w.i + 1)
   SELECT user_id, event_id, text FROM walk WHERE fresh""")
def _history(spark, sf):
    return files.shell_history(history_lines(spark, sf), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "text")


@query("read_log", """SELECT 'c' || (user_id % 4) || '.jsonl' AS chain, count(*) AS records, sum(event_id)::BIGINT AS total, min(epoch_us(ts)::VARCHAR) AS first FROM events GROUP BY 1""")
def _log(spark, sf):
    """Writes JSON-lines logs derived from the events, then reads them with the fixed schema."""
    path = files.scratch_path(spark, "logs")
    e = table(spark, sf, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("file"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), "event_type", F.lit("x").alias("content_fingerprint"))
    # A chain is one file by definition of the format, and its name is the file's.
    e.repartition("file").write.partitionBy("file").json(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        for part in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            if part.getPath().getName().startswith("part-"):
                fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getPath(), folder.getPath().getName().split("=")[1] + ".jsonl"))
    logs = files.read_log(spark, path, files.BLOCK_SCHEMA)
    return logs.groupBy("chain").agg(F.count("*").alias("records"), F.sum("seq").alias("total"), F.min("timestamp").alias("first"))
