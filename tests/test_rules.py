"""Text rules, the event view, the vault, embedding space and topology on small hand-made inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrail.functions import text as tx, vectors as vx
from echotrail.operators import embedding_space as es, events as ev, governance as gov, topology as tda


def column(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["v"] for r in rows.select("i", expr(F.col("text")).alias("v")).orderBy("i").collect()]


def test_sensitivity_classes(spark):
    texts = ["password = hunter2", "AKIA" + "A" * 16, "def f(x): return x", "https://example.org/a?b=c", "Zz0_" * 10, "Zz0_" * 10 + " x",
             "", None, "pw", 'token = "' + "0f" * 20 + '"', "token=" + "0f" * 16]
    assert column(spark, texts, tx.sensitivity) == [
        "sensitive", "sensitive", "safe", "safe", "unknown", "safe", "safe", "safe", "safe", "safe", "sensitive"]


def test_redact(spark):
    got = column(spark, ["secret: abc rest", "x ghp_" + "a" * 36 + " y", "api_key=1 token:2"], tx.redact)
    assert got == ["secret: [REDACTED] rest", "x [REDACTED] y", "api_key=[REDACTED] token:[REDACTED]"]


def test_pii_order_and_boundaries(spark):
    rows = spark.createDataFrame([(0, "a@b.co 415-555-0100 é123-45-6789é Dr. Ada Lovelace 10.1.2.3")], "doc_id int, text string")
    out = gov.scrub_pii(rows).first()
    assert out["scrubbed"].startswith("[REDACTED_EMAIL] [REDACTED_PHONE] é123-45-6789é")
    assert "[REDACTED_NAME]" in out["scrubbed"] and "[REDACTED_IP_ADDRESS]" in out["scrubbed"] and out["n_ssn"] == 0


def test_words_survive_very_long_runs(spark):
    long = "a-" * 60000 + "b"
    words = column(spark, [long, "foo--bar_baz.. x-1 The", "a.b-c_d"], tx.overlap_words)
    assert words[0] == [long] and sorted(words[1]) == ["bar_baz", "foo", "x-1"] and words[2] == ["a.b-c_d"]


def test_terms_follow_unicode_words(spark):
    assert column(spark, ["naïve foo_bar Café 12ab ok", "ÜBER x"], tx.index_terms) == [["12ab", "ok"], ["x"]]


def test_error_like(spark):
    texts = ["all fine", "Fatal: x", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne\n", "a\nb\nc\nd\ne\nf"]
    assert column(spark, texts, tx.looks_like_error) == [False, True, False, False, True]


def test_hash_embedding_matches_definition(spark):
    import hashlib

    text = "hello wörld"
    h = hashlib.sha256(text.encode()).digest()
    more = b"".join(hashlib.sha256(h + i.to_bytes(4, "big")).digest() for i in range(128 * 4 // 32 + 1))
    v = np.array([(more[i * 4] | more[i * 4 + 1] << 8) / 65535.0 * 2 - 1 for i in range(128)])
    got = column(spark, [text], lambda t: vx.hash_embedding(t, 128))[0]
    assert np.allclose(got, v / (np.linalg.norm(v) + 1e-8))


def test_entropy_edge_cases(spark):
    rows = [[1.0, 1.0, 1.0], [0.0, 1.0], [], [float("nan"), float("inf"), -1.0, 0.5], None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v array<double>")
    got = [r["e"] for r in df.select("i", vx.vector_entropy(F.col("v")).alias("e")).orderBy("i").collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12 and got[2] == 0.0 and abs(got[3] - 2.0) < 1e-12 and got[4] == 0.0


def stored(spark):
    rows = [
        ("cmd_1", "main", "ls -la", '{"timestamp":"2024-01-01T12:00:00+02:00","project":"p"}', "2024-01-02 00:00:00"),
        ("x2", "main", "note", '{"event_type":"Note","source":"app","timestamp":1700000000}', "2024-01-02 00:00:00"),
        ("x3", "main", None, "{}", "2024-01-03 00:00:00")]
    return spark.createDataFrame(rows, "doc_id string, collection string, document string, metadata string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def test_event_view(spark):
    got = {r["id"]: r for r in ev.normalize_events(stored(spark)).withColumn("iso", ev.iso(F.col("timestamp"))).collect()}
    assert got["cmd_1"]["type"] == "terminal" and got["cmd_1"]["iso"] == "2024-01-01T10:00:00.000000Z" and got["cmd_1"]["source"] == "unknown"
    assert got["x2"]["type"] == "note" and got["x2"]["iso"] == "2023-11-14T22:13:20.000000Z"
    assert got["x3"]["type"] == "clipboard" and got["x3"]["timestamp_inferred"] and got["x3"]["text"] == ""


def test_scope_nulls_and_empty_lists(spark):
    e = ev.normalize_events(stored(spark))
    assert {r["id"] for r in ev.filter_scope(e, projects=[None]).collect()} == {"x2", "x3"}
    assert {r["id"] for r in ev.filter_scope(e, projects=["p", None]).collect()} == {"cmd_1", "x2", "x3"}
    assert ev.filter_scope(e, projects=[]).count() == 0 and ev.filter_scope(e, sources=[]).count() == 0
    with pytest.raises(ValueError):
        ev.filter_scope(e, since="2024-02-01", until="2024-01-01")


def test_cursor_is_bound_to_its_scope(spark):
    e = ev.normalize_events(stored(spark))
    first = ev.fetch_events(e, 2)
    assert [r["id"] for r in first["events"]] == ["x3", "cmd_1"]
    second = ev.fetch_events(e, 2, first["next_cursor"])
    assert [r["id"] for r in second["events"]] == ["x2"] and second["next_cursor"] is None
    with pytest.raises(ValueError):
        ev.fetch_events(e, 2, first["next_cursor"], sources=["app"])


def test_metadata_filter_is_typed(spark):
    rows = spark.createDataFrame([("a", '{"k":1,"s":"x"}'), ("b", '{"k":"1"}'), ("c", '{"k":null}'), ("d", "{bad"), ("e", "{}"), ("f", '{"k":1.0}'), ("g", '{"k":true}')], "doc_id string, metadata string")

    def ids(where):
        return {r["doc_id"] for r in ev.filter_metadata(rows, where).collect()}

    assert ids({"k": 1}) == {"a", "f", "g"} and ids({"k": "1"}) == {"b"} and ids({"k": None}) == {"c", "e"} and ids({"s": "x", "k": 1}) == {"a"}


def test_vault_ingest_is_idempotent_and_forgets(spark, folder):
    from echotrail.sources.vault import Vault

    vault = Vault(spark, folder)
    batch = spark.createDataFrame(
        [(1, "main", "a", "first", [1.0]), (2, "main", "a", "second", [1.0]), (3, "other", "a", "third", [2.0]), (4, "main", None, "no id", [3.0]), (5, "main", "n", "nan", [float("nan")])],
        "pos int, collection string, doc_id string, document string, embedding array<double>")
    assert vault.ingest(batch) == {"accepted": 3, "known": 1, "forgotten": 0, "invalid": 1}
    assert vault.ingest(batch)["accepted"] == 0
    assert {r["document"] for r in vault.rows().collect()} == {"first", "third", "no id"}
    ids = spark.createDataFrame([("a",), ("a",), ("zzz",)], "doc_id string")
    with pytest.raises(ValueError):
        vault.forget(ids)
    assert vault.forget(ids, "main") == 1
    assert {r["document"] for r in vault.rows().collect()} == {"third", "no id"}
    again = vault.ingest(batch)
    assert again["accepted"] == 0 and again["forgotten"] == 2 and vault.rows("main").count() == 1


def test_row_ids_grow_over_ingests(spark, folder):
    from echotrail.sources import vault as vt

    vault = vt.Vault(spark, folder)
    rows = lambda names: spark.createDataFrame([(i, "main", n, n, [1.0, 2.0]) for i, n in enumerate(names)],
                                               "pos int, collection string, doc_id string, document string, embedding array<double>").repartition(3)
    vault.ingest(rows("abc"))
    first, cursor = vt.export_increment(vault.rows(), 0)
    assert {r["id"] for r in first.collect()} == set("abc") and cursor == 3
    vault.ingest(rows("cde"))
    later, cursor = vt.export_increment(vault.rows(), cursor)
    assert {r["id"]: r["row_id"] for r in later.collect()} == {"d": 4, "e": 5} and cursor == 5


def test_collections_are_pinned_to_a_model(spark, folder):
    from echotrail.sources.vault import Vault

    vault = Vault(spark, folder)
    vault.pin("main", "m1", 2)
    vault.pin("main", "m1", 2)
    with pytest.raises(ValueError):
        vault.pin("main", "m2", 2)
    batch = spark.createDataFrame([(1, "main", "a", "x", [1.0, 2.0])], "pos int, collection string, doc_id string, document string, embedding array<double>")
    with pytest.raises(ValueError):
        vault.ingest(batch, model="m2")
    assert vault.ingest(batch, model="m1")["accepted"] == 1


def test_bounds_are_instants(spark):
    e = ev.normalize_events(stored(spark))
    ev.filter_scope(e, since="2024-01-01T12:00:00+02:00", until="2024-01-01T11:00:00Z")
    with pytest.raises(ValueError):
        ev.filter_scope(e, since="2024-01-01T12:00:00Z", until="2024-01-01T13:00:00+02:00")


def test_all_recovery_commands_are_ranked(spark):
    from echotrail.operators import aggregates as ag

    errors = spark.createDataFrame([("k", "2024-01-01 00:00:00")], "key string, ts string")
    commands = spark.createDataFrame([("k", "2024-01-01 00:01:00", f"run {i}") for i in range(25)], "key string, ts string, command string")
    assert ag.recovery_commands(errors, commands, "key").count() == 25
    assert ag.recovery_commands(errors, commands, "key", top=10).count() == 10


def test_snapshot_round_trip_and_refusal(spark, folder):
    from echotrail.sources import vault as vt

    rows = stored(spark).withColumn("last_accessed", F.col("created_at")).fillna({"document": ""})
    gone = spark.createDataFrame([("main", "old")], "collection string, doc_id string")
    vt.snapshot_vault(rows, gone, f"{folder}/a", key=b"k" * 16)
    assert spark.read.parquet(f"{folder}/a/records").filter(F.col("text").contains("ls")).count() == 0
    back, tombs = vt.restore_vault(spark, f"{folder}/a", "main", key=b"k" * 16)
    assert {r["document"] for r in back.collect()} == {"ls -la", "note", ""} and tombs.first()["doc_id"] == "old"
    vt.snapshot_vault(rows, gone.withColumn("doc_id", F.lit("x2")), f"{folder}/b")
    with pytest.raises(ValueError, match="duplicate_ids"):
        vt.restore_vault(spark, f"{folder}/b", "main")


def test_merge_json_keeps_types(spark):
    from echotrail.sources.vault import merge_json

    got = spark.range(1).select(merge_json(F.lit('{"a":1,"b":[1,2],"c":"x"}'), F.lit('{"c":null,"d":2.5}')).alias("m")).first()["m"]
    import json

    assert json.loads(got) == {"a": 1, "b": [1, 2], "c": None, "d": 2.5}


def pairs(spark, a, b):
    return spark.createDataFrame([(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b))],
                                 "doc_id bigint, local array<double>, cloud array<double>").repartition(3)


def test_procrustes_recovers_rotation_and_shift(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((200, 12))
    r, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    fit = es.procrustes_fit(pairs(spark, a, a @ r + 3.0))
    assert np.allclose(fit.to_local(a @ r + 3.0), a, atol=1e-8) and fit.metrics["mse"] < 1e-12 and fit.metrics["correlation"] > 1 - 1e-9
    same = es.procrustes_fit(pairs(spark, a, a))
    assert abs(same.metrics["trace"] - 12) < 1e-8
    zero = es.procrustes_fit(pairs(spark, np.zeros((5, 4)), np.zeros((5, 4))))
    assert zero.metrics["entropy"] == 0.0 and "correlation" in es.alignment_drift_check(zero.metrics, 4)


def test_rotation_is_orthogonal_and_srht_keeps_length():
    key = es.CayleyRotation(40, seed=1)
    x = np.random.default_rng(1).standard_normal((30, 40))
    y = key.rotate(x)
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(key.inverse(y), x)
    assert np.allclose(np.linalg.norm(es.srht(x, 64, 3), axis=1), np.linalg.norm(x, axis=1))


def test_pairwise_distances_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60, 8))
    b = a[:, :5]
    rows = spark.createDataFrame([(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b))], "doc_id bigint, a array<double>, b array<double>")
    i, j = np.triu_indices(60, 1)
    da, db = np.linalg.norm(a[i] - a[j], axis=1), np.linalg.norm(b[i] - b[j], axis=1)
    scale = (da @ db) / (db @ db)
    rel = np.abs(db * scale - da) / da
    got = es.pairwise_distance_stats(rows, block_rows=17)
    assert got["pairs"] == len(i) and abs(got["relative_error"] - np.linalg.norm(da - db) / np.linalg.norm(da)) < 1e-9
    assert abs(got["mean"] - rel.mean()) < 1e-9 and abs(got["p95"] - np.quantile(rel, 0.95)) < 5e-3
    gram = es.gram_relative_error(rows)
    assert abs(gram - np.linalg.norm(a @ a.T - b @ b.T) / np.linalg.norm(a @ a.T)) < 1e-9 if a.shape == b.shape else gram > 0


def test_gate_blocks_drift_and_small_samples(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((80, 6))
    steady = a @ rng.standard_normal((6, 6))
    drifted = steady.copy()
    drifted[60:] += 5
    good = es.gated_correction_model(pairs(spark, a, steady), ["doc_id"])
    bad = es.gated_correction_model(pairs(spark, a, drifted), ["doc_id"])
    few = es.gated_correction_model(pairs(spark, a[:10], steady[:10]), ["doc_id"])
    assert good["graduated"] and bad["reason"] in ("holdout_loss_above_threshold", "train_loss_above_threshold") and few["reason"] == "insufficient_samples"


def test_loops_on_a_circle_only():
    angle = np.linspace(0, 2 * np.pi, 5)[:4]
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    spans = [d - b for b, d, _, _ in tda.loop_intervals(tda.cosine_distances(np.vstack([circle, circle])))]
    assert max(spans) >= 0.3
    random = np.random.default_rng(0).standard_normal((6, 128))
    assert all(d - b < 0.3 for b, d, _, _ in tda.loop_intervals(tda.cosine_distances(random)))


def test_short_histories_never_loop(spark):
    rows = spark.createDataFrame([(1, i, [float(np.cos(i * np.pi / 2)), float(np.sin(i * np.pi / 2))]) for i in range(4)], "k int, doc_id int, embedding array<double>")
    assert not tda.loop_detection(rows, "k", ["doc_id"]).first()["is_loop"]


def test_consolidation_replaces_only_groups(spark):
    from echotrail.operators.consolidate import consolidate_clusters

    rng = np.random.default_rng(0)
    centre = np.eye(4) * 10
    rows = [(i, f"text {i}" if i else "  ", [float(v) for v in centre[i % 4] + rng.normal(0, 0.01, 4)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<double>")
    seen = []
    for limit in (None, 1500):  # broadcast centres, and both sides in blocks
        summaries, replaced = consolidate_clusters(docs, 8, limit=limit)
        seen.append(sorted(r["text"] for r in summaries.collect()))
        total = summaries.agg(F.sum("n")).first()[0]
        assert total == replaced.count() == replaced.distinct().count() and replaced.filter("doc_id = 0").count() == 0
        assert all(r["text"].startswith("Consolidated Summary:\n") and r["text"].count("\n") == r["n"] for r in summaries.collect())
        assert all(len({int(t.split()[1]) % 4 for t in r["text"].split("\n")[1:]}) == 1 for r in summaries.collect())
    assert seen[0] == seen[1]


def test_distances_of_all_pairs_are_taken_once(spark, monkeypatch):
    """Before, every row was shuffled to a cell of every block: 300 copies of 615,360 rows, in each of four passes."""
    monkeypatch.setattr(es, "TILE_ROWS", 10)
    x = np.random.default_rng(2).standard_normal((150, 4))
    y = x * np.array([1.0, 1.1, 0.9, 1.3])
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "doc_id bigint, a array<double>, b array<double>")
    i, j = np.triu_indices(150, 1)
    a, b = np.linalg.norm(x[i] - x[j], axis=1), np.linalg.norm(y[i] - y[j], axis=1)
    copies, by_block = [], es.by_block
    monkeypatch.setattr(es, "by_block", lambda held, met, *rest: copies.append(met.count()) or by_block(held, met, *rest))
    for size, blocks in ((1000, 1), (30, 5), (25, 6)):
        copies.clear()
        got = es.pairwise_distance_stats(rows, block_rows=size)
        assert got["pairs"] == len(a) and abs(got["relative_error"] - np.sqrt(((a - b) ** 2).sum() / (a * a).sum())) < 1e-12
        gap = np.abs(b * (a @ b / (b @ b)) - a) / a
        assert abs(got["mean"] - gap.mean()) < 1e-12 and abs(got["p95"] - np.quantile(gap, 0.95)) < 5e-4
        assert len(copies) == 2 and copies[0] <= 150 * (blocks + 1) / 2
        assert es.pairwise_distance_stats(rows, block_rows=size, gaps=False) == {n: got[n] for n in ("relative_error", "pairs")} and len(copies) == 3


def test_consolidation_deletes_what_its_rounds_wrote(spark, monkeypatch):
    """Before, every round's rows, centres and shuffle files stayed, and texts were written twice."""
    from echotrail import session
    from echotrail.operators import consolidate as co

    texts = []
    keep = co.written
    monkeypatch.setattr(co, "written", lambda df: texts.append("text" in df.columns) or keep(df))
    rng = np.random.default_rng(1)
    rows = [(i, f"text {i}", [float(v) for v in rng.normal(0, 1, 6)]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<double>")
    before = set(session._TABLES)
    summaries, replaced = co.consolidate_clusters(docs, limit=1500)
    left = [t for t in session._TABLES if t not in before]
    assert len(left) == 2 and len(texts) > 6 and not any(texts)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert summaries.agg(F.sum("n")).first()[0] == replaced.count() > 0


def test_share_view_keeps_types(spark):
    from echotrail.operators import governance as gov

    rows = spark.createDataFrame([
        ("a", '{"title":"T","timestamp_inferred":true,"provenance":{"n":1,"who":"me"}}'),
        ("b", '{"title":"ghp_' + "a" * 36 + '","url":null}'),
        ("c", '{"title":"T","own":1}'), ("d", "{}"), ("e", "broken"),
    ], "id string, metadata string").withColumns({
        "type": F.lit("note"), "source": F.lit("s"), "project": F.lit(None).cast("string"), "text": F.lit("plain words"),
        "timestamp": F.lit(None).cast("timestamp"), "captured_at": F.lit(None).cast("timestamp")})
    got = {r["id"]: (r["metadata"], r["redacted"]) for r in gov.share_view(rows).collect()}
    assert got["a"] == ('{"title":"T","timestamp_inferred":true,"provenance":{"n":1,"who":"me"}}', False)
    assert got["b"][1] and "ghp_" not in got["b"][0] and got["c"] == ('{"title":"T"}', True) and got["d"] == ("{}", False) and got["e"] == ("{}", False)
