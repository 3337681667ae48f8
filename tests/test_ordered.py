"""Exact order on skewed keys: one key holds most rows and spans many partitions and chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators import ordered as od


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(600) < 0.6, 0, rng.integers(1, 6, 600))
    frame = pd.DataFrame({"k": keys, "t": rng.integers(0, 50, 600), "id": np.arange(600), "x": rng.random(600)})
    return spark.createDataFrame(frame).withColumn("k", F.when(F.col("k") == 5, None).otherwise(F.col("k")))


def plain(rows, column):
    return rows.withColumn("want", column)


def test_positions_match_row_number(rows):
    got = od.ordered_positions(rows, ["k"], ["t", "id"])
    w = Window.partitionBy("k").orderBy("t", "id")
    both = got.join(rows.select("id", F.row_number().over(w).alias("want")), "id")
    assert both.count() == 600 and both.filter("pos <> want").count() == 0


def test_positions_without_key(rows):
    got = [r["pos"] for r in od.ordered_positions(rows, [], ["t", "id"]).orderBy("t", "id").collect()]
    assert got == list(range(1, 601))


@pytest.mark.parametrize("chunk", [5, 16, 1000])
def test_chunked_lag_and_mean(rows, chunk):
    got = od.ordered_chunks(rows, ["k"], ["t", "id"], 4, chunk)
    w = od.chunk_window(["k"])
    got = od.own_rows(got.withColumn("m", F.avg("x").over(w.rowsBetween(-4, 0))).withColumn("l", F.lag("id").over(w)))
    p = Window.partitionBy("k").orderBy("t", "id")
    want = rows.select("id", F.avg("x").over(p.rowsBetween(-4, 0)).alias("wm"), F.lag("id").over(p).alias("wl"))
    both = got.join(want, "id")
    assert both.count() == 600
    assert both.filter((F.abs(F.col("m") - F.col("wm")) > 1e-12) | ~F.col("l").eqNullSafe(F.col("wl"))).count() == 0


@pytest.mark.parametrize("chunk", [7, 1000])
def test_running_total(rows, chunk):
    got = od.running_total(od.ordered_positions(rows, ["k"], ["t", "id"]), ["k"], "t", "total", chunk)
    p = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = got.join(rows.select("id", F.sum("t").over(p).alias("want")), "id")
    assert both.count() == 600 and both.filter("total <> want").count() == 0


@pytest.mark.parametrize("rows_per_slice", [9, 5000])
def test_fold_carries_state(spark, rows, rows_per_slice):
    known = rows.filter("k IS NOT NULL")
    schema = T.StructType(list(known.schema.fields) + [T.StructField("seen", T.LongType())])

    def step(part, state):
        start = int(state or 0)
        return part.assign(seen=np.arange(start + 1, start + len(part) + 1)), str(start + len(part))

    got = od.fold_ordered(known, ["k"], ["t", "id"], step, schema, rows_per_slice)
    p = Window.partitionBy("k").orderBy("t", "id")
    both = got.join(known.select("id", F.row_number().over(p).alias("want")), "id")
    assert both.count() == known.count() and both.filter("seen <> want").count() == 0


def test_drift_guard_slices_agree(spark):
    from echotrail.operators.temporal import residual_drift_guard

    rng = np.random.default_rng(4)
    level = np.concatenate([np.full(40, 0.2), np.full(40, 0.6), np.full(60, 0.2)])
    frame = pd.DataFrame({"k": 1, "t": np.arange(140), "residual": level + rng.normal(0, 0.01, 140), "route": "cloud", "is_aligned": True})
    df = spark.createDataFrame(frame)
    whole = residual_drift_guard(df, "k", ["t"]).orderBy("t").toPandas()
    sliced = residual_drift_guard(df, "k", ["t"], slice_rows=11).orderBy("t").toPandas()
    assert (whole["drift_reason"] == sliced["drift_reason"]).all()
    reasons = list(whole["drift_reason"])
    assert reasons[:7] == ["insufficient_samples"] * 7 and reasons[7] == "baseline_established"
    assert "residual_drift" in reasons[40:50] and "recovered" in reasons and not whole["drift_active"].iloc[-1]


def test_trend_needs_three_rows(spark):
    from echotrail.operators.temporal import rolling_trend

    df = spark.createDataFrame([(1, t, float(t) * 0.5, 1) for t in range(20)], "k int, t int, residual double, aligned int")
    for chunk in (None, 17):
        got = [r["trend"] for r in rolling_trend(df, "k", ["t"], chunk).orderBy("t").collect()]
        assert got[:2] == [0.0, 0.0] and all(abs(x - 0.5) < 1e-12 for x in got[2:])


def test_recovery_counts_without_pairs(spark):
    from echotrail.operators.aggregates import recovery_commands

    rng = np.random.default_rng(0)
    base = pd.Timestamp("2024-01-01")
    err = pd.DataFrame({"u": rng.integers(0, 2, 60), "s": rng.integers(0, 3000, 60)})
    cmd = pd.DataFrame({"u": rng.integers(0, 2, 200), "s": rng.integers(0, 3000, 200), "command": rng.choice(["ls", "make", "fix"], 200)})
    for f in (err, cmd):
        f["ts"] = base + pd.to_timedelta(f["s"], unit="s")
    got = recovery_commands(spark.createDataFrame(err[["u", "ts"]]), spark.createDataFrame(cmd[["u", "ts", "command"]]), "u", 300, chunk_rows=16)
    pairs = err.merge(cmd, on="u")
    pairs = pairs[(pairs.s_y >= pairs.s_x) & (pairs.s_y <= pairs.s_x + 300) & (pairs.command != "ls")]
    want = pairs.groupby(["u", "command"]).size().to_dict()
    assert {(r["u"], r["command"]): r["n"] for r in got.collect()} == want


def test_binary_auc_against_pairs(spark):
    from echotrail.operators.evaluation import binary_auc

    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 12, 200).astype(float), rng.integers(0, 2, 200)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "s": s, "y": y}))
    got = binary_auc(df, "g", "s", "y", chunk_rows=3).first()["auc"]
    p, n = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert abs(got - want) < 1e-12


def test_chain_faults_across_chunks(spark):
    from echotrail.operators import chain as ch

    import hashlib

    def build(n):
        blocks, prev = [], ch.ZERO_HASH
        for i in range(n):
            core = f"{i}:17000000{i}.5:note:{'a' * 64}:{prev}"
            digest = hashlib.sha256(core.encode()).hexdigest()
            blocks.append(["good", i, i, f"17000000{i}.5", "note", "a" * 64, prev, digest])
            prev = digest
        return blocks

    good = build(30)
    changed = [["changed", *b[1:]] for b in build(30)]
    changed[12][4] = "forged"
    missing = [["missing", *b[1:]] for b in build(30) if b[1] != 9]
    cols = "chain string, position int, seq bigint, timestamp string, event_type string, content_fingerprint string, prev_hash string, block_hash string"
    log = spark.createDataFrame([tuple(b) for b in good + changed + missing], cols)
    for chunk in (None, 4):
        got = {r["chain"]: (r["ok"], r["at"], r["fault"]) for r in ch.verify_fingerprint_chain(log, chunk_rows=chunk).collect()}
        assert got == {"good": (True, None, None), "changed": (False, 12, "digest"), "missing": (False, 9, "sequence")}
