"""Rolling telemetry over per-key query states: trend, health, drift, momentum, similarity alerts.

Input rows carry ``key``, an order, ``residual``, ``route``, ``local`` and nullable ``aligned`` vectors.
Look-back is bounded (16 or 20 rows), so windows run on chunks; only the drift guard is a true state
machine and is folded along each key.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators.ordered import chunk_window, fold_ordered, ordered_chunks, own_rows

WINDOW = 16
SKIPPED_ROUTES = ["local", "speculative", "distilled", "cache"]
DECAY = 0.85


def residual(local: Column, aligned: Column) -> Column:
    """Length of the correction relative to the local vector; 0 without one."""
    from echotrail.functions.vectors import doubles, norm

    a, b = doubles(local), doubles(aligned)
    size = norm(a)
    gap = norm(F.zip_with(b, a, lambda x, y: x - y))
    return F.when(aligned.isNull() | (size <= 1e-8), 0.0).otherwise(gap / size)


def similarity(local: Column, aligned: Column) -> Column:
    from echotrail.functions.vectors import dot, doubles, norm

    a, b = doubles(local), doubles(aligned)
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def blend_states(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Convex blend of local and aligned; the further apart they are, the more local counts."""
    from echotrail.functions.vectors import doubles, norm

    a, b = doubles(F.col("local")), doubles(F.col("aligned"))
    gap = norm(F.zip_with(b, a, lambda x, y: x - y)) / (norm(a) + 1e-8)
    weight = alpha / (1.0 + F.exp(gap - 1.0))
    out = df.withColumn("effective_alpha", weight)
    return out.withColumn("blended", F.zip_with(a, b, lambda x, y: (1.0 - F.col("effective_alpha")) * x + F.col("effective_alpha") * y))


def rolling_trend(df: DataFrame, key: str, order: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Slope of the residual over the aligned rows of the last 16, with the window's row count.

    The x of an aligned row is its running number among aligned rows; a slope ignores where x starts,
    so numbering within the chunk is enough.
    """
    chunks = ordered_chunks(df, [key], order, WINDOW - 1, chunk_rows)
    base = chunk_window([key])
    running = base.rowsBetween(-(10**9), 0)
    frame = base.rowsBetween(-(WINDOW - 1), 0)
    aligned = F.col("aligned_flag")
    x = F.when(aligned, F.sum(aligned.cast("double")).over(running))
    y = F.when(aligned, F.col("residual"))
    rows = chunks.withColumn("aligned_flag", F.col("aligned").isNotNull()).withColumn("_x", x).withColumn("_y", y)
    n = F.count("_y").over(frame)
    slope = F.regr_slope("_y", "_x").over(frame)
    rows = rows.withColumn("trend", F.when(n < 3, 0.0).otherwise(F.coalesce(slope, F.lit(0.0))))
    rows = rows.withColumn("window_rows", F.count(F.lit(1)).over(frame))
    return own_rows(rows).drop("_x", "_y", "aligned_flag")


def health(drift: Column, window_rows: Column, trend: Column) -> Column:
    return (
        F.when(drift, "drift").when(window_rows < 3, "cold").when(trend < -0.01, "converging")
        .when(trend > 0.02, "degrading").otherwise("healthy")
    )


def speculative_threshold(base: Column, drift: Column, window_rows: Column, trend: Column, scaling: float = 2.0,
                          tightening: float = 0.25) -> Column:
    """Base threshold scaled by the trend and kept in [0.5, 3] of it; under drift at most a quarter."""
    moved = base * (1.0 + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -trend * scaling)))
    tight = F.greatest(base * 0.05, F.least(base * 3.0, F.least(moved, base * tightening)))
    free = F.greatest(base * 0.5, F.least(base * 3.0, moved))
    return F.when(window_rows < 3, base).when(drift, tight).otherwise(free)


def similarity_baseline_alert(df: DataFrame, key: str, order: list[str], rows: int = 20, chunk_rows: int | None = None) -> DataFrame:
    """Rolling mean of the last 20 similarities against the first full window's mean; alert below 85 %.

    ``df`` has ``similarity``. The first full window is the row at position 20, one per key, so the
    baseline joins back by key instead of travelling through an unbounded frame.
    """
    chunks = ordered_chunks(df, [key], order, rows - 1, chunk_rows)
    mean = F.avg("similarity").over(chunk_window([key]).rowsBetween(-(rows - 1), 0))
    rolled = own_rows(chunks.withColumn("mean", mean)).withColumn("mean", F.when(F.col("pos") >= rows, F.col("mean")))
    baseline = rolled.filter(F.col("pos") == rows).select(F.col(key).alias("_key"), F.col("mean").alias("baseline"))
    joined = rolled.join(baseline, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    alert = (F.col("pos") > rows) & (F.col("baseline") > 1e-5) & (F.col("mean") < F.col("baseline") * 0.85)
    return joined.withColumn("alert", F.coalesce(alert, F.lit(False)))


def route_report(df: DataFrame, key: str) -> DataFrame:
    """Per key: share of each route, skip rate, and mean alpha, entropy and (aligned) residual."""
    total = df.groupBy(key, "route").agg(
        F.count("*").alias("n"), F.sum("adaptive_alpha").alias("alpha"), F.sum("entropy").alias("entropy"),
        F.sum(F.when(F.col("aligned").isNotNull(), F.col("residual"))).alias("residual"), F.count("aligned").alias("aligned"))
    shares = total.groupBy(key).agg(
        F.sum("n").alias("rows"),
        F.sort_array(F.collect_list(F.struct("route", "n"))).alias("routes"),  # one entry per route name
        (F.sum(F.when(F.col("route").isin(SKIPPED_ROUTES), F.col("n")).otherwise(0)) / F.sum("n")).alias("skip_rate"),
        (F.sum("alpha") / F.sum("n")).alias("mean_alpha"), (F.sum("entropy") / F.sum("n")).alias("mean_entropy"),
        F.coalesce(F.sum("residual") / F.nullif(F.sum("aligned"), F.lit(0)), F.lit(0.0)).alias("mean_residual"))
    return shares.withColumn("routes", F.transform("routes", lambda r: F.struct(r["route"].alias("route"), (r["n"] / F.col("rows")).alias("share"))))


# --- momentum -----------------------------------------------------------------------------


def _momentum(corrections: list[np.ndarray]) -> np.ndarray | None:
    """Weighted mean of recent corrections, the newest weighing most; needs two of one length."""
    if not corrections:
        return None
    same = [c for c in corrections if len(c) == len(corrections[0])]
    if len(same) < 2:
        return None
    weights = DECAY ** np.arange(len(same) - 1, -1, -1)
    return (np.stack(same) * (weights / weights.sum())[:, None]).sum(axis=0)


def momentum(df: DataFrame, key: str, order: list[str], beta_max: float = 0.3, chunk_rows: int | None = None) -> DataFrame:
    """Momentum vector at each row, its stability, and the local vector corrected by it.

    Each row sees the 16 rows up to itself; stability compares with the momentum one row earlier.
    That is a look-back of 16 rows, so a chunk with its halo is all a task needs.
    """
    chunks = ordered_chunks(df, [key], order, WINDOW, 8192 if chunk_rows is None else chunk_rows)
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField("pos", T.LongType()), T.StructField("momentum", T.ArrayType(T.DoubleType())),
        T.StructField("stability", T.DoubleType()), T.StructField("corrected", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        gaps = [None if a is None else np.asarray(a, float) - np.asarray(b, float) for a, b in zip(rows["aligned"], rows["local"])]
        moments, stable, fixed = [], [], []
        for i in range(len(rows)):
            now = _momentum([g for g in gaps[max(0, i - WINDOW + 1): i + 1] if g is not None])
            before = None if i == 0 else moments[-1]
            local = np.asarray(rows["local"].iloc[i], float)
            level = 0.0
            if now is not None and before is not None and len(now) == len(before):
                size = max(np.linalg.norm(now), 1e-8) * max(np.linalg.norm(before), 1e-8)
                level = max(0.0, float(now @ before) / size)
            beta = beta_max * (level - 0.5) / 0.5 if level >= 0.5 else 0.0
            moments.append(now if now is not None else before)
            stable.append(level)
            fixed.append(local + beta * now if beta > 0 else local)
            rows.at[i, "_now"] = now is not None
        rows["momentum"] = [m if ok else None for m, ok in zip(moments, rows.get("_now", []))]
        rows["stability"], rows["corrected"] = stable, fixed
        return rows.loc[rows["_own"], names]

    return chunks.groupBy(key, "_chunk").applyInPandas(run, schema)


# --- drift guard --------------------------------------------------------------------------


@dataclass
class DriftSettings:
    window: int = WINDOW
    min_samples: int = 8
    relative: float = 0.15
    ph_delta: float = 0.002
    ph_threshold: float = 0.05
    recovery: int = 3


# Observations that one vector step looks at.
GUARD_BLOCK = 1024


@dataclass
class Guard:
    """The guard's memory of one key between slices; small enough to travel as a string.

    ``tail`` holds the last observations, at most a window of them. ``climb`` is the Page-Hinkley sum since its
    last reset: observations, their sum, the accumulated excess and its lowest value. ``good`` counts acceptable
    levels in a row while the guard is drifting.
    """

    tail: list[float] = field(default_factory=list)
    climb: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    baseline: float | None = None
    drifting: bool = False
    good: int = 0
    reason: str = "insufficient_samples"

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str | None) -> "Guard":
        return Guard(**json.loads(text)) if text else Guard()


def _windows(x: np.ndarray, tail: list[float], s: DriftSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per observation: size and mean of the window that ends there, and how much its newer half lies above its older."""
    held = np.concatenate([np.asarray(tail, float), x])
    sums = np.concatenate([[0.0], np.cumsum(held)])
    end = np.arange(len(tail), len(held)) + 1
    size = np.minimum(end, s.window)
    begin, middle = end - size, end - size + size // 2
    older = (sums[middle] - sums[begin]) / np.maximum(size // 2, 1)
    newer = (sums[end] - sums[middle]) / np.maximum(size - size // 2, 1)
    rise = np.where(size >= 2 * s.min_samples, (newer - older) / np.maximum(np.abs(older), 1e-8), 0.0)
    return size, (sums[end] - sums[begin]) / size, rise


def _climbs(x: np.ndarray, climb: list[float], s: DriftSettings) -> np.ndarray:
    """The Page-Hinkley memory after each observation, one row each."""
    count, total = climb[0] + np.arange(1, len(x) + 1), climb[1] + np.cumsum(x)
    excess = climb[2] + np.cumsum(x - total / count - s.ph_delta)
    return np.column_stack([count, total, excess, np.minimum(np.minimum.accumulate(excess), climb[3])])


def guard_views(values: np.ndarray, guard: Guard, s: DriftSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drifting, reason and baseline after each observation; ``guard`` moves on to the end.

    A key's life is a chain of stretches: warming up, calm, drifting, calm again. Within a stretch everything is
    one vector pass over a block; only where a stretch ends does the guard change.
    """
    x = np.maximum(0.0, np.asarray(values, float))
    size, level, rise = _windows(x, guard.tail, s)
    drifting, reason, baseline = np.zeros(len(x), bool), np.empty(len(x), object), np.full(len(x), np.nan)
    at = 0
    while at < len(x):
        part = slice(at, min(len(x), at + GUARD_BLOCK))
        climbs, levels = _climbs(x[part], guard.climb, s), level[part]
        span = len(levels)
        if guard.baseline is None:
            enough = np.flatnonzero(size[part] >= s.min_samples)
            span = enough[0] + 1 if len(enough) else span
            reasons = ["insufficient_samples"] * span
            bases = np.full(span, np.nan)
            if len(enough):
                guard.baseline = bases[-1] = float(levels[span - 1])
                reasons[-1] = "baseline_established"
            state = np.zeros(span, bool)
        elif guard.drifting:
            fine = levels <= guard.baseline * (1.0 + s.relative / 2)
            place = np.arange(1, span + 1)
            # Acceptable levels in a row, the ones before this block included.
            row = place - np.maximum.accumulate(np.where(fine, -guard.good, place))
            over = np.flatnonzero(row >= s.recovery)
            span = over[0] + 1 if len(over) else span
            reasons = np.where(fine[:span], "recovering", "residual_drift").tolist()
            state, bases = np.ones(span, bool), np.full(span, guard.baseline)
            guard.good = int(row[span - 1])
            if len(over):
                reasons[-1], state[-1], guard.drifting = "recovered", False, False
                guard.baseline = bases[-1] = float(levels[span - 1])
                climbs[span - 1] = 0.0
        else:
            trail = np.array(list(accumulate(levels.tolist(), lambda b, now: 0.95 * b + 0.05 * now, initial=guard.baseline)))
            above = (levels - trail[:-1]) / np.maximum(np.abs(trail[:-1]), 1e-8)
            hits = np.flatnonzero((above >= s.relative) | (rise[part] >= s.relative) | (climbs[:, 2] - climbs[:, 3] >= s.ph_threshold))
            span = hits[0] + 1 if len(hits) else span
            reasons, state, bases = ["stable"] * span, np.zeros(span, bool), trail[1:span + 1].copy()
            if len(hits):
                reasons[-1], state[-1], bases[-1] = "residual_drift", True, trail[span - 1]
                guard.drifting, guard.good = True, 0
            guard.baseline = float(bases[-1])
        done = slice(at, at + span)
        drifting[done], reason[done], baseline[done] = state, reasons, bases
        guard.climb, guard.reason = climbs[span - 1].tolist(), reasons[-1]
        at += span
    guard.tail = np.concatenate([np.asarray(guard.tail, float), x])[-s.window:].tolist()
    return drifting, reason, baseline


# Keys with fewer rows than this are walked in plain numbers; vectors pay from here on.
GUARD_WALK = 256


def _walk(residuals: list[float], seen: list[bool], guard: Guard, s: DriftSettings, active: list, reasons: list, baselines: list) -> None:
    """Appends the guard's view after each row: ``guard_views`` for few rows, with the same sums in the same order."""
    values = [max(0.0, v) for v, ok in zip(residuals, seen) if ok]
    held = guard.tail + values
    sums = [0.0, *accumulate(held)]
    n = len(guard.tail)
    window, half, baseline = s.window, 2 * s.min_samples, guard.baseline
    # The Page-Hinkley sum starts anew from ``climb`` at every stretch.
    count, total, excess, low = guard.climb
    steps, part, gone = 0, 0.0, 0.0
    at = 0
    shown = math.nan if baseline is None else baseline
    for ok in seen:
        if ok:
            x = values[at]
            at += 1
            end = n + at
            size = min(end, window)
            begin, middle = end - size, end - size + size // 2
            level = (sums[end] - sums[begin]) / size
            steps, part = steps + 1, part + x
            gone += x - (total + part) / (count + steps) - s.ph_delta
            now = excess + gone
            low = min(low, now)
            ends = False
            if baseline is None:
                guard.reason, shown = "insufficient_samples", math.nan
                if size >= s.min_samples:
                    guard.reason, baseline, ends = "baseline_established", level, True
                    shown = baseline
            elif guard.drifting:
                fine = level <= baseline * (1.0 + s.relative / 2)
                guard.good = guard.good + 1 if fine else 0
                guard.reason, shown = "recovering" if fine else "residual_drift", baseline
                if guard.good >= s.recovery:
                    guard.reason, guard.drifting, baseline = "recovered", False, level
                    shown = baseline
                    count = total = excess = low = part = gone = now = 0.0
                    steps = 0
            else:
                above = (level - baseline) / max(abs(baseline), 1e-8)
                rise = 0.0
                if size >= half:
                    older = (sums[middle] - sums[begin]) / max(size // 2, 1)
                    rise = ((sums[end] - sums[middle]) / max(size - size // 2, 1) - older) / max(abs(older), 1e-8)
                if above >= s.relative or rise >= s.relative or now - low >= s.ph_threshold:
                    guard.reason, guard.drifting, guard.good, ends = "residual_drift", True, 0, True
                else:
                    guard.reason, baseline = "stable", 0.95 * baseline + 0.05 * level
                shown = baseline
            if ends:
                count, total, excess = count + steps, total + part, now
                steps, part, gone = 0, 0.0, 0.0
        active.append(guard.drifting)
        reasons.append(guard.reason)
        baselines.append(shown)
    guard.baseline = baseline
    guard.climb = [float(count + steps), total + part, excess + gone, low]
    guard.tail = held[-window:]


def drift_keys(rows: pd.DataFrame, starts: list[int], before: list[str | None], s: DriftSettings) -> tuple[pd.DataFrame, list[str]]:
    """``drift_rows`` for many keys at once: the rows of key ``i`` begin at ``starts[i]``, its guard was ``before[i]``."""
    seen = ((rows["route"] == "cloud") & rows["is_aligned"].fillna(False).astype(bool)).tolist()
    residuals = rows["residual"].astype(float).tolist()
    active: list[bool] = []
    reasons: list[str] = []
    baselines: list[float] = []
    after = []
    for start, end, text in zip(starts, [*starts[1:], len(rows)], before):
        guard = Guard.load(text)
        if end - start < GUARD_WALK and not any(v != v for v in residuals[start:end]):
            _walk(residuals[start:end], seen[start:end], guard, s, active, reasons, baselines)
        else:
            shown = drift_rows(rows.iloc[start:end], guard, s)
            active += shown["drift_active"].tolist()
            reasons += shown["drift_reason"].tolist()
            baselines += shown["drift_baseline"].tolist()
        after.append(guard.dump())
    return rows.assign(drift_active=active, drift_reason=reasons, drift_baseline=baselines), after


def drift_rows(rows: pd.DataFrame, guard: Guard, s: DriftSettings) -> pd.DataFrame:
    """Adds the guard's view after each of the ordered ``rows``; only aligned rows of the cloud route are observed."""
    first = (guard.drifting, guard.reason, np.nan if guard.baseline is None else guard.baseline)
    seen = ((rows["route"] == "cloud") & rows["is_aligned"].fillna(False).astype(bool)).to_numpy()
    views = guard_views(rows["residual"].to_numpy(dtype=float)[seen], guard, s)
    # Each row shows the view after the observations up to it.
    active, reason, baseline = (np.concatenate([np.array([f], dtype=v.dtype), v])[np.cumsum(seen)] for f, v in zip(first, views))
    return rows.assign(drift_active=active, drift_reason=reason, drift_baseline=baseline)


def drift_schema(df: DataFrame) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [
        T.StructField("drift_active", T.BooleanType()), T.StructField("drift_reason", T.StringType()),
        T.StructField("drift_baseline", T.DoubleType())])


def residual_drift_guard(df: DataFrame, key: str, order: list[str], settings: DriftSettings = DriftSettings(),
                         slice_rows: int | None = None) -> DataFrame:
    """Batch twin of the streaming guard. ``df`` has ``residual, route, is_aligned``."""
    from echotrail.operators.ordered import CHUNK_ROWS

    def step(rows: pd.DataFrame, before: str | None):
        guard = Guard.load(before)
        out = drift_rows(rows, guard, settings)
        return out, guard.dump()

    def many(rows: pd.DataFrame, starts: list[int], before: list[str | None]):
        return drift_keys(rows, starts, before, settings)

    return fold_ordered(df, [key], order, step, drift_schema(df), CHUNK_ROWS if slice_rows is None else slice_rows, many)
