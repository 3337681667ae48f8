"""Exact per-key order at scale: positions, windows in chunks, and carried-state folds.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here rows are range-partitioned
by (key, order), so a key that holds a third of all rows spreads over a third of the tasks. Positions
come from partition-local order plus per-partition counts. Windows that look back a bounded number of
rows then run on fixed-size chunks, each with a copy of the few rows before it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.session import cut_lineage

CHUNK_ROWS = 65_536


def _columns(names: list[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ordered_positions(df: DataFrame, keys: list[str], order: list[str | Column], pos: str = "pos") -> DataFrame:
    """Add the 1-based position of each row within its key. ``order`` must be total within a key."""
    sort = _columns(keys) + _columns(order)
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # The range bounds are sampled, so the partitioning is written down before it is read twice.
    fixed = cut_lineage(ranged.withColumn("_seq", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_seq", 33))
    if not keys:
        firsts = fixed.groupBy("_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
        # One row per partition: the running total is over at most as many rows as there are tasks.
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = firsts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        joined = fixed.join(F.broadcast(offsets), "_part")
    else:
        firsts = fixed.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = firsts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        for k in keys:
            offsets = offsets.withColumnRenamed(k, f"_k_{k}")
        offsets = offsets.withColumnRenamed("_part", "_k_part")
        condition = F.col("_part") == F.col("_k_part")
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = fixed.join(offsets, condition).drop("_k_part", *[f"_k_{k}" for k in keys])
    position = F.col("_offset") + F.col("_seq") - F.col("_first") + 1
    return joined.withColumn(pos, position).drop("_seq", "_part", "_first", "_offset")


def halo_chunks(positioned: DataFrame, halo: int, rows: int | None = None, pos: str = "pos") -> DataFrame:
    """Cut each key into chunks of ``rows`` and repeat the last ``halo`` rows of a chunk in the next.

    Adds ``_chunk`` and ``_own`` (false on the repeated rows, to be dropped after the window).
    """
    rows = CHUNK_ROWS if rows is None else rows
    if rows < halo:
        raise ValueError("a chunk must be at least as long as its halo")
    zero = F.col(pos) - 1
    tail = zero % rows >= rows - halo
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        positioned.withColumn("_copy", F.explode(copies))
        .withColumn("_chunk", F.floor(zero / rows) + F.col("_copy"))
        .withColumn("_own", F.col("_copy") == 0)
        .drop("_copy")
    )


def groups_within(df: DataFrame, keys: list[str], rows: int) -> bool:
    """True when no key has more than ``rows`` rows. Reads the key columns only, with partial counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).limit(1).count() == 0


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str | Column], halo: int, rows: int | None = None) -> DataFrame:
    """Rows with ``pos``, ``_chunk`` and ``_own``, ready for ``chunk_window`` and ``own_rows``.

    If every key is proven to fit one chunk, one shuffle by key is enough. Only a table with a larger
    key pays for exact positions and halos.
    """
    limit = CHUNK_ROWS if rows is None else rows
    if groups_within(df, keys, limit):
        numbered = df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order))).cast("long"))
        return numbered.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    return halo_chunks(ordered_positions(df, keys, order), halo, limit)


def running_total(positioned: DataFrame, keys: list[str], value: str, out: str, rows: int | None = None, pos: str = "pos") -> DataFrame:
    """Exact running sum of ``value`` along each key: within chunks, plus the totals of earlier chunks."""
    rows = CHUNK_ROWS if rows is None else rows
    chunked = positioned.withColumn("_chunk", F.floor((F.col(pos) - 1) / rows))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), "_total")
    before = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_k_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).filter("_k_chunk > 0")
    condition = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = chunked.withColumn("_inside", inside).join(totals, condition, "left")
    return joined.withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop(
        "_chunk", "_inside", "_total", "_before", "_k_chunk", *[f"_k_{k}" for k in keys])


def chunk_window(keys: list[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def by_key(rows: pd.DataFrame, keys: list[str], order: list[str]) -> tuple[pd.DataFrame, list[int], list]:
    """Rows of several keys by key and order, the position at which each key starts, and each key's values."""
    number = rows.groupby(keys, dropna=False, sort=False).ngroup()
    rows = rows.assign(_number=number).sort_values(["_number", *order], ignore_index=True)
    starts = rows.index[~rows["_number"].duplicated()]
    names = rows.loc[starts, keys[0]].tolist() if len(keys) == 1 else list(rows.loc[starts, keys].itertuples(index=False, name=None))
    return rows.drop(columns="_number"), starts.tolist(), names


def fold_keys(step, many, rows: pd.DataFrame, starts: list[int], before: list[str | None]) -> tuple[pd.DataFrame, list[str]]:
    """Advance the keys of ``rows`` by ``many`` at once, or by ``step`` one after the other."""
    if many is not None:
        return many(rows, starts, before)
    done = [step(rows.iloc[a:b], state) for a, b, state in zip(starts, [*starts[1:], len(rows)], before)]
    return pd.concat([out for out, _ in done], ignore_index=True), [state for _, state in done]


def fold_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str]],
    schema: T.StructType,
    slice_rows: int = CHUNK_ROWS,
    many: Callable[[pd.DataFrame, list[int], list[str | None]], tuple[pd.DataFrame, list[str]]] | None = None,
) -> DataFrame:
    """Run a state machine along each key, for operators whose next state needs the last one.

    Keys advance together in slices of ``slice_rows`` rows, so no task ever holds more of a key than
    one slice; the state of each key travels between slices as a short string. ``step`` takes the
    ordered rows of one slice and the previous state and returns output rows and the new state.

    If no key is longer than a slice, tasks take buckets of whole keys. ``many`` does what ``step`` does for the keys of a
    bucket at once: it gets their rows by key and order, where each key starts, and the states.
    """
    # The state row of a key leaves all other columns null.
    carry = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("_state", T.StringType())])
    names = [f.name for f in schema.fields]
    key_positions = [names.index(k) for k in keys]

    def run(key, rows: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        state = None if before is None or before.empty else before["_state"].iloc[0]
        if rows.empty:
            return pd.DataFrame(columns=names + ["_state"])
        out, after = step(rows.sort_values("pos"), state)
        out = out[names].astype(object)
        out["_state"] = None
        mark = {name: None for name in names}
        for k, i in zip(keys, range(len(key_positions))):
            mark[k] = key[i]
        mark["_state"] = after
        return pd.concat([out, pd.DataFrame([mark], columns=names + ["_state"], dtype=object)], ignore_index=True)

    def first_slice(key, rows):
        return run(key, rows, None)

    if groups_within(df, keys, slice_rows):
        # No key is longer than a slice: one pass, no positions to write down. A call for each of many short keys would
        # cost more than its rows, so keys share buckets of about a quarter of a slice.
        buckets = max(1, -(-4 * df.count() // slice_rows))

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            rows, starts, _ = by_key(rows, keys, order)
            return fold_keys(step, many, rows, starts, [None] * len(starts))[0][names]

        bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        return bucketed.groupBy("_bucket").applyInPandas(whole, schema)
    positioned = cut_lineage(ordered_positions(df, keys, order))
    last = positioned.agg(F.max("pos")).first()[0] or 0
    done: DataFrame | None = None
    state: DataFrame | None = None
    for start in range(0, last, slice_rows):
        part = positioned.filter((F.col("pos") > start) & (F.col("pos") <= start + slice_rows))
        if state is None:
            stepped = part.groupBy(*keys).applyInPandas(first_slice, carry)
        else:
            stepped = part.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(run, carry)
        stepped = cut_lineage(stepped)
        state = stepped.filter(F.col("_state").isNotNull()).select(*keys, "_state")
        rows = stepped.filter(F.col("_state").isNull()).drop("_state")
        done = rows if done is None else done.unionByName(rows)
    return done if done is not None else df.sparkSession.createDataFrame([], schema)
