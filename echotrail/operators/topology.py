"""Loops in a key's recent history: one-dimensional persistence of the cosine-distance complex."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators.kernels import unit_rows

MAX_HISTORY, MIN_ROWS, SPAN = 100, 5, 0.3


def cosine_distances(x: np.ndarray) -> np.ndarray:
    d = 1.0 - unit_rows(x) @ unit_rows(x).T
    np.fill_diagonal(d, 0.0)
    return np.round(d, 12)


def loop_intervals(d: np.ndarray) -> list[tuple[float, float, int, int]]:
    """(birth, death, u, v) of every loop, in order of the edge (u, v) that closes it.

    Edges enter by length. One that joins two components closes nothing; any other starts a loop,
    which dies with the triangle whose reduced boundary ends at that edge. Boundaries are kept as
    integers with one bit per edge.
    """
    n = len(d)
    if n < 4:
        return []
    u, v = np.triu_indices(n, 1)
    order = np.lexsort((v, u, d[u, v]))
    u, v = u[order], v[order]
    length = d[u, v]
    place = np.zeros((n, n), dtype=np.int64)
    place[u, v] = place[v, u] = np.arange(len(u))
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    open_loops: dict[int, float] = {}
    for e in range(len(u)):
        a, b = find(int(u[e])), find(int(v[e]))
        if a == b:
            open_loops[e] = np.inf
        else:
            parent[a] = b
    i, j, k = np.array([(a, b, c) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n)]).T
    birth = np.maximum(np.maximum(d[i, j], d[j, k]), d[i, k])
    reduced: dict[int, int] = {}
    waiting = len(open_loops)
    for t in np.lexsort((k, j, i, birth)):
        if waiting == 0:
            break
        column = (1 << int(place[i[t], j[t]])) ^ (1 << int(place[j[t], k[t]])) ^ (1 << int(place[i[t], k[t]]))
        while column:
            pivot = column.bit_length() - 1
            if pivot not in reduced:
                reduced[pivot] = column
                open_loops[pivot] = float(birth[t])
                waiting -= 1
                break
            column ^= reduced[pivot]
    return [(float(length[e]), death, int(u[e]), int(v[e])) for e, death in open_loops.items() if death > length[e]]


def loop_detection(events: DataFrame, key: str, order: list[str], max_history: int = MAX_HISTORY, span: float = SPAN) -> DataFrame:
    """Per key: whether its newest rows run in a loop, and the documents on it, newest first.

    ``events`` has ``doc_id`` and ``embedding``. Only the newest ``max_history`` rows of a key are
    looked at by definition; the rank filter keeps that many per task before the shuffle, so a group
    is bounded however busy its key is.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    recent = events.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= max_history)
    schema = T.StructType([events.schema[key], T.StructField("rows", T.LongType()), T.StructField("is_loop", T.BooleanType()),
                           T.StructField("loop_docs", T.ArrayType(events.schema["doc_id"].dataType))])

    def detect(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        docs: list = []
        if len(rows) >= MIN_ROWS:
            distances = cosine_distances(np.stack([np.asarray(e, float) for e in rows["embedding"]]))
            for birth, death, a, b in loop_intervals(distances):
                if death - birth >= span:
                    docs = list(rows["doc_id"].iloc[min(a, b): max(a, b) + 1])
                    break
        return pd.DataFrame({key: [rows[key].iloc[0]], "rows": [len(rows)], "is_loop": [bool(docs)], "loop_docs": [docs]})

    return recent.select(key, "_rank", "doc_id", "embedding").groupBy(key).applyInPandas(detect, schema)
