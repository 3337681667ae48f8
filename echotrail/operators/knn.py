"""Batch nearest-neighbour search of a query table over a corpus table.

Two plans, chosen by a size check. When there are few queries, every task scans its part of the corpus
once against the broadcast query matrix and emits at most ``k`` rows per query, so the corpus itself is
never shuffled. Otherwise queries are cut into blocks of bounded size and the corpus streams past each, so
that a task holds one block with its best rows and no more; both sides of a search of an index by parts are
cut into blocks. Either way only top rows are shuffled.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators.kernels import QueryBlock, to_ids, to_matrix
from echotrail.session import BROADCAST_BYTES, fits_broadcast

ENTROPY_TOLERANCE = 0.5
CELL_BYTES = 32 * 1024 * 1024  # vectors of one side of a cell
STATE_BYTES = 256 * 1024 * 1024  # best pairs of a cell, those that wait to be merged included
CELL_PAIRS, MOST_CELLS = 60_000_000, 400  # more cells only where memory asks for them
STREAM_PAIRS, STREAMS_PER_CORE = 15_000_000, 2  # as many streams as share the work, more only where memory asks for them
BROADCAST_ROWS = 16_384  # queries that one task may meet with its whole part of the corpus


def candidate_count(k: int, multiplier: int = 20, least: int = 100, cap: int = 1000) -> int:
    """How many coarse candidates an approximate mode hands to exact reranking; never fewer than ``k``."""
    return max(k, min(max(k * multiplier, least), cap))


def _narrow(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def _codes(table, wanted: bool):
    if not wanted:
        return None
    column = table.column("code")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.stack([np.frombuffer(b, dtype=np.uint8) for b in column.to_pylist()]) if len(column) else np.empty((0, 0), np.uint8)
    return to_matrix(column)


def _block(table, coarse, rerank, keep, tolerance, parts, coded) -> QueryBlock:
    names = table.column_names
    least = table.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy() if "least" in names else None
    probes = None
    if parts:
        lists = table.column("probes").combine_chunks()
        owner, part = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
        order = np.argsort(part, kind="stable")
        probes = part[order], owner[order]
    entropies = np.asarray(table.column("entropy").to_numpy(), dtype=float) if "entropy" in names else None
    return QueryBlock(to_ids(table.column("query_id")), to_matrix(table.column("embedding")), coarse, rerank, keep,
                      tolerance, probes, entropies, _codes(table, coded), least)


def _parts_of(batch, tolerance, parts, coded):
    names = batch.schema.names
    if batch.num_rows == 0:
        return np.empty(0), np.empty((0, 0)), None, None, None
    entropies = None
    if tolerance is not None and "entropy" in names:
        entropies = np.asarray(batch.column("entropy").to_numpy(zero_copy_only=False), dtype=float)
    owner = batch.column("part").to_numpy(zero_copy_only=False) if parts else None
    return to_ids(batch.column("doc_id")), to_matrix(batch.column("embedding")), entropies, owner, _codes(batch, coded)


def _emit(best, query_ids, schema: pa.Schema, final: int | None = None, step: int = 100_000):
    columns = best.settle()
    if final is not None and columns is not None:
        query, _, ids, exact = columns
        order = np.lexsort((ids, -exact, query))
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        columns = tuple(c[order[rank < final]] for c in columns)
    for at in range(0, 0 if columns is None else len(columns[0]), step):
        query, score, ids, exact = (c[at:at + step] for c in columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[query]).cast(schema.field(0).type), pa.array(ids).cast(schema.field(1).type),
             pa.array(score, pa.float64()), pa.array(exact, pa.float64())], schema=schema)


def scan(
    queries: DataFrame,
    corpus: DataFrame,
    keep: int,
    coarse: str = "cosine",
    rerank: bool = False,
    tolerance: float | None = ENTROPY_TOLERANCE,
    exclude_self: bool = False,
    parts: int = 0,
    limit: int | None = None,
    final: int | None = None,
) -> DataFrame:
    """Rows ``(query_id, doc_id, score, exact)``: per task and query the best ``keep`` by ``score``. A caller who takes
    of these the best ``final`` by ``exact`` gets no others from a task that has met the whole corpus.

    ``queries`` has ``query_id, embedding`` (``code``, ``probes``, ``entropy`` where needed) and
    ``corpus`` has ``doc_id, embedding`` (``code``, ``part``, ``entropy``). A query with ``least`` asks
    for no row that scores below it.
    """
    coded = "code" in queries.columns and "code" in corpus.columns
    queries = _narrow(queries, ["query_id", "embedding", "entropy", "least"] + (["code"] if coded else []) + (["probes"] if parts else []))
    corpus = _narrow(corpus, ["doc_id", "embedding", "entropy"] + (["code"] if coded else []) + (["part"] if parts else []))
    spark = corpus.sparkSession
    code_bytes = F.lit(0)
    if coded:
        code_bytes = F.octet_length("code") if isinstance(queries.schema["code"].dataType, T.BinaryType) else 8 * F.size("code")
    head = queries.select((8 * F.size("embedding") + code_bytes).alias("n")).first()
    vector_bytes = max(1, head[0]) if head is not None else 1
    row_bytes = vector_bytes + 24 * keep
    limit = BROADCAST_BYTES if limit is None else limit
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", corpus.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("exact", T.DoubleType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    if fits_broadcast(queries, max(row_bytes, BROADCAST_BYTES // BROADCAST_ROWS), limit):
        table = queries.toArrow()
        if table.num_rows == 0:
            return spark.createDataFrame([], out)
        shared = spark.sparkContext.broadcast(_block(table, coarse, rerank, keep, tolerance, parts, coded))

        def per_task(batches):
            block = shared.value
            best = block.scan((_parts_of(b, tolerance, parts, coded) for b in batches), exclude_self)
            yield from _emit(best, block.ids, arrow)

        return corpus.mapInArrow(per_task, out)

    if not parts:
        q_blocks, streams = stream_shape(queries.count(), corpus.count(), vector_bytes, keep, limit, spark.sparkContext.defaultParallelism)

        def per_block(table: pa.Table, batches):
            block = _block(table, coarse, rerank, keep, tolerance, parts, coded)
            best = block.scan((_parts_of(b, tolerance, parts, coded) for b in batches), exclude_self)
            yield from _emit(best, block.ids, arrow, final if streams == 1 else None)

        return streamed(queries, corpus, q_blocks, streams, per_block, out)

    def per_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow.empty_table()
        right = right.rename_columns([c.removeprefix("row_") for c in right.column_names])
        block = _block(left, coarse, rerank, keep, tolerance, parts, coded)
        best = block.scan((_parts_of(b, tolerance, parts, coded) for b in right.combine_chunks().to_batches()), exclude_self)
        batches = list(_emit(best, block.ids, arrow))
        return pa.Table.from_batches(batches, arrow) if batches else arrow.empty_table()

    left, right, cells = _cells(queries, corpus, vector_bytes, keep, limit, parts)
    # Columns of its own: a table that is searched against itself would have the same ones on both sides.
    right = right.select("_cell", *[F.col(c).alias(f"row_{c}") for c in right.columns if c != "_cell"])
    left, right = left.repartition(cells, "_cell"), right.repartition(cells, "_cell")
    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(per_cell, out)


def stream_shape(queries: int, rows: int, vector_bytes: int, keep: int, limit: int = BROADCAST_BYTES, tasks: int = 8) -> tuple[int, int]:
    """Blocks of queries and streams of rows past each: no block larger than a task can hold, enough streams to share the
    work, and as few copies of rows and best pairs to shuffle as that allows."""
    least = max(1, math.ceil(queries * vector_bytes / min(CELL_BYTES, limit)),
                math.ceil(queries * 128 * keep / (STATE_BYTES if limit >= BROADCAST_BYTES else 4 * limit)))
    wanted = min(STREAMS_PER_CORE * tasks, max(1, math.ceil(queries * rows / STREAM_PAIRS)))
    shapes = [(max(least, math.ceil(wanted / r)), r) for r in range(1, wanted + 1)]
    q, r = min(shapes, key=lambda s: s[0] * rows * vector_bytes + s[1] * queries * (vector_bytes + 32 * keep))
    return min(q, max(1, queries)), min(r, max(1, rows))


def streamed(queries: DataFrame, corpus: DataFrame, q_blocks: int, streams: int, run, out: T.StructType) -> DataFrame:
    """``run(block of queries, batches of rows)`` in a task for every block and stream: rows of ``corpus(doc_id, ...)`` come
    batch by batch, and are never held together."""
    left = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))))
    right = corpus.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(streams))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    block = (F.col("_q") * F.lit(streams) + F.col("_s")).alias("_block")
    return by_block(left.select(block, *queries.columns), right.select(block, *corpus.columns), q_blocks * streams, run, out)


def by_block(held: DataFrame, met: DataFrame, blocks: int, run, out: T.StructType) -> DataFrame:
    """``run(rows of held, batches of met)`` for every ``_block`` of ``held``; those of ``met`` may be none."""
    asked, stored = [c for c in held.columns if c != "_block"], [c for c in met.columns if c != "_block"]
    # Even places are held, so that they come first where rows are sorted by place.
    left = held.select((2 * F.col("_block")).cast("int").alias("_place"), *asked)
    right = met.select((2 * F.col("_block") + 1).cast("int").alias("_place"), *[F.col(c).alias(f"row_{c}") for c in stored])
    both = left.unionByName(right, allowMissingColumns=True)
    dealt = both.repartitionById(blocks, F.shiftright("_place", 1)).sortWithinPartitions("_place")

    def runs(batches):
        for batch in batches:
            place = batch.column("_place").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else place
            for start, end in zip(first, np.append(first[1:], len(place))):
                at, part = int(place[start]), batch.slice(start, end - start)
                if at % 2:
                    yield at // 2, True, part.select([f"row_{c}" for c in stored]).rename_columns(stored)
                else:
                    yield at // 2, False, part.select(asked)

    def per_task(batches):
        for _, mine in itertools.groupby(runs(batches), key=lambda run: run[0]):
            parts, first = [], []
            for _, is_row, part in mine:
                if is_row:
                    first = [part]
                    break
                parts.append(part)
            if parts:
                yield from run(pa.Table.from_batches(parts).combine_chunks(), itertools.chain(first, (part for _, _, part in mine)))

    return dealt.mapInArrow(per_task, out)


def cell_shape(queries: int, rows: int, vector_bytes: int, keep: int, limit: int = BROADCAST_BYTES, pairs: int | None = None) -> tuple[int, int]:
    """Blocks of queries and of rows: enough cells to share the work, as few copies and best pairs to shuffle as that
    allows, and no block larger than a task can hold. ``pairs`` says how many of all pairs have to be scored."""
    cells = min(MOST_CELLS, max(1, math.ceil((queries * rows if pairs is None else pairs) / CELL_PAIRS)))
    # A query travels once per block of rows, with its best pairs on the way back; a row once per block of queries.
    ratio = max(1, queries) * (vector_bytes + 32 * keep) / (max(1, rows) * vector_bytes)
    r_blocks = max(1, round(math.sqrt(cells / ratio)))
    r_blocks = max(r_blocks, math.ceil(rows * vector_bytes / min(CELL_BYTES, limit)))
    q_blocks = max(1, math.ceil(cells / r_blocks), math.ceil(queries * vector_bytes / min(CELL_BYTES, limit)),
                   math.ceil(queries * 128 * keep / (STATE_BYTES if limit >= BROADCAST_BYTES else 4 * limit)))
    return min(q_blocks, max(1, queries)), min(r_blocks, max(1, rows))


def part_groups(rows: list[int], asked: list[int], blocks: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index parts dealt into groups of whole parts, or a large part into several groups: per part its first group
    and how many it has (0 if no pair is scored there).

    A group holds about the ``blocks``-th share of the pairs and of the rows, and no more than ``most`` rows.
    """
    used = [i for i, (n, a) in enumerate(zip(rows, asked)) if n and a]
    work = sum(rows[i] * asked[i] for i in used)
    size = min(most, max(1, math.ceil(sum(rows[i] for i in used) / blocks)))
    share = max(1, math.ceil(work / blocks))
    first, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    group, held, done = -1, 0, 0
    for i in used:
        pieces = min(rows[i], max(math.ceil(rows[i] / size), math.ceil(rows[i] * asked[i] / share)))
        if pieces > 1 or group < 0 or held + rows[i] > size or done + rows[i] * asked[i] > share:
            group, held, done = group + 1, 0, 0
        first[i], count[i] = group, pieces
        if pieces > 1:
            group, held, done = group + pieces - 1, size, share
        else:
            held, done = held + rows[i], done + rows[i] * asked[i]
    return first, count


def _by_group(queries: DataFrame, first: np.ndarray, count: np.ndarray) -> DataFrame:
    """A copy of each query per group ``_c`` that holds a part it probes, with those of its ``probes`` that lie there."""
    schema = T.StructType([*queries.schema.fields, T.StructField("_c", T.LongType())])
    at = queries.columns.index("probes")

    def deal(batches):
        for batch in batches:
            lists = batch.column(at)
            owner, part = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            n = count[part]
            owner, part, start = np.repeat(owner, n), np.repeat(part, n), np.repeat(first[part], n)
            group = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((part, group, owner))
            owner, group, part = owner[order], group[order], part[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
            columns = batch.take(pa.array(owner[new])).columns
            offsets = pa.array(np.append(new, len(part)), pa.int32())
            columns[at] = pa.ListArray.from_arrays(offsets, pa.array(part, pa.int32())).cast(lists.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(group[new])], names=schema.names)

    return queries.mapInArrow(deal, schema)


def _cells(queries: DataFrame, corpus: DataFrame, vector_bytes: int, keep: int, limit: int, parts: int) -> tuple[DataFrame, DataFrame, int]:
    """Tag both sides with the cells in which they must meet, and say into how many tasks the cells are dealt.

    Rows of an index lie in blocks by part, and a query travels once to each block with parts that it probes, not once
    per part.
    """
    n_queries = queries.count()
    counts = {r["part"]: r["count"] for r in corpus.groupBy("part").count().collect()}  # at most `parts` rows
    asked = {r["part"]: r["count"] for r in queries.select(F.explode("probes").alias("part")).groupBy("part").count().collect()}
    n_rows = [counts.get(p, 0) for p in range(parts)]
    n_asked = [asked.get(p, 0) for p in range(parts)]
    pairs = sum(n * a for n, a in zip(n_rows, n_asked))
    q_blocks, blocks = cell_shape(n_queries, sum(n_rows), vector_bytes, keep, limit, pairs)
    first, count = part_groups(n_rows, n_asked, blocks, max(1, min(CELL_BYTES, limit) // vector_bytes))
    c_blocks = int((first + count).max(initial=1))
    left = _by_group(queries, first, count)
    rows = [(p, int(first[p]), int(count[p])) for p in range(parts) if count[p]]
    table = F.broadcast(queries.sparkSession.createDataFrame(rows, "part int, _first long, _n long"))
    right = corpus.join(table, "part").withColumn("_c", F.col("_first") + F.pmod(F.xxhash64("doc_id"), F.col("_n"))).drop("_first", "_n")
    left = left.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
    right = right.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    tag, cells = (F.col("_q") * F.lit(c_blocks) + F.col("_c")).cast("long"), q_blocks * c_blocks
    return left.withColumn("_cell", tag).drop("_q", "_c"), right.withColumn("_cell", tag).drop("_q", "_c"), max(1, min(2000, cells))


def take_top(rows: DataFrame, k: int, by: str = "score", rank: str = "rank") -> DataFrame:
    """Best ``k`` per query by ``by`` then id; the limit is applied in each task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), F.asc("doc_id"))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine",
        tolerance: float | None = ENTROPY_TOLERANCE, exclude_self: bool = False, limit: int | None = None) -> DataFrame:
    """Exact search: ``(query_id, rank, doc_id, score, distance)``.

    Cosine gates rows by entropy distance first; the hyperbolic metric has no gate and scores
    ``1 / (1 + distance)``.
    """
    if metric == "hyperbolic":
        tolerance = None
    top = take_top(scan(queries, corpus, k, metric, False, tolerance, exclude_self, limit=limit), k)
    if metric == "hyperbolic":
        distance: Column = -F.col("score")
        score: Column = 1.0 / (1.0 + distance)
    elif metric == "hamming":
        distance = -F.col("score")
        score = 1.0 - distance / 10000.0
    else:
        distance = 1.0 - F.col("score")
        score = F.col("score")
    return top.select("query_id", "rank", "doc_id", score.alias("score"), distance.alias("distance"))


def rerank_knn(queries: DataFrame, corpus: DataFrame, k: int, coarse: str, candidates: int,
               tolerance: float | None = ENTROPY_TOLERANCE, parts: int = 0, limit: int | None = None) -> DataFrame:
    """Coarse candidates, then exact cosine. Tasks carry both scores, so vectors are read only once.

    Where the coarse score is the cosine itself, the best ``k`` candidates are the result.
    """
    if coarse == "cosine":
        top = take_top(scan(queries, corpus, k, coarse, False, tolerance, parts=parts, limit=limit), k)
        return top.select("query_id", "rank", "doc_id", "score", (1.0 - F.col("score")).alias("distance"))
    rows = scan(queries, corpus, candidates, coarse, True, tolerance, parts=parts, limit=limit, final=k)
    chosen = take_top(rows, candidates, "score", "coarse_rank")
    return take_top(chosen, k, "exact").select(
        "query_id", "rank", "doc_id", F.col("exact").alias("score"), (1.0 - F.col("exact")).alias("distance"))


def int8_rerank_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, **options) -> DataFrame:
    return rerank_knn(queries, corpus, k, "int8", candidate_count(k), **options)


def truncated(df: DataFrame, dim: int) -> DataFrame:
    """Keep the leading ``dim`` coordinates of each vector."""
    return df.withColumn("embedding", F.slice("embedding", 1, dim))


def perturbed(queries: DataFrame, temperature: float, seed: int = 0) -> DataFrame:
    """Add Gaussian noise of scale ``0.05 * temperature``; one fixed draw per (seed, query id).

    A perturbed vector whose norm reaches 1 is scaled back inside the unit ball.
    """
    schema = queries.schema

    def noisy(batches):
        for batch in batches:
            x = to_matrix(batch.column("embedding"))
            ids = batch.column("query_id").to_pylist()
            noise = np.stack([np.random.default_rng([seed, *str(i).encode()]).standard_normal(x.shape[1]) for i in ids]) if ids else x
            y = x + noise * (0.05 * temperature)
            size = np.linalg.norm(y, axis=1, keepdims=True) if ids else np.ones((0, 1))
            y = np.where(size >= 1.0, y / (size + 1e-5), y)
            position = batch.schema.get_field_index("embedding")
            kind = batch.schema.field(position).type
            values = pa.array(list(y), type=kind)
            yield batch.set_column(position, batch.schema.field(position), values)

    return queries.mapInArrow(noisy, schema)


def codebook_cleanup(vectors: DataFrame, codebook: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Snap each ``(query_id, embedding)`` to the nearest ``(doc_id, embedding)`` codeword if near enough.

    The many vectors are the side that is scanned; the codebook is the side that is broadcast.
    """
    as_queries = codebook.select(F.col("doc_id").alias("query_id"), "embedding")
    as_corpus = vectors.select(F.col("query_id").alias("doc_id"), "embedding").filter(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 1e-16)
    return nearest_codeword(as_queries, as_corpus).filter(F.col("similarity") >= min_similarity)


def nearest_codeword(codebook: DataFrame, vectors: DataFrame) -> DataFrame:
    """For every row of ``vectors`` its best codeword, without a shuffle of the vectors."""
    spark = vectors.sparkSession
    row_bytes = 8 * 4096
    if not fits_broadcast(codebook, row_bytes):
        swapped = take_top(scan(vectors.select(F.col("doc_id").alias("query_id"), "embedding"),
                                codebook.select(F.col("query_id").alias("doc_id"), "embedding"), 1, tolerance=None), 1)
        return swapped.select("query_id", F.col("doc_id").alias("label"), F.col("score").alias("similarity"))
    table = codebook.toArrow()
    labels, words = to_ids(table.column("query_id")), to_matrix(table.column("embedding"))
    order = np.argsort(labels, kind="stable")
    shared = spark.sparkContext.broadcast((labels[order], words[order]))
    out = T.StructType([
        T.StructField("query_id", vectors.schema["doc_id"].dataType),
        T.StructField("label", codebook.schema["query_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def snap(batches):
        from echotrail.operators.kernels import cosine_scores

        names, codewords = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = cosine_scores(codewords, to_matrix(batch.column("embedding")))
            best = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(arrow.field(0).type), pa.array(names[best]).cast(arrow.field(1).type),
                 pa.array(scores[np.arange(len(best)), best])], schema=arrow)

    return vectors.select("doc_id", "embedding").mapInArrow(snap, out)
