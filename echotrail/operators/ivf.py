"""Partitioned approximate search: spherical k-means parts, probing, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.operators.kernels import ROUND, to_matrix, unit_rows
from echotrail.operators.knn import candidate_count, rerank_knn, scan, take_top
from echotrail.operators.ordered import ordered_positions
from echotrail.session import BROADCAST_BYTES, discard, small_side, written

PROBES = 8
CANDIDATE_CAP = 2000


def target_parts(count: int) -> int:
    """Parts of an index of ``count`` rows: a quarter of the root, so that a probe reads an ever smaller share."""
    return 0 if count <= 0 else max(16, math.ceil(math.sqrt(count) / 4.0))


def seed_centroids(corpus: DataFrame, parts: int | None = None) -> np.ndarray:
    """Unit vectors of rows spaced evenly over id order; ``parts`` rows reach the driver."""
    placed = ordered_positions(corpus.select("doc_id", "embedding"), [], ["doc_id"])
    count = placed.count()
    parts = min(parts or target_parts(count), count)
    wanted = np.linspace(0, count - 1, num=parts, dtype=np.int64) + 1
    chosen = corpus.sparkSession.createDataFrame([(int(p),) for p in sorted(set(wanted))], "pos long")
    rows = {r["pos"]: r["embedding"] for r in placed.join(small_side(chosen, 16), "pos").collect()}
    return _unit(np.array([rows[int(p)] for p in wanted], dtype=float))


def _unit(c: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(c, axis=1, keepdims=True)
    return c / np.where(norms == 0, 1.0, norms)


def assign_parts(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``part``: the centroid with the largest dot product, the first of equals.

    Every task holds all centroids; their number grows with the root of the corpus and is checked here.
    """
    if centroids.nbytes > 8 * BROADCAST_BYTES:
        raise ValueError("too many centroids for one task: choose fewer parts")
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(list(corpus.schema.fields) + [T.StructField("part", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = np.round(unit_rows(to_matrix(batch.column("embedding"))) @ shared.value.T, ROUND)
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [pa.array(scores.argmax(axis=1), pa.int32())], names=[*batch.schema.names, "part"])

    return corpus.mapInArrow(run, schema)


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Unit means of the parts. Each task sends one partial sum per part it saw; empty parts stay."""
    dim = centroids.shape[1]
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("i", T.IntegerType()),
                        T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = len(centroids)

    def partial(batches):
        sums, counts = np.zeros((parts, dim)), np.zeros(parts, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                owner = batch.column("part").to_numpy(zero_copy_only=False)
                np.add.at(sums, owner, unit_rows(to_matrix(batch.column("embedding"))))
                counts += np.bincount(owner, minlength=parts)
        used = np.nonzero(counts)[0]
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(used)), pa.int32()),
                 pa.array(sums[used].reshape(-1)), pa.array(np.repeat(counts[used], dim))], names=["part", "i", "s", "n"])

    totals = assigned.select("embedding", "part").mapInArrow(partial, out).groupBy("part", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = centroids.copy()
    for row in totals.collect():  # parts x dim numbers
        means[row["part"], row["i"]] = row["s"] / row["n"]
    return _unit(means)


def ivf_build(corpus: DataFrame, parts: int | None = None, iterations: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Corpus with its ``part`` and the final centroids. As stored labels predate the last centroid
    update in the reference's data, rows keep the part of the last assignment."""
    centroids = seed_centroids(corpus, parts)
    assigned = assign_parts(corpus, centroids)
    for step in range(max(1, iterations)):
        if step:
            assigned = assign_parts(corpus, centroids)
        centroids = _means(assigned, centroids)
    return assigned, centroids


def write_ivf(assigned: DataFrame, path: str) -> None:
    """Store by part, so that a search reads only the probed folders."""
    assigned.write.partitionBy("part").parquet(path)


def probe_lists(queries: DataFrame, centroids: np.ndarray, probes: int = PROBES) -> DataFrame:
    """Add ``probes``: the parts nearest to each query."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(list(queries.schema.fields) + [T.StructField("probes", T.ArrayType(T.IntegerType()))])
    n = min(probes, len(centroids))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = np.round(unit_rows(to_matrix(batch.column("embedding"))) @ shared.value.T, ROUND)
                # Of equal scores the higher part comes first, as in a reversed stable sort.
                order = np.argsort(scores, axis=1, kind="stable")[:, ::-1][:, :n]
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "probes"])

    return queries.mapInArrow(run, schema)


def ivf_rerank_knn(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = PROBES,
                   tolerance: float | None = 0.5, full_scan: bool = False, limit: int | None = None) -> DataFrame:
    """Search the probed parts only, or the whole corpus if the caller says ``full_scan``.

    The filter on probed parts prunes folders of a stored index; inside a task each part meets only
    the queries that probe it.
    """
    candidates = candidate_count(k, 20, 100, CANDIDATE_CAP)
    if full_scan or probes >= len(centroids):
        return rerank_knn(queries, assigned.drop("part"), k, "cosine", candidates, tolerance, limit=limit)
    tagged = probe_lists(queries, centroids, probes)
    wanted = [r["p"] for r in tagged.select(F.explode("probes").alias("p")).distinct().collect()]  # at most as many as there are parts
    return rerank_knn(tagged, assigned.filter(F.col("part").isin(wanted)), k, "cosine", candidates, tolerance,
                      parts=len(centroids), limit=limit)


# Cosines are rounded; a bound this close below a score counts as reaching it.
SLACK = 1e-8


def part_bounds(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``part, n, widest``: rows of each part and the largest angle between one of them and its centroid."""
    shared = assigned.sparkSession.sparkContext.broadcast(centroids)

    def widest(batches):
        n, least = np.zeros(len(shared.value), np.int64), np.ones(len(shared.value))
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part").to_numpy(zero_copy_only=False)
                near = np.einsum("ij,ij->i", unit_rows(to_matrix(batch.column("embedding"))), shared.value[part])
                np.minimum.at(least, part, near)
                n += np.bincount(part, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(np.arccos(np.clip(least[used], -1.0, 1.0)))], names=["part", "n", "widest"])

    partial = assigned.select("embedding", "part").mapInArrow(widest, "part int, n long, widest double")
    return partial.groupBy("part").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"))


class StoredIvf:
    """A partitioned vector table: folders by part, its centroids, and per part how wide it is.

    New vectors join the nearest part; every write adds its own bounds, which readers merge. A search reads first
    the parts nearest to each query. The k-th score found there is one that the k-th best cannot be below, and no
    row of a part can score more than the cosine of the angle between the query and the part's cone. Parts whose
    bound stays below that score are never read, and the result is still exact.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, corpus: DataFrame, path: str, parts: int | None = None, iterations: int = 1) -> StoredIvf:
        """Index of ``corpus(doc_id, embedding)``. Rows lie with the nearest of the final centroids."""
        spark = corpus.sparkSession
        _, centroids = ivf_build(corpus, parts, iterations)
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "part int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index.append(corpus)
        return index

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("part").collect()
        return np.array([r["centroid"] for r in rows], dtype=float)

    def append(self, vectors: DataFrame) -> None:
        """Add rows ``(doc_id, embedding)``; whoever calls says which are new."""
        centroids = self.centroids()
        placed = written(assign_parts(vectors.select("doc_id", "embedding"), centroids))
        part_bounds(placed, centroids).coalesce(1).write.mode("append").parquet(f"{self.path}/bounds")
        placed.repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.path}/vectors")
        discard(placed)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def bounds(self) -> dict[int, tuple[int, float]]:
        """Rows and width of every part; as many entries as there are parts."""
        merged = self.spark.read.parquet(f"{self.path}/bounds").groupBy("part").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"))
        return {r["part"]: (r["n"], r["widest"]) for r in merged.collect()}

    def _probing(self, queries: DataFrame, least: DataFrame | None, first: int) -> DataFrame:
        """Queries with their ``probes``: the ``first`` nearest parts, or with ``least(query_id, least)`` all others whose bound reaches that score."""
        centroids, held = self.centroids(), self.bounds()
        width = np.array([held.get(p, (0, -1.0))[1] for p in range(len(centroids))])
        shared = self.spark.sparkContext.broadcast((centroids, width))
        ahead = least is None
        asked = queries if ahead else queries.join(least, "query_id", "left")
        schema = T.StructType([*asked.schema.fields, T.StructField("probes", T.ArrayType(T.IntegerType()))])

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                centroids, width = shared.value
                near = unit_rows(to_matrix(batch.column("embedding"))) @ centroids.T
                order = np.argsort(-np.where(width >= 0, near, -np.inf), axis=1, kind="stable")[:, :first]
                if ahead:
                    probes = [o[width[o] >= 0].astype(np.int32) for o in order]
                else:
                    angle = np.arccos(np.clip(near, -1.0, 1.0)) - width[None, :]
                    most = np.where(width >= 0, np.cos(np.clip(angle, 0.0, np.pi)), -2.0)
                    floor = batch.column("least").fill_null(-1.0).to_numpy(zero_copy_only=False)
                    reach = most + SLACK >= floor[:, None]
                    np.put_along_axis(reach, order, False, axis=1)
                    probes = [np.flatnonzero(r & (width >= 0)).astype(np.int32) for r in reach]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], names=[f.name for f in schema.fields])

        return asked.mapInArrow(run, schema)

    def _found(self, probing: DataFrame, k: int, tolerance: float | None, limit: int | None) -> DataFrame:
        wanted = [r["p"] for r in probing.select(F.explode("probes").alias("p")).distinct().collect()]  # at most as many as there are parts
        rows = self.vectors().filter(F.col("part").isin(wanted))
        return scan(probing, rows, k, "cosine", False, tolerance, parts=len(self.centroids()), limit=limit)

    def tune(self, k: int = 10, target: float = 0.9, sample: int = 64) -> int:
        """Fewest nearest parts that hold ``target`` of the true neighbours of ``sample`` stored rows; kept for ``search_near``.

        The rows with the least hashes are searched exactly; where their neighbours lie says how far probing has to go.
        """
        rows = self.vectors()
        asked = rows.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("query_id"), "embedding")
        asked = written(asked)
        found = take_top(scan(asked, rows, k, tolerance=None), k).select("query_id", "doc_id")
        held = found.join(rows.select("doc_id", "part"), "doc_id").collect()  # sample x k rows
        centroids = self.centroids()
        table = asked.toArrow()
        near = unit_rows(to_matrix(table.column("embedding"))) @ centroids.T
        place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
        row = {q: i for i, q in enumerate(table.column("query_id").to_pylist())}
        needed = np.sort([place[row[r["query_id"]], r["part"]] + 1 for r in held])
        probes = int(needed[max(0, math.ceil(target * len(needed)) - 1)]) if len(needed) else 1
        self.spark.createDataFrame([(probes, target)], "probes int, target double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tuned")
        return probes

    def search_near(self, queries: DataFrame, k: int = 10, tolerance: float | None = 0.5, limit: int | None = None) -> DataFrame:
        """Approximate ``(query_id, rank, doc_id, score, distance)`` from as many parts as ``tune`` found necessary."""
        probes = self.spark.read.parquet(f"{self.path}/tuned").first()["probes"]
        probing = written(self._probing(queries.select("query_id", "embedding"), None, probes))
        hits = take_top(self._found(probing, k, tolerance, limit), k)
        return hits.select("query_id", "rank", "doc_id", "score", (1.0 - F.col("score")).alias("distance"))

    def search(self, queries: DataFrame, k: int = 10, first: int = PROBES, tolerance: float | None = 0.5, limit: int | None = None) -> DataFrame:
        """Exact ``(query_id, rank, doc_id, score, distance, parts_read)``; ``parts_read`` says what the stop saved."""
        probes = written(self._probing(queries.select("query_id", "embedding"), None, first))
        ahead = written(take_top(self._found(probes, k, tolerance, limit), k))
        # Fewer than k rows give no bound, and everything is read.
        least = ahead.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id", "least")
        rest = written(self._probing(queries.select("query_id", "embedding"), least, first).filter(F.size("probes") > 0))
        later = self._found(rest, k, tolerance, limit) if rest.limit(1).count() else ahead.limit(0)
        both = take_top(ahead.select("query_id", "doc_id", "score").unionByName(later.select("query_id", "doc_id", "score")), k)
        parts = probes.select("query_id", "probes").unionByName(rest.select("query_id", "probes")).groupBy("query_id").agg(F.sum(F.size("probes")).alias("parts_read"))
        return both.join(small_side(parts, 32), "query_id").select(
            "query_id", "rank", "doc_id", "score", (1.0 - F.col("score")).alias("distance"), "parts_read")
