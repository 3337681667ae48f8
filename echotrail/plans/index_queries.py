"""Approximate and associative vector search over the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.operators import cache as ca, codes, holographic as ho, ivf
from echotrail.plans.inputs import kept, table
from echotrail.plans.registry import query
from echotrail.session import spread
from echotrail.plans.search_queries import ENTROPY_SQL, all_vectors, corpus, knn_sql, shown
from echotrail.sources.files import scratch_path

DIM = 64


def wide(spark, sf):
    """Queries and corpus over enough tasks for CPU-heavy encoding."""
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    return e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id")


@query("flyhash_index")
def _fly(spark, sf):
    """Winner codes; the random projection has no SQL form. Shows each code's bit count and digest."""
    coded = codes.flyhash_index(wide(spark, sf)[1])
    return coded.select("doc_id", F.octet_length("code").alias("bytes"), F.sha2("code", 256).alias("digest"))


@query("hamming_knn")
def _hamming(spark, sf):
    return shown(codes.hamming_knn(*wide(spark, sf), 10))


@query("flyhash_rerank_knn")
def _fly_rerank(spark, sf):
    return shown(codes.flyhash_rerank_knn(*wide(spark, sf), 10))


@query("lattice_coarse_knn")
def _lattice(spark, sf):
    return shown(codes.lattice_coarse_knn(*wide(spark, sf), 10))


# One assignment pass from evenly spaced seeds is plain SQL; so is probing with the updated means.
IVF_CTE = f"""{ENTROPY_SQL}, placed AS (SELECT vec_id, embedding::DOUBLE[] AS v, entropy, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings JOIN entropies USING (vec_id)),
   shape AS (SELECT any_value(n) AS n, least(greatest(16, ceil(sqrt(any_value(n)) / 4))::BIGINT, any_value(n)) AS parts FROM placed),
   seeds AS (SELECT j AS part, v FROM shape, range(shape.parts) t(j), placed WHERE pos = floor(j * (shape.n - 1) / (parts - 1)::DOUBLE)::BIGINT),
   scored AS (SELECT p.vec_id, s.part, round(list_cosine_similarity(p.v, s.v), 9) AS score FROM placed p, seeds s),
   assigned AS (SELECT vec_id, part FROM (SELECT vec_id, part, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, part) AS rn FROM scored) WHERE rn = 1)"""


@query("ivf_build", f"WITH {IVF_CTE} SELECT vec_id AS doc_id, part::INT AS part FROM assigned")
def _ivf(spark, sf):
    assigned, _ = ivf.ivf_build(corpus(spark, sf))
    return assigned.select("doc_id", "part")


@query("ivf_rerank_knn", f"""WITH {IVF_CTE},
   units AS (SELECT a.part, p.vec_id, p.v, list_transform(p.v, lambda x: x / sqrt(list_dot_product(p.v, p.v))) AS u, p.entropy FROM assigned a JOIN placed p USING (vec_id)),
   sums AS (SELECT part, i, avg(u[i]) AS m FROM units, range(1, 65) t(i) GROUP BY ALL),
   means AS (SELECT part, list(m ORDER BY i) AS c FROM sums GROUP BY part),
   cents AS (SELECT part, c FROM means UNION ALL SELECT part, v FROM seeds WHERE part NOT IN (SELECT part FROM means)),
   probed AS (SELECT vec_id, part FROM (SELECT p.vec_id, c.part, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_cosine_similarity(p.v, c.c), 9) DESC, c.part DESC) AS rn FROM placed p, cents c) WHERE rn <= 8),
   pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 9) AS score
     FROM probed b JOIN placed q ON q.vec_id = b.vec_id JOIN units d ON d.part = b.part WHERE round(abs(q.entropy - d.entropy), 9) <= 0.5),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
   SELECT query_id, rank, doc_id, round(score, 9) AS score, round(1 - score, 9) AS distance FROM ranked WHERE rank <= 10""")
def _ivf_knn(spark, sf):
    assigned, centroids = ivf.ivf_build(corpus(spark, sf))
    # Probing is forced, since a table of a few thousand rows would be scanned whole.
    return shown(ivf.ivf_rerank_knn(all_vectors(spark, sf), assigned, centroids, 10))


@query("ivf_exact_knn", knn_sql())
def _ivf_exact(spark, sf):
    """Exact neighbours from a stored partitioned index that grew by two writes, parts out of reach left unread."""
    return shown(stored_ivf(spark, sf).search(all_vectors(spark, sf), 10))


@query("ivf_tuned_knn")
def _ivf_tuned(spark, sf):
    """Approximate neighbours from as many parts as a sample of stored rows needed for nine tenths of theirs."""
    return shown(stored_ivf(spark, sf).search_near(all_vectors(spark, sf), 10))


def stored_ivf(spark, sf) -> ivf.StoredIvf:
    vectors = corpus(spark, sf)

    def build():
        index = ivf.StoredIvf.create(vectors.filter("doc_id % 3 > 0"), scratch_path(spark, "ivf"))
        index.append(vectors.filter("doc_id % 3 = 0"))
        index.tune()
        return index

    return kept(spark, sf, ["embeddings"], "ivf", build)


KEYS_SQL = f"""ks AS (SELECT vec_id, list_transform(range({DIM}), lambda j: ('0x' || substr(d, 8*j+3, 2) || substr(d, 8*j+1, 2))::INT / 65535.0::DOUBLE * 2.0 - 1.0) AS k FROM
     (SELECT vec_id, array_to_string(list_transform(range({DIM * 4 // 32 + 1}), lambda i: sha256(unhex(sha256(vec_id::VARCHAR)) || unhex(printf('%08x', i)))), '') AS d FROM embeddings)),
   keyed AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, entropy, list_transform(k, lambda x: x / (sqrt(list_dot_product(k, k)) + 1e-8)) AS k FROM ks JOIN embeddings e USING (vec_id) JOIN entropies USING (vec_id)),
   bound AS (SELECT i, sum(list_sum(list_transform(range({DIM}), lambda j: k[j+1] * v[((i - j + {DIM}) % {DIM}) + 1]))) AS s FROM keyed, range({DIM}) t(i) GROUP BY i),
   state AS (SELECT list(s ORDER BY i) AS s FROM bound),
   recalled AS (SELECT vec_id, entropy, list_transform(range({DIM}), lambda i: list_sum(list_transform(range({DIM}), lambda j: s[((i + j) % {DIM}) + 1] * k[j+1]))) AS r FROM keyed, state)"""


@query("holographic_knn", f"""WITH {ENTROPY_SQL}, {KEYS_SQL},
   pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.v, c.r), 9) AS score FROM keyed q, recalled c WHERE round(abs(q.entropy - c.entropy), 9) <= 0.5),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
   SELECT query_id, rank, doc_id, round(score, 9) AS score, round(1 - score, 9) AS distance FROM ranked WHERE rank <= 10""")
def _holographic(spark, sf):
    return shown(ho.holographic_knn(all_vectors(spark, sf), corpus(spark, sf), 10))


@query("holographic_day_recall")
def _days(spark, sf):
    """Vectors filed under days; each is looked up in its own day's memory. Seeds are ours: rows only."""
    e = table(spark, sf, "embeddings")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("vec_id") / 8).cast("int"))  # eight rows a day
    rows = e.select(day.alias("day"), F.col("vec_id").alias("doc_id"), vx.doubles(F.col("embedding")).alias("embedding"))
    memory, placed = ho.compile_days(rows, DIM, ["doc_id"])
    asked = rows.select(F.col("doc_id").alias("query_id"), "day", "embedding")
    return ho.day_recall(asked, memory, placed, DIM)


LOOKUP_SQL = "list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 4 THEN x * 0.3 ELSE x END)"


def lookups(spark, sf):
    """Every vector with its first coordinates shrunk, as cache queries."""
    e = table(spark, sf, "embeddings")
    changed = F.transform(vx.doubles(F.col("embedding")), lambda x, i: F.when(i < 4, x * 0.3).otherwise(x))
    return e.select(F.col("vec_id").alias("query_id"), changed.alias("embedding"))


def cached(spark, sf):
    return corpus(spark, sf).withColumn("value", F.reverse("embedding"))


CACHE_CTE = f"""changed AS (SELECT vec_id, {LOOKUP_SQL} AS embedding FROM embeddings), {ENTROPY_SQL.replace('entropies AS', 'q_entropies AS', 1).replace('FROM embeddings)', 'FROM changed)')}, {ENTROPY_SQL},
   qs AS (SELECT vec_id AS query_id, embedding AS v, entropy FROM changed JOIN q_entropies USING (vec_id)),
   cs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS value, entropy FROM embeddings JOIN entropies USING (vec_id))"""


@query("cache_lookup", f"""WITH {CACHE_CTE},
   s AS (SELECT query_id, doc_id, round(list_cosine_similarity(qs.v, cs.v), 9) AS score, round(abs(qs.entropy - cs.entropy), 9) AS gap, value FROM qs, cs),
   b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s)
   SELECT query_id, doc_id, round(score, 9) AS score, round(value[1], 6) AS first FROM b WHERE rn = 1 AND score >= 0.95 AND gap <= 0.5""")
def _lookup(spark, sf):
    hits = ca.cache_lookup(lookups(spark, sf), cached(spark, sf))
    return hits.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.round(F.col("value")[0].cast("double"), 6).alias("first"))


@query("hopfield_readout", f"""WITH {CACHE_CTE},
   s AS (SELECT query_id, doc_id, round(list_cosine_similarity(qs.v, cs.v), 9) AS score, value FROM qs, cs WHERE round(abs(qs.entropy - cs.entropy), 9) <= 0.5),
   t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 64),
   w AS (SELECT *, exp(12 * score) / sum(exp(12 * score)) OVER (PARTITION BY query_id) AS weight, count(*) OVER (PARTITION BY query_id) AS k FROM t),
   g AS (SELECT query_id, any_value(k) AS k, max(weight) AS p, CASE WHEN any_value(k) <= 1 THEN 0.0 ELSE -sum(weight * ln(greatest(weight, 1e-12))) / ln(any_value(k)::DOUBLE) END AS er,
     sum(weight * value[1]) AS first, sum(weight * list_sum(value)) AS total FROM w GROUP BY query_id)
   SELECT qs.query_id, CASE WHEN k IS NULL THEN 'no_entropy_compatible_candidates' WHEN p < 0.7 THEN 'low_confidence' WHEN er > 0.65 THEN 'high_entropy' ELSE 'accepted' END AS reason,
     round(p, 6) AS max_probability, round(er, 6) AS entropy_ratio, CASE WHEN p >= 0.7 AND er <= 0.65 THEN round(first, 6) END AS first, CASE WHEN p >= 0.7 AND er <= 0.65 THEN round(total, 6) END AS total
   FROM qs LEFT JOIN g USING (query_id)""")
def _hopfield(spark, sf):
    out = ca.hopfield_readout(lookups(spark, sf), cached(spark, sf), beta=12.0)
    return out.select("query_id", "reason", F.round("max_probability", 6).alias("max_probability"), F.round("entropy_ratio", 6).alias("entropy_ratio"),
                      F.round(F.col("readout")[0], 6).alias("first"), F.round(F.aggregate("readout", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
