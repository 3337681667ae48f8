"""Lexical, vector and fused search. Query tables are whole: all vectors, or all benchmark texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from echotrail.functions import vectors as vx
from echotrail.functions.text import STOP_WORDS
from echotrail.operators import fusion, knn as nn, lexical as lx
from echotrail.operators.events import recent
from echotrail.operators.knn import take_top
from echotrail.operators.term_index import TermIndex, best_of
from echotrail.plans.inputs import ROWS_CTE, kept, table, vault_rows
from echotrail.plans.registry import query
from echotrail.session import cut_lineage, spread
from echotrail.sources.files import scratch_path
from echotrail.sources.vault import Vault

DIM = 64

# --- inputs -------------------------------------------------------------------------------


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def texts(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embedded(df, key: str):
    return df.withColumn("embedding", vx.hash_embedding(F.col("text"), DIM)).select(key, "text", "embedding", *[
        c for c in df.columns if c not in (key, "text", "embedding")])


def text_vectors(df):
    """The stored vector table of a set of texts: embedded once, then searched."""
    return cut_lineage(df.select("doc_id", vx.hash_embedding(F.col("text"), DIM).alias("embedding")))


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def all_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def terms(spark, sf, kind: str) -> TermIndex:
    """The stored inverted index of all documents, built by the first search that asks for it."""
    return kept(spark, sf, ["documents"], f"{kind} terms", lambda: TermIndex.over(docs(spark, sf), kind))


# --- SQL building blocks ------------------------------------------------------------------

TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"
STOP = "['" + "','".join(STOP_WORDS) + "']"
WORDS = rf"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')), lambda w: NOT list_contains({STOP}, w))"


def hash_sql(source: str, key: str, dim: int = DIM) -> str:
    blocks = dim * 4 // 32 + 1
    return f"""SELECT *, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-8)) AS embedding FROM (
      SELECT *, list_transform(range({dim}), lambda j: ('0x' || substr(digits, 8*j+3, 2) || substr(digits, 8*j+1, 2))::INT / 65535.0::DOUBLE * 2.0 - 1.0) AS v FROM (
        SELECT *, array_to_string(list_transform(range({blocks}), lambda i: sha256(unhex(sha256(text)) || unhex(printf('%08x', i)))), '') AS digits FROM {source}))"""


ENTROPY_SQL = """entropies AS (SELECT vec_id, CASE WHEN any_value(abs(hi-lo) <= 1e-5*greatest(abs(lo),abs(hi))) THEN 0.0
    ELSE -sum(c/n*log2(c/n)) END AS entropy FROM (
  SELECT vec_id, lo, hi, n, bin, count(*) AS c FROM (
    SELECT vec_id, lo, hi, n, least(63, floor((x-lo)/(hi-lo)*64)) AS bin FROM (
      SELECT vec_id, list_min(v) AS lo, list_max(v) AS hi, len(v)::DOUBLE AS n, unnest(v) AS x FROM
        (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))) GROUP BY ALL) GROUP BY vec_id)"""


def pairs_sql(score: str, gate: bool, self_pairs: bool = True) -> str:
    return f"""{ENTROPY_SQL}, vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, entropy FROM embeddings JOIN entropies USING (vec_id)),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, {score} AS score FROM vecs q, vecs c
      WHERE {'round(abs(q.entropy - c.entropy), 9) <= 0.5' if gate else 'true'} {'' if self_pairs else 'AND q.vec_id <> c.vec_id'})"""


COSINE = "round(list_cosine_similarity(q.v, c.v), 9)"


def knn_sql(score: str = COSINE, k: int = 10, gate: bool = True, self_pairs: bool = True,
            out: str = "round(score, 9) AS score, round(1 - score, 9) AS distance") -> str:
    return f"""WITH {pairs_sql(score, gate, self_pairs)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
    SELECT query_id, rank, doc_id, {out} FROM ranked WHERE rank <= {k}"""


def shown(df):
    return df.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"), F.round("distance", 9).alias("distance"))


# --- lexical ------------------------------------------------------------------------------


@query("build_postings", f"""SELECT doc_id, term, count(*) AS tf, any_value(n)::INT AS doc_len FROM
   (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {TERMS} AS t FROM
      (SELECT doc_id, CASE WHEN doc_id % 20 = 19 THEN '' ELSE text END AS text FROM documents) WHERE text <> '')) GROUP BY doc_id, term""")
def _postings(spark, sf):
    with_empty = docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 20 == 19, "").otherwise(F.col("text")))
    return lx.build_postings(with_empty)


@query("collection_stats", f"""WITH t AS (SELECT lang, doc_id, {TERMS} AS t FROM documents WHERE text <> ''),
   d AS (SELECT lang, count(*) AS n_terms, max(df) AS max_df FROM (SELECT lang, term, count(*) AS df FROM
      (SELECT lang, unnest(list_distinct(t)) AS term FROM t) GROUP BY ALL) GROUP BY lang)
   SELECT lang, count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len, any_value(n_terms) AS n_terms, any_value(max_df) AS max_df
   FROM t LEFT JOIN d USING (lang) GROUP BY lang""")
def _stats(spark, sf):
    return lx.collection_stats(table(spark, sf, "documents"), "lang").withColumn("avg_len", F.round("avg_len", 6))


BM25_CTE = f"""dt AS (SELECT doc_id, {TERMS} AS t FROM documents WHERE text <> ''),
   tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(n)::DOUBLE AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt) GROUP BY 1, 2),
   tot AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_len FROM dt),
   df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
   qt AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark),
   bm AS (SELECT query_id, doc_id, round(sum(ln(greatest((n_docs-df+0.5)/(df+0.5), 0)+1) * (tf*2.5) / (tf + 1.5*(0.25 + 0.75*(n/mean_len)))), 9) AS score
     FROM qt JOIN tf USING (term) JOIN df USING (term), tot GROUP BY 1, 2),
   bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


@query("bm25_search", f"WITH {BM25_CTE} SELECT query_id, rank, doc_id, round(score, 9) AS score FROM bmr WHERE rank <= 10")
def _bm25(spark, sf):
    hits = lx.bm25_search(terms(spark, sf, "bm25"), texts(spark, sf), 10)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


KEPT = "doc_id % 7 <> 3"


@query("term_index_updates", f"""WITH {BM25_CTE.replace("FROM documents WHERE text <> ''", f"FROM documents WHERE text <> '' AND {KEPT}")}
   SELECT query_id, rank, doc_id, round(score, 9) AS score FROM bmr WHERE rank <= 10""")
def _updates(spark, sf):
    """A stored index that grew by two ingests and lost every seventh document, searched."""
    vault = Vault(spark, scratch_path(spark, "vault"))
    rows = docs(spark, sf).select(F.col("doc_id").alias("pos"), F.lit("main").alias("collection"), F.col("doc_id").cast("string").alias("doc_id"),
                                  F.col("text").alias("document"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    vault.ingest(rows.filter("pos % 2 = 0"))
    vault.terms("main")
    vault.ingest(rows.filter("pos % 2 = 1"))
    vault.forget(rows.filter(f"NOT ({KEPT.replace('doc_id', 'pos')})").select("doc_id"), "main")
    index = vault.terms("main")
    # The vault's ids are texts; ties go by the number.
    hits = take_top(best_of(index.rankings(texts(spark, sf)), 10, ties=True).withColumn("doc_id", F.col("doc_id").cast("long")), 10)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def overlap_cte(where: str) -> str:
    return f"""sd AS (SELECT doc_id, {WORDS} AS t FROM documents WHERE {where}),
   st AS (SELECT doc_id, unnest(t) AS term FROM sd), sn AS (SELECT count(*) AS n FROM sd),
   sdf AS (SELECT term, count(*) AS df FROM st GROUP BY term),
   sq AS (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark),
   ov AS (SELECT query_id, doc_id, round(sum(ln((n+1)/(df+1)::DOUBLE)+1), 9) AS score FROM sq JOIN st USING (term) JOIN sdf USING (term), sn GROUP BY 1, 2),
   ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov WHERE score > 0)"""


SCOPE = ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9", "src10", "src11", "src12"]
SCOPE_SQL = "source IN ('" + "','".join(SCOPE) + "')"


def scoped(spark, sf):
    return spread(table(spark, sf, "documents").filter(F.col("source").isin(SCOPE)).select("doc_id", "text"), "doc_id")


@query("idf_overlap_search", f"WITH {overlap_cte(SCOPE_SQL)} SELECT query_id, rank, doc_id, round(score, 9) AS score FROM ovr WHERE rank <= 10")
def _overlap(spark, sf):
    hits = lx.overlap_search(terms(spark, sf, "overlap"), texts(spark, sf), 10, scope=scoped(spark, sf))
    return hits.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query("keyword_ranking", f"WITH {overlap_cte('true')} SELECT query_id, rank, doc_id, round(score, 9) AS score FROM ovr WHERE rank <= 10")
def _keyword(spark, sf):
    hits = lx.overlap_search(terms(spark, sf, "overlap"), texts(spark, sf), 10)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


# --- vectors ------------------------------------------------------------------------------


@query("embed_corpus", f"""SELECT doc_id, len(embedding)::INT AS dim, round(embedding[1], 6) AS first, round(embedding[{DIM}], 6) AS last,
   round(list_sum(list_transform(embedding, lambda x: x * x)), 6) AS energy, round(list_sum(embedding), 6) AS total
   FROM ({hash_sql('documents', 'doc_id')})""")
def _embed(spark, sf):
    e = embedded(docs(spark, sf), "doc_id")
    v = F.col("embedding")
    return e.select("doc_id", F.size(v).alias("dim"), F.round(v[0], 6).alias("first"), F.round(v[DIM - 1], 6).alias("last"),
                    F.round(vx.dot(v, v), 6).alias("energy"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("vector_entropy", f"WITH {ENTROPY_SQL} SELECT vec_id, round(entropy, 6) AS entropy FROM entropies")
def _entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vx.vector_entropy(F.col("embedding")), 6).alias("entropy"))


@query("entropy_route", f"""WITH {ENTROPY_SQL} SELECT vec_id, CASE WHEN entropy < 1.2 THEN 'local' WHEN entropy < 2.5 THEN 'flash' ELSE 'ultra' END AS default_route,
   CASE WHEN entropy < 4.9 THEN 'local' WHEN entropy < 5.1 THEN 'flash' ELSE 'ultra' END AS route FROM entropies""")
def _route(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("entropy", vx.vector_entropy(F.col("embedding")))
    return e.select("vec_id", vx.entropy_route(F.col("entropy")).alias("default_route"), vx.entropy_route(F.col("entropy"), 4.9, 5.1).alias("route"))


@query("entropy_gate", f"""WITH {ENTROPY_SQL}, centre AS (SELECT avg(entropy) + 0.35 AS mid FROM entropies)
   SELECT vec_id FROM entropies, centre WHERE round(abs(mid - entropy), 9) <= 0.5""")
def _gate(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vx.vector_entropy(F.col("embedding")).alias("entropy"))
    centre = e.agg((F.avg("entropy") + 0.35).alias("mid"))
    gap = F.round(F.abs(F.col("mid") - F.col("entropy")), 9)
    return e.crossJoin(F.broadcast(centre)).filter(gap <= 0.5).select("vec_id")


@query("exact_knn", knn_sql())
def _exact(spark, sf):
    return shown(nn.knn(all_vectors(spark, sf), corpus(spark, sf), 10))


UNIT_BALL = ("list_transform({v}, lambda x: x * least(tanh(sqrt(list_sum(list_transform({v}, lambda y: y*y)))), 1 - 1e-5)"
             " / sqrt(list_sum(list_transform({v}, lambda y: y*y))))")


@query("hyperbolic_knn", f"""WITH ball AS (SELECT vec_id, {UNIT_BALL.format(v='v')} AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
   sized AS (SELECT vec_id, b, list_sum(list_transform(b, lambda x: x*x)) AS s FROM ball),
   zs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, greatest(1 + 1e-15, 1 + 2 * pow(list_distance(q.b, c.b), 2) / greatest((1-q.s)*(1-c.s), 1e-15)) AS z FROM sized q, sized c),
   ds AS (SELECT query_id, doc_id, round(ln(z + sqrt(z*z - 1)), 9) AS distance FROM zs),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM ds)
   SELECT query_id, rank, doc_id, round(1 / (1 + distance), 9) AS score, round(distance, 9) AS distance FROM ranked WHERE rank <= 10""")
def _hyperbolic(spark, sf):
    out = nn.knn(all_vectors(spark, sf), corpus(spark, sf), 10, metric="hyperbolic")
    return out.withColumn("score", F.round("score", 9)).withColumn("distance", F.round("distance", 9))


@query("int8_rerank_knn", f"""WITH {ENTROPY_SQL},
   codes AS (SELECT vec_id, v, entropy, list_transform(v, lambda x: round(x / n * 127)) AS code FROM (
     SELECT vec_id, v, entropy, sqrt(list_sum(list_transform(v, lambda y: y*y))) AS n FROM
       (SELECT vec_id, embedding::DOUBLE[] AS v, entropy FROM embeddings JOIN entropies USING (vec_id)))),
   coarse AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.v, c.v), 9) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.code, c.code) DESC, c.vec_id) AS cr
      FROM codes q, codes c WHERE round(abs(q.entropy - c.entropy), 9) <= 0.5),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM coarse WHERE cr <= 200)
   SELECT query_id, rank, doc_id, round(score, 9) AS score, round(1 - score, 9) AS distance FROM ranked WHERE rank <= 10""")
def _int8(spark, sf):
    return shown(nn.int8_rerank_knn(all_vectors(spark, sf), corpus(spark, sf), 10))


@query("truncated_knn", knn_sql("round(list_cosine_similarity(q.v[1:32], c.v[1:32]), 9)", gate=False))
def _truncated(spark, sf):
    return shown(nn.knn(nn.truncated(all_vectors(spark, sf), 32), nn.truncated(corpus(spark, sf), 32), 10, tolerance=None))


@query("knn_graph", knn_sql(gate=False, self_pairs=False))
def _graph(spark, sf):
    return shown(nn.knn(all_vectors(spark, sf), corpus(spark, sf), 10, tolerance=None, exclude_self=True))


@query("perturbed_knn")
def _perturbed(spark, sf):
    """Search from queries jittered at temperature 0.5; the noise is ours, so there is no SQL twin."""
    return shown(nn.knn(nn.perturbed(all_vectors(spark, sf), 0.5, seed=7), corpus(spark, sf), 10))


def prototypes(spark, sf):
    """Mean vector of each label."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


@query("codebook_cleanup", """WITH means AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM
     (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
   s AS (SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS similarity,
     row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], c), 9) DESC, m.label) AS rn FROM embeddings, means m)
   SELECT vec_id, label, round(similarity, 9) AS similarity FROM s WHERE rn = 1 AND similarity >= 0.3""")
def _codebook(spark, sf):
    words = prototypes(spark, sf).select(F.col("label").alias("doc_id"), "embedding")
    snapped = nn.codebook_cleanup(all_vectors(spark, sf), words, 0.3)
    return snapped.select(F.col("query_id").alias("vec_id"), "label", F.round("similarity", 9).alias("similarity"))


# --- fusion -------------------------------------------------------------------------------


def fusion_cte(where: str) -> str:
    return f"""hd AS (SELECT doc_id, embedding FROM ({hash_sql(f'(SELECT doc_id, text FROM documents WHERE {where})', 'doc_id')})),
   hq AS (SELECT item_id AS query_id, embedding FROM ({hash_sql('benchmark', 'item_id')})),
   dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(hq.embedding, hd.embedding), 9) DESC, doc_id) AS rank FROM hq, hd)"""


@query("rrf_hybrid_search", f"""WITH {BM25_CTE}, {fusion_cte('true')},
   f AS (SELECT query_id, doc_id, d.rank AS dense_rank, b.rank AS lexical_rank,
     round(coalesce(1.0::DOUBLE/(60+d.rank), 0) + coalesce(1.0::DOUBLE/(60+b.rank), 0), 12) AS score
     FROM (SELECT * FROM dr WHERE rank <= 50) d FULL OUTER JOIN bmr b USING (query_id, doc_id)),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
   SELECT query_id, rank, doc_id, round(score, 9) AS score, round(1 - score, 9) AS distance FROM r WHERE rank <= 10""")
def _rrf(spark, sf):
    out = fusion.rrf_hybrid_search(
        embedded(texts(spark, sf), "query_id"), terms(spark, sf, "bm25"), text_vectors(docs(spark, sf)), 10, tolerance=None)
    return out.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"), F.round("distance", 9).alias("distance"))


L6_SQL = f"""WITH {overlap_cte(SCOPE_SQL)}, {fusion_cte(SCOPE_SQL)},
   f AS (SELECT query_id, doc_id, d.rank AS dense_rank, o.rank AS lexical_rank,
     round(1.0::DOUBLE/(60+d.rank) + coalesce(1.0::DOUBLE/(60+o.rank), 0), 12) AS score
     FROM dr d LEFT JOIN ovr o USING (query_id, doc_id)),
   fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


def fused(spark, sf, k=10):
    rows = scoped(spark, sf)
    return fusion.scoped_fusion_search(embedded(texts(spark, sf), "query_id"), terms(spark, sf, "overlap"), text_vectors(rows), k, scope=rows.select("doc_id"))


@query("scoped_fusion_search", f"{L6_SQL} SELECT query_id, rank, doc_id, round(score, 9) AS score, dense_rank, lexical_rank FROM fused WHERE rank <= 10")
def _fused(spark, sf):
    return fused(spark, sf).select(
        "query_id", "rank", "doc_id", F.round("score", 9).alias("score"),
        F.col("dense_rank").cast("bigint").alias("dense_rank"), F.col("lexical_rank").cast("bigint").alias("lexical_rank"))


@query("search_then_filter_kind", f"""{L6_SQL}, kinds AS (SELECT doc_id, lang AS kind FROM documents),
   ok AS (SELECT query_id, rank, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM fused JOIN kinds USING (doc_id)
     WHERE rank <= 10 AND kind = (['en','de','fr','es'])[query_id % 4 + 1])
   SELECT query_id, rank, doc_id, round(score, 9) AS score FROM ok WHERE rn = 1""")
def _kind(spark, sf):
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    hits = fused(spark, sf).withColumn("wanted", F.element_at(langs, F.pmod("query_id", F.lit(4)).cast("int") + 1))
    kinds = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"))
    return fusion.search_then_filter_kind(hits, kinds).withColumn("score", F.round("score", 9))


@query("why", f"""{L6_SQL}, {ROWS_CTE.strip()}
   SELECT query_id, 'match' AS part, rank, doc_id::VARCHAR AS doc_id, round(score, 9) AS score FROM fused WHERE rank <= 5
   UNION ALL SELECT NULL, 'recent', row_number() OVER (ORDER BY created_at DESC, row_id DESC), doc_id, NULL
     FROM (SELECT * FROM vault ORDER BY created_at DESC, row_id DESC LIMIT 5)""")
def _why(spark, sf):
    matches = fused(spark, sf, 5).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("score", F.round("score", 9))
    newest = recent(vault_rows(spark, sf), 5)
    ranked = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("row_id"))))
    return fusion.why(matches, ranked)
