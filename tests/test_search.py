"""Search against plain numpy, with both plans of the kNN job and forced skew."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrail.operators import codes, fusion, ivf, knn as nn, lexical as lx


def table(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} bigint, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((240, 32))
    x[100:180] = x[100]  # a third of the rows are copies
    q = rng.standard_normal((30, 32))
    q[5] = x[100]
    return x, q, table(spark, x, "doc_id"), table(spark, q, "query_id")


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def brute(x, q, k):
    ux, uq = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    s = np.round(uq @ ux.T, 9)
    return {i: list(np.lexsort((np.arange(len(x)), -s[i]))[:k]) for i in range(len(q))}


@pytest.mark.parametrize("limit", [None, 3000])
def test_exact_both_plans(data, limit):
    x, q, docs, queries = data
    assert ranked(nn.knn(queries, docs, 7, tolerance=None, limit=limit)) == brute(x, q, 7)


def test_gate_applies_before_top_k(data):
    from echotrail.operators.kernels import matrix_entropy

    x, q, docs, queries = data
    ex, eq = matrix_entropy(x), matrix_entropy(q)
    got = ranked(nn.knn(queries, docs, 5, tolerance=0.2))
    full = brute(x, q, len(x))
    for i in range(len(q)):
        want = [d for d in full[i] if abs(ex[d] - eq[i]) <= 0.2][:5]
        assert got.get(i, []) == want


def test_int8_with_all_candidates_is_exact(data):
    x, q, docs, queries = data
    assert ranked(nn.rerank_knn(queries, docs, 6, "int8", 240, tolerance=None)) == brute(x, q, 6)


def test_hamming_against_numpy(data):
    x, q, docs, queries = data
    a, b = codes.fly_codes(x), codes.fly_codes(q)
    d = np.array([[np.unpackbits(np.bitwise_xor(u, v)).sum() for u in a] for v in b])
    want = {i: list(np.lexsort((np.arange(len(x)), d[i]))[:5]) for i in range(len(q))}
    got = codes.hamming_knn(queries, docs, 5, tolerance=None)
    assert ranked(got) == want
    row = got.filter("query_id = 0 AND rank = 1").first()
    assert row["distance"] == d[0].min() and abs(row["score"] - (1 - d[0].min() / 10000)) < 1e-12


def test_fly_codes_shape_and_constants():
    c = codes.fly_codes(np.vstack([np.ones(16), np.arange(16.0)]))
    assert c.shape == (2, 1250) and np.unpackbits(c[0]).sum() == 0 and np.unpackbits(c[1]).sum() == 500


def test_flyhash_with_all_candidates_is_exact(data):
    x, q, docs, queries = data
    assert ranked(codes.flyhash_rerank_knn(queries, docs, 6, candidates=240, tolerance=None)) == brute(x, q, 6)


def test_lattice_decoder_is_nearest():
    rng = np.random.default_rng(3)
    y = rng.standard_normal((40, 24)) * 4
    words = codes.golay_words()
    got = codes.nearest_lattice(y)
    for v, point in zip(y, got):
        best = np.inf
        for odd in (0.0, 1.0):
            p = 4 * np.rint((v - 2 * words - odd) / 4) + 2 * words + odd
            gap = v - p
            off = np.mod(np.rint(p.sum(axis=1)), 8) == (4 if odd == 0 else 0)
            worst, r = np.abs(gap).argmax(axis=1), np.arange(len(p))
            p[r, worst] += np.where(off, np.where(gap[r, worst] >= 0, 4, -4), 0)
            best = min(best, ((v - p) ** 2).sum(axis=1).min())
        assert abs(((v - point) ** 2).sum() - best) < 1e-4
        assert abs(point.sum()) % 4 == 0


def test_lattice_rows_near_a_point_need_no_words(monkeypatch):
    """Before, every row was decoded by all 4096 words, and rows of one code were all scored for every query."""
    rng = np.random.default_rng(4)
    words = codes.golay_words().astype(int)
    points = np.concatenate([4 * rng.integers(-3, 4, (40, 24)), 2 * words[rng.integers(0, 4096, 40)] + 8 * rng.integers(-1, 2, (40, 24))])
    points[:40, 0] += np.where(points[:40].sum(axis=1) % 8, 4, 0)
    y = points + rng.standard_normal(points.shape) * 0.4
    slow = codes._nearest_by_words(y, 16)
    asked = []
    by_words = codes._nearest_by_words
    monkeypatch.setattr(codes, "_nearest_by_words", lambda y, step: (asked.append(len(y)), by_words(y, step))[1])
    assert (codes.nearest_lattice(y) == slow).all() and sum(asked) < 60
    assert words[1:].sum(axis=1).min() == 6


@pytest.mark.parametrize("limit", [None, 3000])
def test_rows_of_one_lattice_code(data, spark, monkeypatch, limit):
    """Small vectors all get the code zero: the lowest ids are the candidates, and few pairs are scored for them."""
    from echotrail.operators import kernels as kn

    x, q, _, _ = data
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    assert len(np.unique(codes.lattice_codes(x), axis=0)) == 1
    left, right = table(spark, q, "query_id"), table(spark, x, "doc_id")
    got = ranked(codes.lattice_coarse_knn(left, right, 3, tolerance=None, limit=limit))
    assert got == brute(x[:9], q, 3)
    coded = codes.lowest_of_code(codes.lattice_index(right), 9)
    assert coded.count() <= 3 * 9 and {r["doc_id"] for r in coded.collect()} >= set(range(9))
    taken = []
    add = kn.TopK.add
    monkeypatch.setattr(kn.TopK, "add", lambda self, q, *a: (taken.append(len(q)), add(self, q, *a)))
    block = kn.QueryBlock(np.arange(30), q, "l2", True, 9, None, codes=np.zeros((30, 24)))
    block.scan([(np.arange(240), x, None, None, np.zeros((240, 24)))], False)
    assert sum(taken) == 30 * 9


@pytest.mark.parametrize("limit", [None, 3000])
def test_ivf_probing_everything_is_exact(data, limit):
    x, q, docs, queries = data
    assigned, centroids = ivf.ivf_build(docs, parts=8)
    assert assigned.count() == len(x)
    all_parts = ivf.ivf_rerank_knn(queries, assigned, centroids, 5, probes=8, tolerance=None)
    assert ranked(all_parts) == brute(x, q, 5)
    some = ranked(ivf.ivf_rerank_knn(queries, assigned, centroids, 5, probes=4, tolerance=None, limit=limit))
    part = {r["doc_id"]: r["part"] for r in assigned.collect()}
    uq = q / np.linalg.norm(q, axis=1, keepdims=True)
    full = brute(x, q, len(x))
    for i in range(len(q)):
        order = np.argsort(np.round(centroids @ uq[i], 9), kind="stable")[::-1][:4]
        want = [d for d in full[i] if part[d] in set(order)][:5]
        assert some.get(i, []) == want


def test_perturbed_is_repeatable_and_bounded(data):
    _, _, _, queries = data
    a = nn.perturbed(queries, 1.0, 3).orderBy("query_id").toPandas()
    b = nn.perturbed(queries, 1.0, 3).orderBy("query_id").toPandas()
    assert all(np.array_equal(u, v) for u, v in zip(a["embedding"], b["embedding"]))
    assert all(np.linalg.norm(v) < 1.0 + 1e-9 for v in a["embedding"])


def test_codebook(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, embedding array<double>")
    vectors = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.7, 0.7]), (3, [0.0, 0.0])], "query_id int, embedding array<double>")
    got = {r["query_id"]: r["label"] for r in nn.codebook_cleanup(vectors, words, 0.8).collect()}
    assert got == {1: "a"}


TEXTS = ["alpha beta beta gamma", "beta delta", "naïve café foo_bar", "", "gamma gamma gamma beta", "ALPHA alpha-beta", "zeta"] + ["beta"] * 5


def test_bm25_against_formula(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(4)
    queries = spark.createDataFrame([(0, "alpha beta beta"), (1, "gamma"), (2, "caf ve foo")], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lx.bm25_scores(docs, queries).collect()}
    toks = {i: [w for w in re.findall(r"\b[a-zA-Z0-9]+\b", t.lower())] for i, t in enumerate(TEXTS) if t}
    n, mean = len(toks), np.mean([len(t) for t in toks.values()])
    want = {}
    for qi, text in ((0, "alpha beta"), (1, "gamma"), (2, "caf ve foo")):
        for w in set(text.split()):
            df = sum(w in t for t in toks.values())
            idf = math.log(max(0.0, (n - df + 0.5) / (df + 0.5)) + 1)
            for i, t in toks.items():
                tf = Counter(t)[w]
                if tf:
                    want[qi, i] = want.get((qi, i), 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_fusion_against_full_ranking(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(400)]
    texts[50:180] = [texts[50]] * 130  # copies tie in both rankings
    x = rng.standard_normal((400, 16))
    x[50:180] = x[50]
    q = rng.standard_normal((8, 16))
    qt = [" ".join(rng.choice(vocabulary, 3)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    vectors = table(spark, x, "doc_id")
    queries = table(spark, q, "query_id").join(spark.createDataFrame(list(enumerate(qt)), "query_id bigint, text string"), "query_id")
    got = ranked(fusion.scoped_fusion_search(queries, docs, vectors, 5))
    order = brute(x, q, 400)
    sets = [set(t.split()) for t in texts]
    df = Counter(w for s in sets for w in s)
    for i in range(8):
        words = set(qt[i].split())
        score = {d: round(sum(math.log(401 / (df[w] + 1)) + 1 for w in words & s), 9) for d, s in enumerate(sets)}
        lexical = sorted((d for d in score if score[d] > 0), key=lambda d: (-score[d], d))
        total = {d: 1 / (60 + r) for r, d in enumerate(order[i], 1)}
        for r, d in enumerate(lexical, 1):
            total[d] += 1 / (60 + r)
        want = sorted(total, key=lambda d: (-round(total[d], 12), d))[:5]
        assert got[i] == want


def test_cache_gate_follows_the_single_best(spark):
    from echotrail.operators.cache import cache_lookup, hopfield_readout

    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 32))
    cache = table(spark, x, "doc_id").withColumn("value", F.reverse("embedding"))
    queries = table(spark, x[:5] + 1e-4, "query_id")
    hits = {r["query_id"]: r["doc_id"] for r in cache_lookup(queries, cache, tolerance=5.0).collect()}
    assert hits == {i: i for i in range(5)}
    near = hopfield_readout(queries, cache, beta=40.0, tolerance=5.0).collect()
    assert all(r["reason"] == "accepted" for r in near)
    flat = hopfield_readout(queries, cache, beta=0.1, tolerance=5.0).collect()
    assert all(r["reason"] == "low_confidence" and r["readout"] is None for r in flat)


def test_holographic_state_is_additive(spark):
    from echotrail.operators import holographic as ho

    x = np.random.default_rng(2).standard_normal((12, 64))
    rows = table(spark, x, "doc_id")
    whole = ho.memory_state(rows, 64)
    parts = ho.memory_state(rows.filter("doc_id < 5"), 64) + ho.memory_state(rows.filter("doc_id >= 5"), 64)
    assert np.allclose(whole, parts)


def test_day_memory_recalls_few_rows(spark):
    import datetime

    from echotrail.operators import holographic as ho

    x = np.random.default_rng(8).standard_normal((6, 128))
    day = [datetime.date(2024, 1, 1 + i // 3) for i in range(6)]
    rows = spark.createDataFrame([(day[i], i, [float(v) for v in x[i]]) for i in range(6)], "day date, doc_id bigint, embedding array<double>")
    memory, placed = ho.compile_days(rows, 128, ["doc_id"])
    got = ho.day_recall(rows.withColumnRenamed("doc_id", "query_id"), memory, placed, 128).collect()
    assert len(got) == 6 and all(r["doc_id"] == r["query_id"] for r in got)


def test_knob_search_promotes_passing_settings(data):
    from echotrail.operators.tuning import ivf_knob_search

    _, _, docs, queries = data
    grid = [{"parts": 8, "probes": 8}, {"parts": 8, "probes": 1}]
    report = ivf_knob_search(queries, [("small", docs.filter("doc_id < 100")), ("all", docs)], grid, 5, 0.99, 1).collect()
    small = {r["setting"]: r for r in report if r["stage"] == "small"}
    assert small[0]["recall_at_k"] == 1.0 and small[0]["promoted"] and small[1]["recall_at_k"] < 0.99 and not small[1]["promoted"]
    assert [r["setting"] for r in report if r["stage"] == "all"] == [0]


def test_refresh_embeds_only_changes(spark):
    from echotrail.operators.embed import embed_corpus, record_pairs, refresh_embeddings
    from echotrail.functions.vectors import hash_embedding

    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    stored = embed_corpus(old).select("doc_id", "embedding", "entropy", "text_digest")
    marked = stored.withColumn("entropy", F.lit(-1.0))
    now = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "doc_id int, text string")
    got = {r["doc_id"]: r["entropy"] for r in refresh_embeddings(now, marked).collect()}
    assert got[1] == -1.0 and got[2] > 0 and got[3] > 0
    pairs = record_pairs(now, hash_embedding, lambda t: F.when(t != "c", hash_embedding(t, 32)))
    assert {r["doc_id"] for r in pairs.collect()} == {1, 2}


def test_vault_rebuild_keeps_ids_and_times(spark, folder):
    from echotrail.functions.vectors import hash_embedding
    from echotrail.sources.vault import Vault

    vault = Vault(spark, f"{folder}/a")
    vault.ingest(spark.createDataFrame([(1, "main", "x", "one", [1.0]), (2, "main", "y", "two", [2.0])],
                                       "pos int, collection string, doc_id string, document string, embedding array<double>"))
    new = vault.rebuild("main", lambda t: hash_embedding(t, 16), f"{folder}/b")
    pick = ["doc_id", "document", "metadata", "created_at"]
    assert new.rows().select(*pick).exceptAll(vault.rows().select(*pick)).count() == 0
    assert all(len(r["embedding"]) == 16 and r["entropy"] > 0 for r in new.rows().collect())


def clustered(spark, n, seed=1):
    """Rows near fifty directions, as embeddings of topics are."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((50, 24))[rng.integers(0, 50, n)] + 0.15 * rng.standard_normal((n, 24))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")


@pytest.mark.parametrize("n", [600, 2400])
def test_stored_ivf_is_exact_and_skips_parts(spark, folder, n):
    x, docs = clustered(spark, n)
    index = ivf.StoredIvf.create(docs.filter("doc_id % 4 > 0"), folder, parts=40, iterations=4)
    index.append(docs.filter("doc_id % 4 = 0"))
    q = x[::37]
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id int, embedding array<double>")
    got = index.search(queries, 5, first=2, tolerance=None)
    assert ranked(got) == brute(x, q, 5)
    assert got.agg(F.avg("parts_read")).first()[0] < 20
    many = index.search(queries, 5, first=2, tolerance=None, limit=4000)
    assert ranked(many) == brute(x, q, 5)
    probes = index.tune(5, 0.95)
    near, exact = ranked(index.search_near(queries, 5, tolerance=None)), brute(x, q, 5)
    assert probes < 20 and sum(len(set(near[i]) & set(exact[i])) for i in range(len(q))) >= 0.9 * 5 * len(q)
