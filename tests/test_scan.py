"""The scan that ranks tiles of pairs: every metric against pair-by-pair scores, its bounds, its cells."""

import numpy as np
import pytest

from echotrail.operators import kernels as kn, knn as nn


def plain(metric, q, x):
    """Scores of all pairs, one query at a time, on direct differences."""
    if metric == "cosine":
        return kn.cosine_scores(q, x).T
    if metric == "int8":
        return (kn.int8_rows(x) @ kn.int8_rows(q).T).T
    if metric == "hamming":
        return np.array([-np.bitwise_count(x ^ v).sum(axis=1, dtype=np.int64) for v in q], dtype=float)
    if metric == "l2":
        return np.array([-np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9) for v in q])
    u, out = kn.ball_rows(x), []
    for v in kn.ball_rows(q):
        gap, denom = ((u - v) ** 2).sum(axis=1), np.maximum((1 - (u * u).sum(axis=1)) * (1 - (v * v).sum()), 1e-15)
        z = np.maximum(1 + 2 * gap / denom, 1 + 1e-15)
        out.append(-np.round(np.log(z + np.sqrt(z * z - 1)), 9))
    return np.array(out)


def vectors(metric, rng, n):
    if metric == "hamming":
        bits = rng.random((n, 400)) < 0.05
        bits[:, 200:] = False
        return np.packbits(bits, axis=1)
    x = rng.standard_normal((n, 16)) * rng.choice([0.05, 1.0, 30.0], (n, 1))
    return np.rint(x * 3) if metric == "l2" else x


@pytest.mark.parametrize("metric", ["cosine", "hyperbolic", "int8", "hamming", "l2"])
@pytest.mark.parametrize("gate", [None, 0.3])
@pytest.mark.parametrize("tile", [2_000_000, 700])
def test_scan_equals_all_pairs(monkeypatch, metric, gate, tile):
    monkeypatch.setattr(kn, "TILE", tile)
    rng = np.random.default_rng(5)
    x = vectors(metric, rng, 900)
    x[300:420] = x[7]  # more copies than are wanted
    q = np.concatenate([x[[7, 350, 500]], vectors(metric, rng, 40)])
    ids, asked = rng.permutation(900), np.arange(43) + 10_000
    asked[0] = ids[7]
    ex, eq = rng.random(900).round(2), rng.random(43).round(2)
    coded = metric == "hamming"
    at = np.zeros((43, 1)) if coded else q
    block = kn.QueryBlock(asked, at, metric, False, 6, gate, entropies=eq if gate else None, codes=q if coded else None)
    batches = [(ids[s], np.zeros((len(ids[s]), 1)) if coded else x[s], ex[s] if gate else None, None, x[s] if coded else None)
               for s in (slice(0, 5), slice(5, 600), slice(600, 900))]
    query, score, found, _ = block.scan(batches, True).settle()
    all_scores = plain(metric, q, x)
    for i in range(43):
        ok = ids != asked[i]
        if gate:
            ok &= np.round(np.abs(ex - eq[i]), 9) <= gate
        order = [j for j in np.lexsort((ids, -all_scores[i])) if ok[j]][:6]
        assert found[query == i].tolist() == ids[order].tolist()
        assert np.allclose(score[query == i], all_scores[i][order], atol=2e-9, rtol=0)


def test_pairs_are_ranked_by_tiles_not_by_queries(monkeypatch):
    """Before, every query was ranked by itself against every few rows: 2000 x 50 times here."""
    calls = []
    add = kn.TopK.add
    monkeypatch.setattr(kn.TopK, "add", lambda self, *a: (calls.append(1), add(self, *a)))
    x = np.random.default_rng(1).standard_normal((2000, 16))
    kn.QueryBlock(np.arange(2000), x, "cosine", False, 5, None).scan([(np.arange(2000), x, None, None, None)], False)
    assert len(calls) <= 10


def test_a_common_vector_is_scored_for_its_lowest_ids_only(monkeypatch):
    taken = []
    add = kn.TopK.add
    monkeypatch.setattr(kn.TopK, "add", lambda self, q, *a: (taken.append(len(q)), add(self, q, *a)))
    x = np.random.default_rng(2).standard_normal((3000, 16))
    x[:2900] = x[0]
    block = kn.QueryBlock(np.arange(100), x[:100], "cosine", False, 5, None)
    query, _, found, _ = block.scan([(np.arange(3000), x, None, None, None)], False).settle()
    assert found.reshape(100, 5).tolist() == [list(range(5))] * 100
    assert sum(taken) <= 100 * 110


@pytest.mark.parametrize("rows", [102_560, 615_360])
def test_cells_share_the_work_and_are_bounded(rows):
    for keep in (1, 10, 200):
        q, c = nn.cell_shape(rows, rows, 8 * 64, keep)
        assert 100 <= q * c <= 1200
        assert max(rows / q, rows / c) * 8 * 64 <= 1.01 * nn.CELL_BYTES and rows / q * 128 * keep <= 1.01 * nn.STATE_BYTES
        # What is shuffled: every side once per block of the other, and the best pairs of every cell.
        assert rows * (q + c) * 320 + rows * c * keep * 32 < 60e9


@pytest.mark.parametrize("tile", [2_000_000, 700])
def test_nearest_row_of_every_query(monkeypatch, tile):
    """A search of one neighbour scores few pairs exactly, copies and zero vectors included."""
    monkeypatch.setattr(kn, "TILE", tile)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x[500:700] = x[3]
    q = np.concatenate([x[[3, 600, 50]], rng.standard_normal((200, 64)), np.zeros((1, 64))])
    ids, pairs = rng.permutation(3000), []
    block = kn.QueryBlock(np.arange(len(q)), q, "cosine", False, 1, None)
    exact = block.metric.exact
    block.metric.exact = lambda near, rows, queries, at: pairs.append(len(at)) or exact(near, rows, queries, at)
    query, score, found, _ = block.scan([(ids[s], x[s], None, None, None) for s in (slice(0, 7), slice(7, 1500), slice(1500, 3000))], False).settle()
    every = kn.cosine_scores(q, x).T
    best = [np.lexsort((ids, -row))[0] for row in every]
    assert found.tolist() == ids[best].tolist() and np.allclose(score, every[query, best], atol=2e-9)
    assert sum(pairs) < 10 * len(q) + 2 * 3000


@pytest.mark.parametrize("rows", [20_000, 102_560, 615_360])
def test_streams_hold_one_block_and_hand_on_few_pairs(rows):
    for keep, size in ((1, 512), (10, 512), (64, 512), (200, 568)):
        q, s = nn.stream_shape(rows, rows, size, keep, tasks=8)
        assert 8 <= q * s <= 16 + 2 * max(rows * size / nn.CELL_BYTES, rows * 128 * keep / nn.STATE_BYTES)
        assert rows / q * size <= 1.01 * nn.CELL_BYTES and rows / q * 128 * keep <= 1.01 * nn.STATE_BYTES
        # Before, 615,360 queries for 200 rows each left 33 blocks of rows with 4 billion pairs.
        assert rows * (q * size + s * (size + 32 * keep)) < 27e9
    assert nn.stream_shape(20_000, 10_000_000, 512, 10)[0] <= 2  # few queries: the rows travel once or twice
