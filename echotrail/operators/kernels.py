"""Small numpy helpers that score one Arrow batch; Spark does the partitioning and shuffling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROUND = 9  # scores are compared at this many decimals, so that equal vectors tie exactly


def to_matrix(column) -> np.ndarray:
    """List column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return values.reshape(0, 0)
    if len(values) % n:
        raise ValueError("vectors of one batch must have one dimension")
    return values.reshape(n, len(values) // n)


def to_ids(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def matrix_entropy(x: np.ndarray) -> np.ndarray:
    from echotrail.functions.vectors import entropy_of_rows

    out = np.zeros(len(x))
    for at in range(0, len(x), 8192):  # a count of its bins takes as much room as a row, several times over
        n, d = x[at:at + 8192].shape
        out[at:at + 8192] = entropy_of_rows(x[at:at + 8192].reshape(-1), np.arange(n) * d, np.full(n, d))
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1e-8, norms)


def ball_rows(x: np.ndarray) -> np.ndarray:
    """Map rows into the open unit ball: direction kept, length tanh of the norm below 1 - 1e-5."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    target = np.minimum(np.tanh(norms), 1.0 - 1e-5)
    return np.where(norms > 0, target * x / np.where(norms > 0, norms, 1.0), 0.0)


def int8_rows(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    ok = norms > 1e-8
    return np.rint(np.clip(np.where(ok, x / np.where(ok, norms, 1.0), 0.0), -1.0, 1.0) * 127.0)


def cosine_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(unit_rows(x) @ unit_rows(q).T, ROUND)


def cosines(q: np.ndarray, x: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of chosen pairs of unit rows."""
    out = np.empty(len(queries))
    for at in range(0, len(out), 65536):
        out[at:at + 65536] = np.einsum("ij,ij->i", x[rows[at:at + 65536]], q[queries[at:at + 65536]])
    return np.round(out, ROUND)


# --- metrics ------------------------------------------------------------------------------
#
# A metric scores a tile of queries and rows by one matrix product. The product only has to be near enough to say
# which pairs may matter: ``least`` turns product values or exact scores into the value that a pair must reach, and
# the exact score is taken for pairs that reach it.


class Cosine:
    """Cosine at nine decimals; the product is taken in single precision."""

    def __init__(self, q: np.ndarray):
        self.q = unit_rows(q)
        self.short = self.q.astype(np.float32)
        self.room = (self.q.shape[1] + 8) * 2.0 ** -23

    def rows(self, x: np.ndarray):
        x = unit_rows(x)
        return x, x.astype(np.float32)

    def tile(self, x, queries) -> np.ndarray:
        return self.short[queries] @ x[1].T

    def least(self, score: np.ndarray) -> np.ndarray:
        return score - self.room

    def from_tile(self, near: np.ndarray) -> np.ndarray:
        return near - 2 * self.room

    def exact(self, near: np.ndarray, x, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return cosines(self.q, x[0], queries, rows)


class Int8:
    """Dot product of integer codes; single precision holds these integers exactly."""

    def __init__(self, q: np.ndarray):
        self.q = int8_rows(q).astype(np.float32)

    def rows(self, x: np.ndarray):
        return int8_rows(x).astype(np.float32)

    def tile(self, x, queries) -> np.ndarray:
        return self.q[queries] @ x.T

    def least(self, score: np.ndarray) -> np.ndarray:
        return score

    from_tile = least

    def exact(self, near, x, queries, rows) -> np.ndarray:
        return near.astype(np.float64)


class Hamming:
    """Negative Hamming distance between packed codes (uint8 matrices).

    Bits that are the same in all codes at hand add nothing, and most bits of a sparse code are.
    """

    def __init__(self, q: np.ndarray):
        self.q = q
        self.any = np.bitwise_or.reduce(q, axis=0) if len(q) else None
        self.all = np.bitwise_and.reduce(q, axis=0) if len(q) else None

    def _bits(self, codes: np.ndarray, where) -> np.ndarray:
        octets, bits = where
        return np.unpackbits(codes[:, octets], axis=1)[:, bits].astype(np.float32)

    def rows(self, x: np.ndarray):
        differ = (np.bitwise_or.reduce(x, axis=0) | self.any) & ~(np.bitwise_and.reduce(x, axis=0) & self.all)
        octets = np.flatnonzero(differ)
        where = octets, np.flatnonzero(np.unpackbits(differ[octets]))
        bits = np.concatenate([self._bits(x[i:i + 1024], where) for i in range(0, len(x), 1024)])
        return where, bits, bits.sum(axis=1)

    def tile(self, x, queries) -> np.ndarray:
        where, bits, ones = x
        q = self._bits(self.q[queries], where)
        out = (2.0 * q) @ bits.T  # whole numbers below 2**24
        out -= ones
        out -= q.sum(axis=1)[:, None]
        return out

    def least(self, score: np.ndarray) -> np.ndarray:
        return score

    from_tile = least

    def exact(self, near, x, queries, rows) -> np.ndarray:
        return near.astype(np.float64)


class Euclidean:
    """Negative Euclidean distance between integer codes; squares of integers are exact."""

    def __init__(self, q: np.ndarray):
        self.q = q
        self.size = (q * q).sum(axis=1)
        self.low, self.high = (q.min(axis=0), q.max(axis=0)) if len(q) else (None, None)

    def rows(self, x: np.ndarray):
        size = (x * x).sum(axis=1)
        used = np.flatnonzero(np.minimum(self.low, x.min(axis=0)) != np.maximum(self.high, x.max(axis=0)))
        kind = np.float32 if 4.0 * max(size.max(), self.size.max()) < 2.0 ** 24 else np.float64
        own = x[:, used].astype(kind)
        return used, own, (own * own).sum(axis=1)

    def tile(self, x, queries) -> np.ndarray:
        used, own, size = x
        q = self.q[queries][:, used].astype(own.dtype)
        out = (2 * q) @ own.T
        out -= size
        out -= (q * q).sum(axis=1)[:, None]
        return out

    def least(self, score: np.ndarray) -> np.ndarray:
        return -((10.0 ** -ROUND - score) ** 2)

    def from_tile(self, near: np.ndarray) -> np.ndarray:
        return near

    def exact(self, near, x, queries, rows) -> np.ndarray:
        return -np.round(np.sqrt(np.maximum(-near.astype(np.float64), 0.0)), ROUND)


class Hyperbolic:
    """Negative ball distance. The product forms expanded squares, which lose digits near the rim; ``least`` leaves
    room for that, and scores are taken on direct differences."""

    LOST = 1e-12

    def __init__(self, q: np.ndarray):
        self.v = ball_rows(q)
        self.vv = (self.v * self.v).sum(axis=1)
        b = 1.0 / (1.0 - self.vv)
        self.q = np.concatenate([2.0 * self.v * b[:, None], -b[:, None], -(self.vv * b)[:, None]], axis=1)
        # The largest factor by which lost digits of a row can grow, over all points of the ball.
        self.room = self.LOST / (1.0 - (1.0 - 1e-5) ** 2) * (b.max() if len(b) else 1.0)

    def rows(self, x: np.ndarray):
        u = ball_rows(x)
        uu = (u * u).sum(axis=1)
        a = 1.0 / (1.0 - uu)
        return u, uu, np.concatenate([u * a[:, None], (uu * a)[:, None], a[:, None]], axis=1)

    def tile(self, x, queries) -> np.ndarray:
        return self.q[queries] @ x[2].T

    def least(self, score: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return -(np.cosh(2 * 10.0 ** -ROUND - score) - 1.0) / 2.0 * (1.0 + 1e-12) - self.room

    def from_tile(self, near: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return self.least(-np.arccosh(1.0 + 2.0 * np.maximum(self.room - near, 0.0)))

    def exact(self, near, x, queries, rows) -> np.ndarray:
        out = np.empty(len(queries))
        for start in range(0, len(out), 65536):
            q, r = queries[start:start + 65536], rows[start:start + 65536]
            diff = x[0][r] - self.v[q]
            gap = np.einsum("ij,ij->i", diff, diff)
            denom = np.maximum((1.0 - x[1][r]) * (1.0 - self.vv[q]), 1e-15)
            z = np.maximum(1.0 + 2.0 * gap / denom, 1.0 + 1e-15)
            out[start:start + 65536] = -np.round(np.log(z + np.sqrt(z * z - 1.0)), ROUND)
        return out


METRICS = {"cosine": Cosine, "hyperbolic": Hyperbolic, "int8": Int8, "hamming": Hamming, "l2": Euclidean}
TILE = 2_000_000  # pairs scored at once
GATE_ROOM = 1e-8


class TopK:
    """The best ``k`` (score, id) of each query over the pairs seen so far; ties go to the lower id."""

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor.copy()  # a pair below this is among no query's best
        self.waiting: list[tuple] = []
        self.count = self.settled = 0

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, extra: np.ndarray) -> None:
        if len(queries):
            self.waiting.append((queries, score, ids, extra))
            self.count += len(queries)

    def full(self) -> bool:
        return self.count - self.settled > max(200_000, self.settled)

    def settle(self) -> tuple | None:
        """Keep the best of what was added; returns columns (query, score, id, extra) in order of query and rank."""
        if not self.waiting:
            return None
        query, score, ids, extra = (np.concatenate(c) for c in zip(*self.waiting))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        order, query = order[rank < self.k], query[rank < self.k]
        best = query, score[order], ids[order], extra[order]
        self.waiting, self.count, self.settled = [best], len(query), len(query)
        return best

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries that have ``k`` pairs, and the last of their scores. Call after ``settle``."""
        query, score = self.waiting[0][:2]
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
        held = np.diff(np.append(-1, last)) >= self.k
        return query[last[held]], score[last[held]]


class QueryBlock:
    """Queries held by one task, and the scan that ranks batches of corpus rows against them."""

    def __init__(self, ids, vectors, coarse, rerank, keep, tolerance, probes=None, entropies=None, codes=None, least=None):
        self.ids = ids
        self.metric = METRICS[coarse](vectors if codes is None else codes)
        self.units = unit_rows(vectors) if rerank else None
        self.keep = keep
        self.tolerance = tolerance
        self.floor = None if least is None else self.metric.least(least)  # what a caller knows of each query's last best score
        self.probes = probes  # (parts in order, a query of each), or None if every row meets every query
        self.entropies = (
            entropies if entropies is not None else (matrix_entropy(vectors) if tolerance is not None else None)
        )

    def scan(self, batches, exclude_self: bool):
        """``batches`` yields (ids, vectors, entropies | None, parts | None, codes | None)."""
        best = TopK(len(self.ids), self.keep, self.floor)
        if len(self.ids) == 0:
            return best
        if self.keep == 1 and self.floor is None and not exclude_self and self.tolerance is None and self.probes is None and self.units is None and isinstance(self.metric, Cosine):
            return self._nearest(batches, best)
        for ids, x, entropies, parts, codes in batches:
            if len(ids) == 0:
                continue
            own = True
            if self.tolerance is not None:
                own = entropies is None
                entropies = matrix_entropy(x) if own else entropies
            # Codes and entropies follow from the vector; parts need not, nor entropies that a caller gives.
            same = x
            if codes is not None and self.tolerance is None:
                same = codes  # nothing else decides
            elif codes is not None and codes.dtype == np.uint8:
                same = np.concatenate([x.view(np.uint8).reshape(len(x), -1), codes], axis=1)
            few = lowest_copies(ids, same, self.keep + exclude_self, parts) if own else None
            if few is not None:
                ids, x, entropies, parts, codes = (None if c is None else c[few] for c in (ids, x, entropies, parts, codes))
            for rows, queries in self._meetings(parts, len(ids)):
                self._add(best, ids[rows], x[rows], None if entropies is None else entropies[rows],
                          None if codes is None else codes[rows], queries, exclude_self)
        return best

    def _nearest(self, batches, best):
        """The one best row of every query: of a tile only queries whose largest product may beat what they have are looked at."""
        n = len(self.ids)
        top, found = np.full(n, -np.inf), None
        for ids, x, _, _, _ in batches:
            few = lowest_copies(ids, x, 1)
            if few is not None:
                ids, x = ids[few], x[few]
            if found is None and len(ids):
                found = np.zeros(n, dtype=ids.dtype)
            elif len(ids):
                found = found.astype(np.result_type(found, ids), copy=False)  # texts may be longer than those before
            for at in range(0, len(ids), 8192):
                names, rows = ids[at:at + 8192], self.metric.rows(x[at:at + 8192])
                step = max(1, TILE // len(names))
                for start in range(0, n, step):
                    near = self.metric.tile(rows, slice(start, start + step))
                    most = near.max(axis=1).astype(np.float64)
                    held = top[start:start + step]
                    some = np.flatnonzero(most >= self.metric.least(held))
                    # Rows of one query that may score as much as its largest product does.
                    i, j = np.nonzero(near[some] >= self.metric.from_tile(most[some])[:, None].astype(near.dtype))
                    q = some[i] + start
                    score = self.metric.exact(None, rows, q, j)
                    order = np.lexsort((names[j], -score, q))
                    order = order[np.append(True, np.diff(q[order]) > 0)] if len(order) else order
                    q, score, name = q[order], score[order], names[j[order]]
                    better = (score > top[q]) | ((score == top[q]) & (name < found[q]))
                    top[q[better]], found[q[better]] = score[better], name[better]
        seen = np.flatnonzero(top > -np.inf)
        if len(seen):
            best.add(seen, top[seen], found[seen], top[seen])
        return best

    def _meetings(self, parts, n):
        if self.probes is None:
            pieces = -(-n // 8192)
            for piece in range(pieces):
                yield slice(piece * n // pieces, (piece + 1) * n // pieces), None
            return
        order = np.argsort(parts, kind="stable")
        used, first = np.unique(parts[order], return_index=True)
        for part, start, end in zip(used, first, np.append(first[1:], n)):
            low, high = np.searchsorted(self.probes[0], [part, part + 1])
            if high > low:
                for at in range(start, end, 8192):
                    yield order[at:min(at + 8192, end)], self.probes[1][low:high]

    def _add(self, best, ids, x, entropies, codes, queries, exclude_self):
        rows = self.metric.rows(x if codes is None else codes)
        units = unit_rows(x) if self.units is not None else None
        n = len(ids)
        step = max(1, TILE // n)
        total = len(self.ids) if queries is None else len(queries)
        for start in range(0, total, step):
            chosen = np.arange(start, min(start + step, total)) if queries is None else queries[start:start + step]
            near = self.metric.tile(rows, slice(start, start + step) if queries is None else chosen)
            new = np.flatnonzero(np.isneginf(best.floor[chosen]))
            if len(new) and n > self.keep:
                # The k-th best of the first rows bounds what can matter, here and later.
                head = min(n, max(2048, 32 * self.keep))
                seen = near[new, :head].astype(np.float64)
                seen[~self._allowed(ids[:head], entropies, chosen[new], exclude_self, -GATE_ROOM)] = -np.inf
                kth = np.partition(seen, head - self.keep, axis=1)[:, head - self.keep]
                known = ~np.isneginf(kth)
                best.floor[chosen[new[known]]] = self.metric.from_tile(kth[known])
            reach = near >= best.floor[chosen][:, None].astype(near.dtype, copy=False)
            if np.count_nonzero(reach) > max(16 * self.keep, n // 8) * len(chosen):
                reach &= self._allowed(ids, entropies, chosen, exclude_self, GATE_ROOM)
            i, j = np.divmod(np.flatnonzero(reach), n)
            q = chosen[i]
            ok = np.ones(len(q), dtype=bool)
            if self.tolerance is not None:
                ok &= self._gate(entropies[j], self.entropies[q])
            if exclude_self:
                ok &= ids[j] != self.ids[q]
            i, j, q = i[ok], j[ok], q[ok]
            score = self.metric.exact(near[i, j], rows, q, j)
            extra = score if units is None else cosines(self.units, units, q, j)
            best.add(q, score, ids[j], extra)
            if best.full():
                best.settle()
                full, edge = best.edges()
                best.floor[full] = np.maximum(best.floor[full], self.metric.least(edge))

    def _gate(self, a, b):
        # Entropies are sums of few distinct terms, so gaps of exactly the tolerance are common.
        return np.round(np.abs(a - b), ROUND) <= self.tolerance

    def _allowed(self, ids, entropies, queries, exclude_self, room: float) -> np.ndarray:
        """Pairs of all queries with all rows, the gate wider by ``room``: what is kept here is judged again."""
        ok = np.ones((len(queries), len(ids)), dtype=bool)
        if self.tolerance is not None:
            gap = entropies[None, :len(ids)] - self.entropies[queries][:, None]
            ok = np.abs(gap, out=gap) <= self.tolerance + room
        if exclude_self:
            ok &= ids[None, :] != self.ids[queries][:, None]
        return ok


def lowest_copies(ids: np.ndarray, x: np.ndarray, most: int, parts: np.ndarray | None = None) -> np.ndarray | None:
    """Positions of the ``most`` lowest ids of every distinct row (of one part): copies tie, so no other can be among
    the best. None if nothing is left out."""
    if len(ids) <= most:
        return None
    if parts is not None:
        x = np.concatenate([a.view(np.uint8).reshape(len(x), -1) for a in (np.ascontiguousarray(x), np.ascontiguousarray(parts))], axis=1)
    same = np.ascontiguousarray(x)
    _, group, size = np.unique(same.view(f"V{same.strides[0]}").reshape(-1), return_inverse=True, return_counts=True)
    if size.max() <= most:
        return None
    order = np.lexsort((ids, group))
    rank = np.arange(len(ids)) - (np.cumsum(size) - size)[group[order]]
    return np.sort(order[rank < most])
