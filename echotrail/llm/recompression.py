"""Removal of long word passages that an earlier document has too, found by recompression.

The words of each text are renamed in rounds. A round first names runs of one symbol, then pairs: a
hash splits all symbols into left and right ones, and a left symbol followed by a right one becomes a
new symbol. Names are hashes of their parts, hence the same in all tasks without any exchange, and
whether symbols merge depends on them and their neighbours only. So equal passages get equal symbols
but for a few at their ends. For each symbol the span of words that decides it is tracked; where that
span lies inside a window of words, every copy of the window holds the same symbol.

Each window is represented by one of the symbols decided inside it, the one of the highest round.
Spark counts these symbols by document; a window can only repeat if its symbol is shared. The windows
left over, about as many as there are true copies, are then grouped by a 128-bit name and decided.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of
from echotrail.llm.grams import Words, batches_by_size, mix
from echotrail.session import cut_lineage, discard, fits_broadcast, small_side, written

WINDOW = 13
ROUNDS = 2
# Half the places in a batch are far outside any window.
FAR = 1 << 40
_K = np.uint64(0x9E3779B97F4A7C15)


def _round(names, doc, gs, ge, nth):
    """One round of runs, then pairs. Arrays of symbols: name, text, first and last deciding word."""
    n = len(names)
    if not n:
        return names, doc, gs, ge
    # Runs: maximal stretches of one symbol; both neighbours are needed to know that they end.
    begins = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.concatenate([begins[1:], [n]]) - 1
    left_in = np.concatenate([[False], doc[begins[1:]] == doc[begins[1:] - 1]])
    right_in = np.concatenate([doc[ends[:-1]] == doc[ends[:-1] + 1], [False]])
    run_gs = np.where(left_in, gs[np.maximum(begins - 1, 0)], -FAR)
    run_ge = np.where(right_in, ge[np.minimum(ends + 1, n - 1)], FAR)
    length = (ends - begins + 1).astype(np.uint64)
    names = np.where(length > 1, mix(names[begins] ^ (length * _K) ^ np.uint64(nth)), names[begins])
    doc, gs, ge = doc[begins], run_gs, run_ge
    # Pairs: left symbol, right symbol, of one text.
    n = len(names)
    right = (mix(names + np.uint64(977 * nth + 13)) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    second = np.concatenate([[False], joins[:-1]])
    # A lone left symbol depends on its right neighbour, a lone right one on its left neighbour.
    has_next = np.concatenate([doc[:-1] == doc[1:], [False]])
    has_last = np.concatenate([[False], doc[:-1] == doc[1:]])
    next_ge = np.where(has_next, np.concatenate([ge[1:], [FAR]]), FAR)
    last_gs = np.where(has_last, np.concatenate([[-FAR], gs[:-1]]), -FAR)
    new_gs = np.where(right & ~second, np.minimum(gs, last_gs), gs)
    new_ge = np.where(~right, np.maximum(ge, next_ge), ge)
    following = np.concatenate([names[1:], [np.uint64(0)]])
    names = np.where(joins, mix(names * _K ^ mix(following + np.uint64(nth))), names)
    keep = ~second
    return names[keep], doc[keep], new_gs[keep], new_ge[keep]


def anchors(words: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol that stands for each window: its 64-bit name, the text it is in, the first word of the window.

    Windows in which no symbol is decided stand for themselves.
    """
    counts = np.maximum(np.diff(words.first) - window + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc_of = np.repeat(np.arange(words.count), counts)
    starts = words.first[:-1][doc_of] + np.arange(first[-1]) - first[:-1][doc_of]
    n_words = len(words.names)
    best = np.zeros(n_words + window, np.uint64)
    # Prefix sums name the words of a deciding span, which makes a symbol's name as telling as its context.
    powers, inverse = _powers(n_words)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.names + np.uint64(5)) * powers)])
    levels = [(words.names, np.repeat(np.arange(words.count), np.diff(words.first)), np.arange(n_words), np.arange(n_words))]
    for nth in range(1, rounds + 1):
        levels.append(_round(*levels[-1], nth))
    for nth in range(rounds, 0, -1):
        names, doc, gs, ge = levels[nth]
        usable = (gs >= 0) & (ge < n_words) & (ge - gs < window)
        if nth < rounds:
            # Lower rounds matter only where no higher one is decided.
            open_ = np.zeros(n_words + 1, np.int64)
            open_[1:][starts] = best[starts] == 0
            open_ = np.cumsum(open_)
            usable &= open_[np.clip(gs, 0, n_words - 1) + 1] > open_[np.clip(ge - window + 1, 0, n_words)]
        a, b, s, d = gs[usable], ge[usable], names[usable], doc[usable]
        value = mix((prefix[b + 1] - prefix[a]) * inverse[a] ^ mix(s + np.uint64(nth))) >> np.uint64(3) | np.uint64(nth) << np.uint64(61)
        # Of symbols that fall on one window the greatest must be written last.
        order = np.argsort(value)
        a, b, d, value = a[order], b[order], d[order], value[order]
        at = a
        while len(at):
            # A symbol decided by the words a to b lies inside the windows that begin from b - window + 1 to a.
            best[at] = np.maximum(best[at], value)
            more = (at > b - window + 1) & (at > words.first[d])
            at, b, d, value = at[more] - 1, b[more], d[more], value[more]
    found = best[starts]
    alone = found == 0
    if alone.any():
        found[alone] = words.window_at(starts[alone], window, seed=1) >> np.uint64(3)
    return found, doc_of, starts


_STEP = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number modulo 2 ** 64, and their inverses."""
    steps = [np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), x, np.uint64)])[:n] for x in (_STEP, pow(_STEP, -1, 2**64))]
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def pair_names(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit names of the windows at ``starts``, two 64-bit lanes each."""
    return np.stack([words.window_at(starts, window, seed=2), words.window_at(starts, window, seed=3)], axis=1)


SAMPLE_DOCS = 4096
HOT_HITS = 8
HOT_NAMES = 2_000_000
# Bytes of text whose names one bucket and one task take.
BUCKET_BYTES, TASK_BYTES = 4 * 1024 * 1024, 8 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


def _texts(batch) -> list[tuple[int, bytes]]:
    return [(i, t.as_py().encode()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]


def _unique(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name once per text; names have one or two lanes."""
    keys = [doc] + [names[:, i] for i in range(names.shape[1])][::-1]
    order = np.lexsort(keys)
    n, d = names[order], doc[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (n[1:] != n[:-1]).any(axis=1)]) if len(d) else np.zeros(0, bool)
    return n[new], d[new]


class Known:
    """A small set of names to look up: sorted first lanes, with the second lane checked as well."""

    def __init__(self, names: np.ndarray):
        self.names = names[np.argsort(names[:, 0])] if len(names) else names.reshape(0, 2)
        self.lane = np.ascontiguousarray(self.names[:, 0])

    def place(self, names: np.ndarray) -> np.ndarray:
        """Index of each name, or -1. First lanes of the set are distinct (see ``hot_names``)."""
        if not len(self.lane) or not len(names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.lane, names[:, 0]), len(self.lane) - 1)
        return np.where((self.names[at] == names).all(axis=1), at, -1)


def _blobs(names: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int):
    """Rows ``bucket, names, docs, ids``: the names of each bucket, and which of ``ids`` each belongs to."""
    bucket = (names[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        used, where = np.unique(doc[part], return_inverse=True)
        yield int(bucket[part[0]]), names[part].tobytes(), where.astype("<u4").tobytes(), ids[used].astype("<i8").tobytes()


_BLOB = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())])
_BLOB_SQL = "bucket long, kind int, names binary, docs binary, ids binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _gathered(frame: pd.DataFrame, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """All names of some blobs and the document id of each, sorted by name, then id."""
    names = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["names"]]).reshape(-1, lanes)
    doc = np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(d, "<u4")] for i, d in zip(frame["ids"], frame["docs"])])
    order = np.lexsort([doc] + [names[:, i] for i in range(lanes)][::-1])
    return names[order], doc[order]


def _groups(names: np.ndarray) -> np.ndarray:
    """First row of each run of equal names."""
    return np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))


def _replies(names: np.ndarray, doc: np.ndarray, buckets: int) -> list[tuple]:
    """Names back to their documents, packed by a hash of the document's id."""
    ids, where = np.unique(doc, return_inverse=True)
    home = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[where]
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    out = []
    for part in np.split(order, cuts) if len(order) else []:
        used, place = np.unique(where[part], return_inverse=True)
        out.append((int(home[part[0]]), ASKED, names[part].tobytes(), place.astype("<u4").tobytes(), ids[used].astype("<i8").tobytes()))
    return out


def _lists(answers: DataFrame, lanes: int, tasks: int) -> DataFrame:
    """``doc_id, names``: all that each document has learnt, one row per document."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in frame["ids"]]))
        names, doc = _gathered(frame, lanes)
        order = np.argsort(doc, kind="stable")
        names, doc = names[order], doc[order]
        begin, end = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        return pd.DataFrame({"doc_id": ids, "names": [names[a:b].tobytes() for a, b in zip(begin, end)]})

    return written(answers.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(merge, "doc_id long, names binary"))


def hot_names(rows: DataFrame, total: int, window: int, what: str) -> np.ndarray:
    """Names found in at least ``HOT_HITS`` of ``SAMPLE_DOCS`` documents drawn by a hash of their id.

    These are only treated apart; the result does not depend on which names the sample shows. The list
    holds at most ``HOT_NAMES`` names: if more are found, those found in the most documents. Of names with
    equal first lanes one is kept.
    """
    step = max(1, -(-total // SAMPLE_DOCS))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(step)) == 0)

    def list_names(batches):
        for batch in batches:
            for part in batches_by_size(_texts(batch), BATCH_BYTES):
                words = Words([t for _, t in part])
                found, doc, starts = anchors(words, window)
                names = pair_names(words, starts, window) if what == "windows" else np.stack([found, found], axis=1)
                names, _ = _unique(names, doc)
                lanes = names.astype(np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(lanes[:, 0]), pa.array(lanes[:, 1])], names=["a", "b"])

    often = cut_lineage(sample.mapInArrow(list_names, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_HITS))
    # No more counts than documents in the sample; the least one for which the list is short enough.
    held, least = 0, HOT_HITS
    for r in often.groupBy("n").count().orderBy(F.desc("n")).collect():
        held += r["count"]
        if held > HOT_NAMES:
            least = r["n"] + 1
            break
    got = often.filter(F.col("n") >= least).groupBy("a").agg(F.min("b").alias("b")).toPandas()
    return got[["a", "b"]].to_numpy(np.int64).view(np.uint64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes when a window of ``window`` words that covers it also occurs in a document with a
    smaller id. Windows are judged on the input. ``kept_sha256`` digests the kept words joined by one
    space. Ids are whole numbers; rows that share one are the same document and do not remove from each
    other; rows without id lose nothing and remove nothing. Null text has no words; texts shorter than a
    window lose nothing. An empty table gives an empty result; other columns are ignored.

    1. A bounded sample names hot windows and symbols, which a large part of all documents may hold.
       Hot symbols are shared, so nobody needs to ask. Of a hot window each batch sends its least id only.
    2. All other symbols travel in packed blocks to the bucket of their name; documents learn which of
       theirs are shared.
    3. Windows with a shared symbol travel likewise; documents learn which a smaller id has too.
    4. Each text is cut by what it has learnt, and by the least ids of the hot windows.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    # Each step's table is written out, so its shuffle files need not wait for the driver's garbage collector.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    rows = docs.select(name(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    total, size = named.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # A bucket holds what BUCKET_BYTES of texts ask for, however large the table; a task takes a bucket or two.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    buckets = buckets or max(2 * tasks, -(-(size or 0) // BUCKET_BYTES))
    homes = max(1, buckets // 2)
    hot_windows = Known(hot_names(named, total, window, "windows"))
    hot_symbols = np.sort(hot_names(named, total, window, "symbols")[:, 0])
    hot = context.broadcast((hot_windows, hot_symbols))

    def is_hot_symbol(found: np.ndarray) -> np.ndarray:
        known = hot.value[1]
        if not len(known):
            return np.zeros(len(found), bool)
        return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found

    def ask_symbols(batches):
        for batch in batches:
            for part in batches_by_size(_texts(batch), BATCH_BYTES):
                ids, words = np.asarray([i for i, _ in part], np.int64), Words([t for _, t in part])
                found, doc, starts = anchors(words, window)
                is_hot = is_hot_symbol(found)
                some = np.flatnonzero(is_hot)  # a hot window has a hot symbol
                place = hot.value[0].place(pair_names(words, starts[some], window))
                out = []
                at, of = place[place >= 0], ids[doc[some[place >= 0]]]
                if len(at):
                    order = np.lexsort([of, at])
                    at, of = at[order], of[order]
                    new = np.concatenate([[True], at[1:] != at[:-1]])
                    out += [(b, LEAST, n, d, i) for b, n, d, i in _blobs(hot.value[0].names[at[new]], np.arange(new.sum()), of[new], buckets)]
                across = np.unique(ids[doc[some[place < 0]]])
                if len(across):
                    out.append((int(across[0]) % buckets, ACROSS, b"", b"", across.astype("<i8").tobytes()))
                symbols, of = _unique(found[~is_hot].reshape(-1, 1), doc[~is_hot])
                out += [(b, ASKED, n, d, i) for b, n, d, i in _blobs(symbols, of, ids, buckets)]
                yield _table(out, _BLOB)

    def answer_symbols(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked, least, across = (frame[frame["kind"] == k] for k in (ASKED, LEAST, ACROSS))
        if len(asked):
            names, doc = _gathered(asked, 1)
            first = _groups(names)
            size = np.diff(np.concatenate([first, [len(names)]]))
            shared = np.repeat(doc[first] != doc[first + size - 1], size)
            out += _replies(names[shared], doc[shared], homes)
        if len(least):
            names, doc = _gathered(least, 2)
            first = _groups(names)
            out.append((0, LEAST, names[first].tobytes(), b"", doc[first].astype("<i8").tobytes()))
        if len(across):
            ids = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in across["ids"]]))
            home = (mix(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
            out += [(int(h), ASKED, b"", b"", ids[home == h].tobytes()) for h in np.unique(home)]
        return pd.DataFrame(out, columns=_BLOB.names)

    answers = written(named.mapInArrow(ask_symbols, _BLOB_SQL).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(answer_symbols, _BLOB_SQL))
    least = answers.filter(F.col("kind") == LEAST).select("ids", "names").toPandas()  # at most the hot windows of the sample
    least_of = np.full(len(hot_windows.names), np.iinfo(np.int64).max)
    if len(least):
        least_of[hot_windows.place(np.frombuffer(b"".join(least["names"]), np.uint64).reshape(-1, 2))] = np.frombuffer(b"".join(least["ids"]), "<i8")
    hot_least = context.broadcast(least_of)

    def ask_windows(batches):
        for batch in batches:
            ids_, names_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t.as_py().encode() for t in batch.column(2)]
            for part in batches_by_size(zip(ids_, names_, texts), BATCH_BYTES):
                ids, words = np.asarray([p[0] for p in part], np.int64), Words([p[2] for p in part])
                found, doc, starts = anchors(words, window)
                ask = is_hot_symbol(found) | _member(found, doc, [p[1] for p in part])
                some = np.flatnonzero(ask)
                names = pair_names(words, starts[some], window)
                cold = hot.value[0].place(names) < 0
                names, of = _unique(names[cold], doc[some[cold]])
                yield _table([(b, ASKED, n, d, i) for b, n, d, i in _blobs(names, of, ids, buckets)], _BLOB)

    def answer_windows(frame: pd.DataFrame) -> pd.DataFrame:
        names, doc = _gathered(frame, 2)
        first = _groups(names)
        later = doc > np.repeat(doc[first], np.diff(np.concatenate([first, [len(names)]])))
        return pd.DataFrame(_replies(names[later], doc[later], homes), columns=_BLOB.names)

    learnt = _lists(answers.filter(F.col("kind") == ASKED), 1, tasks)
    discard(answers)
    asking = named.join(small_side(learnt.select("doc_id"), 16), "doc_id", "left_semi").join(learnt, "doc_id")
    repeats = written(asking.select("doc_id", "names", "text").mapInArrow(ask_windows, _BLOB_SQL).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(answer_windows, _BLOB_SQL))

    def cut(batches):
        for batch in batches:
            ids_, names_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t.as_py().encode() for t in batch.column(2)]
            for part in batches_by_size(zip(ids_, names_, texts), BATCH_BYTES):
                words = Words([p[2] for p in part])
                counts = np.maximum(np.diff(words.first) - window + 1, 0)
                doc = np.repeat(np.arange(len(part)), counts)
                starts = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                lane = words.window_at(starts, window, seed=2)
                gone = np.zeros(len(doc), bool)
                maybe = np.flatnonzero(_near(hot.value[0].lane, lane))
                if len(maybe):
                    place = hot.value[0].place(pair_names(words, starts[maybe], window))
                    mine = np.asarray([np.iinfo(np.int64).min if p[0] is None else p[0] for p in part], np.int64)
                    gone[maybe] = (place >= 0) & (hot_least.value[place] < mine[doc[maybe]])
                for i in [i for i, p in enumerate(part) if p[1]]:
                    here = np.arange(*np.searchsorted(doc, [i, i + 1]))
                    known = np.frombuffer(part[i][1], np.uint64).reshape(-1, 2)
                    gone[here] |= Known(known).place(pair_names(words, starts[here], window)) >= 0
                edge = np.zeros(len(words.names) + 1, np.int64)
                np.add.at(edge, starts[gone], 1)
                np.add.at(edge, starts[gone] + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                out = []
                for i, (doc_id, _, text) in enumerate(part):
                    a, b = words.first[i], words.first[i + 1]
                    stay, tokens = keep[a:b], text.split()
                    if not stay.all():
                        tokens = [t for t, k in zip(tokens, stay.tolist()) if k]
                    out.append((doc_id, int(b - a), int(b - a - stay.sum()), hashlib.sha256(b" ".join(tokens)).hexdigest()))
                yield _table(out, _RESULT)

    discard(learnt)
    flagged = _lists(repeats, 2, tasks)
    discard(repeats)
    ids = flagged.select("doc_id")
    if fits_broadcast(ids, 16):
        ids = F.broadcast(ids)
        parts = rows.join(ids, "doc_id", "left_semi").join(flagged, "doc_id").select("doc_id", "names", "text")
        parts = parts.unionByName(rows.join(ids, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("binary").alias("names"), "text"))
    else:
        parts = rows.join(flagged, "doc_id", "left").select("doc_id", "names", "text")
    return parts.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
# Kinds of packed rows: names asked for, least ids of hot windows, documents with windows across a hot passage's ends.
ASKED, LEAST, ACROSS = 0, 1, 2


def _near(sorted_lane: np.ndarray, lane: np.ndarray) -> np.ndarray:
    if not len(sorted_lane):
        return np.zeros(len(lane), bool)
    return sorted_lane[np.minimum(np.searchsorted(sorted_lane, lane), len(sorted_lane) - 1)] == lane


def _member(found: np.ndarray, doc: np.ndarray, sets: list[bytes]) -> np.ndarray:
    """Whether each symbol is in the set of its text. Text and symbol are hashed to one key, which only filters."""
    known = np.frombuffer(b"".join(sets), np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])
    key = lambda name_, text: mix(name_ + mix(text.astype(np.uint64) + np.uint64(3)))
    return _near(np.sort(key(known, of)), key(found, doc))
