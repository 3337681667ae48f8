"""Mixture-controlled packing: deficit round-robin over source queues into windows of tokens.

Every source is a queue of its documents in a seeded random order, cut into packets. In each round a
queue may send its quantum, the source's target share of one window; what it could not send for want of
a whole packet stays as its deficit. A packet that ends E tokens into its queue is therefore sent in
round ceil(E / quantum), which prefix sums over the queues give at once, for all partitions alike. Laid
end to end in the order of rounds, the packets fill windows without gaps, and deficits carry over from
window to window and from partition to partition.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of
from echotrail.llm.grams import batches_by_size
from echotrail.operators.ordered import ordered_positions, running_total
from echotrail.session import small_side, written

WINDOW = 4096
PACKET = 256
END_ID = 2
SEED = 7
# Rows whose prefix sums one task makes.
CHUNK = 1024
# A worker keeps its caches between tasks, beside whatever runs next on its executor.
CACHE_WORDS = 300_000
CACHE_LETTERS = 400_000
# Sequence of other characters than letters, digits and white space; one such run is one piece. The
# apostrophe is left to the tokenizer, which ties it to what follows.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Byte-level vocabularies show each byte as a character: visible ones as themselves, others in order from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: b if b in set(_SHOWN) else 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def word_tokens(path: str) -> "WordTokens":
    """One encoder per worker process, whose caches serve all tasks that the worker runs."""
    return WordTokens(path)


class WordTokens:
    """Token ids of texts for a vocabulary that lowers case, cuts words at white space, and then cuts
    letters from other characters.

    Texts are cut at ASCII white space and each distinct word is encoded once while it is cached. Of a
    word of Latin letters between punctuation the letters go straight to the merges of the vocabulary;
    punctuation and all other words take the whole tokenizer. Full caches start anew, so their memory is
    bounded and the ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.starts, self.counts, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint16)
        self.used = 0

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint16).tobytes()

    def _ids(self, word: str) -> bytes:
        """Ids of a word, two bytes each."""
        core = word.strip(PUNCTUATION)
        # Beyond Latin-1, lower case and composition need the tokenizer's own rules, as do its special tokens.
        plain = core.isascii()
        if not core.isalpha() or (not plain and max(core) > "\u00ff") or "<|" in word:
            return self._whole(word)
        low = core.lower()
        ids = self.letters.get(low)
        if ids is None:
            if len(self.letters) >= CACHE_LETTERS:
                self.letters.clear()
            # ASCII letters are shown as themselves.
            shown = low if plain else low.encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = self.letters[low] = array("H", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(core) == len(word):
            return ids
        at = word.index(core)
        return b"".join([self._mark(word[:at]), ids, self._mark(word[at + len(core):])])

    def _mark(self, text: str) -> bytes:
        ids = self.marks.get(text)
        if ids is None:
            if len(self.marks) >= CACHE_LETTERS:
                self.marks.clear()
            ids = self.marks[text] = self._whole(text)
        return ids

    def _learn(self, words: list[bytes]) -> None:
        ids = [self._ids(w.decode()) for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        at, more = len(self.index), int(counts.sum())
        while at + len(words) > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while self.used + more > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + more] = np.frombuffer(b"".join(ids), np.uint16)
        self.counts[at:at + len(words)] = counts
        self.starts[at:at + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += more
        self.index.update(zip(words, range(at, at + len(words))))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        split = [t.split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self._reset()
        new = list({w for words in split for w in words if w not in self.index})
        if new:
            self._learn(new)
        get = self.index.__getitem__
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for words in split for i in map(get, words)), np.int64, int(sizes.sum()))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return [flat[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Stored table ``doc_id, row_id, source, order, n, ids``; ``ids`` holds two bytes per id, end id included."""
    text = text_of(text_col)
    rows = docs.select(
        name(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), name(source_col).cast("string").alias("source"),
        F.xxhash64(F.lit(SEED), name(id_col), text).alias("order"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        words = word_tokens(vocabulary)
        for batch in batches:
            counts, ids = [], []
            for part in batches_by_size(((t.as_py().encode(),) for t in batch.column(4)), 1024 * 1024):
                for x in words.encode([p[0] for p in part]):
                    counts.append(len(x) + 1)
                    ids.append(x.astype("<u2").tobytes() + END_ID.to_bytes(2, "little"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "row_id", "source", "order", "n", "ids"])

    return written(rows.mapInArrow(encode, f"doc_id {id_type}, row_id long, source string, `order` long, n long, ids binary"))


def _refuse(sizes: DataFrame, shares: DataFrame) -> None:
    share = F.col("share").cast("double")
    odd = shares.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce((share > 0) & (share < float("inf")), F.lit(False))).alias("fit")).filter("n > 1 or not fit")
    wrong = [r.source for r in odd.select("source").limit(5).collect()]
    if wrong:
        raise ValueError(f"shares are not one positive number each for sources {wrong}")
    named = shares.select(F.col("source").alias("_source"))
    missing = [r.source for r in sizes.select("source").distinct().join(named, F.col("source").eqNullSafe(F.col("_source")), "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"shares miss sources {missing}")


def segments(sizes: DataFrame, shares: DataFrame | None = None, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """The part of each document that each round sends: ``row_id, source, round, start, length, at``.

    ``sizes`` has ``row_id, source, order, n``. ``shares`` (``source, share``) gives the target
    proportions; without it a source's share is its part of all tokens, so that all queues end together.
    A queue that ends leaves its share of the later windows to the others. ``at`` is the place in the queue.
    Given shares have to name every source once, null as well, with a positive number; else a ValueError
    says which do not.
    """
    if shares is not None:
        _refuse(sizes, shares)
    queued = running_total(ordered_positions(sizes, ["source"], ["order", "row_id"]), ["source"], "n", "end", CHUNK)
    if shares is None:
        totals = sizes.groupBy("source").agg(F.sum("n").cast("double").alias("share"))
        whole = totals.agg(F.sum("share")).first()[0] or 1.0
        shares = totals.withColumn("share", F.col("share") / whole)
    named = shares.select(F.col("source").alias("_source"), F.col("share").alias("_share"))
    joined = queued.join(small_side(named, 256), F.col("source").eqNullSafe(F.col("_source")))
    rows = joined.select("row_id", "source", (F.col("end") - F.col("n")).alias("at"), "n", (F.col("_share") * window).alias("quantum"))

    def cut(batches):
        for batch in batches:
            ids, source, at, n, quantum = (batch.column(i) for i in range(5))
            at, n, quantum = at.to_numpy(), n.to_numpy(), quantum.to_numpy()
            packets = -(-n // packet)
            row = np.repeat(np.arange(len(n)), packets)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(packets) - packets, packets)
            start = nth * packet
            length = np.minimum(packet, n[row] - start)
            rounds = np.ceil((at[row] + start + length) / quantum[row]).astype(np.int64)
            # Packets of one document in the same round follow each other and are one segment.
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rounds[1:] != rounds[:-1])])) if len(row) else np.zeros(0, np.int64)
            size = np.add.reduceat(length, new) if len(new) else np.zeros(0, np.int64)
            take = pa.array(row[new])
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), source.take(take), pa.array(rounds[new]), pa.array(start[new]), pa.array(size), pa.array(at[row[new]] + start[new])],
                names=["row_id", "source", "round", "start", "length", "at"])

    return rows.mapInArrow(cut, "row_id long, source string, round long, start long, length long, at long")


def pieces(laid: DataFrame, total: int, window: int = WINDOW) -> DataFrame:
    """Cut segments at window ends: ``row_id, start, length, sequence_id, offset``.

    ``laid`` has each segment's ``end`` in the whole stream of ``total`` tokens. What does not fill a
    last window becomes sequences whose lengths are powers of two, which need no padding.
    """
    full = total // window
    ends, rest, at = [], total - full * window, full * window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        ends.append((at, at + size))
        at, rest = at + size, rest - size
    begin, end = F.col("end") - F.col("length"), F.col("end")
    windows = F.when(begin < full * window, F.transform(
        F.sequence(F.floor(begin / window), F.floor((F.least(end, F.lit(full * window)) - 1) / window)),
        lambda k: F.struct(k.alias("id"), (k * window).alias("a"), ((k + 1) * window).alias("b"))))
    kind = "array<struct<id:bigint,a:bigint,b:bigint>>"
    tails = F.array(*[F.struct(F.lit(full + i).cast("long").alias("id"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(ends)])
    tails = F.filter(tails.cast(kind), lambda t: (t["a"] < end) & (t["b"] > begin)) if ends else F.array().cast(kind)
    hit = laid.withColumn("w", F.explode(F.concat(F.coalesce(windows.cast(kind), F.array().cast(kind)), tails)))
    first, last = F.greatest(begin, F.col("w.a")), F.least(end, F.col("w.b"))
    return hit.select("row_id", (F.col("start") + first - begin).alias("start"), (last - first).alias("length"), F.col("w.id").alias("sequence_id"), (first - F.col("w.a")).alias("offset"))


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         shares: DataFrame | None = None, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each row of ``docs`` is a document of its own, also when its id repeats or is null; null text has
    only the end id, null sources are one queue. ``shares`` that miss a source, repeat one or are not
    positive are refused. An empty table gives an empty result; other columns
    are ignored.
    """
    stored = tokenised(docs, vocabulary or default_vocabulary(), id_col, text_col, source_col)
    cuts = segments(stored.select("row_id", "source", "order", "n"), shares, window, packet)
    laid = running_total(ordered_positions(cuts, [], ["round", F.col("source").isNull(), "source", "at"]), [], "length", "end", CHUNK)
    total = stored.agg(F.sum("n")).first()[0] or 0
    placed = pieces(laid, total, window)
    lists = placed.groupBy("row_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = stored.select("row_id", "doc_id", "n", "ids").join(lists, "row_id").select("doc_id", "n", "ids", "pieces")
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column(3)]))
            flat = batch.column(3).flatten()
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            sums, seen, ids = [], -1, None
            for r, a, n in zip(rows.to_numpy(), start, length):
                if r != seen:
                    seen, ids = r, np.frombuffer(batch.column(2)[int(r)].as_py(), "<u2").astype("<u4").tobytes()
                sums.append(zlib.crc32(memoryview(ids)[4 * a:4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), flat.field("start"), flat.field("length"), pa.array(sums, pa.int64()), batch.column(1).take(rows),
                 flat.field("sequence_id"), flat.field("offset")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(digest, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
