"""Near-duplicate documents by MinHash bands, with sequential Bayesian verification.

Documents with equal shingle sets form one class. Signatures of class representatives are cut into
bands; representatives that agree on a band are candidates. A candidate pair is compared batch by batch:
after each batch of signature values the posterior of its similarity is bounded, and the pair is dropped
once the chance that it still reaches the threshold is below the chosen miss probability. Whatever
survives is verified on the full shingle sets.

Large buckets never emit all their pairs. Their members are first chained at random; what the chains
leave apart is then compared inside tasks, block by block: pairs between different components take
the Bayesian test and then the full one, and only links come out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of, unpacked, whole_row
from echotrail.llm.components import components
from echotrail.llm.grams import Words, batches_by_size, mix
from echotrail.session import cut_lineage, small_side, written

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
BATCH = 16
MISS = 1e-7
SMALL_BUCKET = 8
CHAIN_BLOCK = 256
BATCH_BYTES = 8 * 1024 * 1024
STRAGGLER_BYTES, MEMBER_BYTES = 2 * 1024 * 1024, 8 * 1024 * 1024

_RNG = np.random.default_rng(97)
_FACTOR = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)


@lru_cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """For each batch end n, the fewest equal values that keep a pair alive.

    With a flat prior, after m equal values of n the similarity is Beta(m + 1, n - m + 1) distributed,
    and the chance that it reaches t is that of at most m successes in n + 1 draws with probability t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.asarray(out)


def surviving(left: np.ndarray, right: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for step, least in enumerate(least_matches(percent, miss)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle."""
    words = Words(texts, lower=True)
    hashes, first = words.windows(size)
    out = []
    for i in range(len(texts)):
        n = words.first[i + 1] - words.first[i]
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < size:
            out.append(words.window_at(words.first[i:i + 1], int(n), seed=int(n)))
        else:
            out.append(np.unique(hashes[first[i]:first[i + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 16 bits each, one row per non-empty set."""
    if not sets:
        return np.zeros((0, VALUES), np.uint16)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), VALUES), np.uint16)
    for j in range(VALUES):
        least = np.minimum.reduceat((flat ^ _FLIP[j]) * _FACTOR[j], starts)
        out[:, j] = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, keep_row: bool) -> DataFrame:
    """Stored table with a row id, the text or whole row, and the sketch of each text."""
    # Rows carry their text and come back with it, so batches are bounded by bytes as well.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(
        name(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
        *([whole_row(docs)] if keep_row else []), text_of(text_col).alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"] + [rows.schema["text"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_shingles long, set_a long, set_b long, sig binary"

    def sketch_batches(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(batch.num_columns - 1)]
            counts, set_a, set_b, sigs = [], [], [], []
            for part in batches_by_size(((t,) for t in texts), 1024 * 1024):
                sets = shingle_sets([p[0] for p in part], size)
                made = signatures([s for s in sets if len(s)])
                at = 0
                for s in sets:
                    counts.append(len(s))
                    set_a.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    set_b.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    sigs.append(made[at].tobytes() if len(s) else None)
                    at += bool(len(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(sigs, pa.binary())],
                names=[*batch.schema.names, "n_shingles", "set_a", "set_b", "sig"])

    return written(rows.select(*[f.name for f in kept]).mapInArrow(sketch_batches, schema))


def band_members(reps: DataFrame) -> DataFrame:
    """``key, band, node, size``: the members of every band bucket that has at least two."""
    width = ROWS * 2
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    rows = reps.select("node", F.posexplode(keys).alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return written(rows.join(sizes, "key"))


def first_pairs(members: DataFrame) -> DataFrame:
    """Distinct candidate pairs: all of a small bucket, and neighbours at random in a large one.

    A bucket is cut into blocks of bounded size before any window sees it, and a member meets at most
    the next few members of its block.
    """
    block = F.when(F.col("size") <= SMALL_BUCKET, 0).otherwise(F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / CHAIN_BLOCK).cast("long")))
    order = Window.partitionBy("key", "block").orderBy("mixed", "node")
    blocks = members.select("key", "node", "size", block.alias("block"), F.xxhash64("node", "band", F.lit(3)).alias("mixed"))
    following = [F.lead("node", k).over(order) for k in range(1, SMALL_BUCKET)]
    meets = F.when(F.col("size") <= SMALL_BUCKET, F.array(*following)).otherwise(F.array(following[0]))
    pairs = blocks.select("node", meets.alias("others")).select("node", F.explode(F.filter("others", lambda x: x.isNotNull())).alias("other"))
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, VALUES)


def bayes_filter(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that survive the sequential test on their signatures."""
    a = reps.select(F.col("node").alias("u"), F.col("sig").alias("sig_u"))
    b = reps.select(F.col("node").alias("v"), F.col("sig").alias("sig_v"))

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                alive = pa.array(surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(test, "u long, v long")


def shingle_table(stored: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Stored table ``node, items``: the full shingle sets of the rows that ``ids(row_id)`` names."""
    texts = stored.select("row_id", "text").join(small_side(ids, 16), "row_id", "left_semi")

    def make(batches):
        for batch in batches:
            names, texts_ = batch.column(0).to_pylist(), [t.as_py().encode() for t in batch.column(1)]
            for part in batches_by_size(zip(names, texts_)):
                sets = shingle_sets([p[1] for p in part], size)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return written(texts.mapInArrow(make, "node long, items binary"))


def is_link(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def verified(pairs: DataFrame, stored: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among ``pairs``: percent of the union of the full shingle sets that is shared."""
    pairs = written(pairs)
    sets = shingle_table(stored, pairs.select(F.explode(F.array("u", "v")).alias("row_id")).distinct(), size)

    def check(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3)))
                    if is_link(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["u", "v"])

    a = sets.select(F.col("node").alias("u"), F.col("items").alias("items_u"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("items_v"))
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "items_u", "items_v").mapInArrow(check, "u long, v long"))


def remaining_links(members: DataFrame, labels: DataFrame, reps: DataFrame, stored: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links inside large buckets between members that still belong to different components.

    In such a bucket the stragglers, which are outside its commonest component, meet all members. Both
    sides are cut into blocks of bounded bytes; a task holds one block of each with its full sets, tests
    a pair in the first bucket that it shares, verifies what survives and gives out links only: one for
    a straggler and a component is enough. None if no bucket is left.
    """
    large = members.filter(F.col("size") > SMALL_BUCKET).join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    counts = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("common"), (F.sum("n") - F.max("n")).alias("s")).filter("s > 0").drop("s")
    mixed = cut_lineage(mixed)
    if mixed.isEmpty():
        return None
    left = large.join(mixed, "key")
    sets = shingle_table(stored, left.select(F.col("node").alias("row_id")).distinct(), size)
    left = left.join(reps, "node").join(sets, "node")
    straggler = F.col("label") != F.col("common")
    bytes_ = F.octet_length("items") + 2 * VALUES
    widths = cut_lineage(left.groupBy("key").agg(
        F.ceil(F.sum(F.when(straggler, bytes_).otherwise(0)) / STRAGGLER_BYTES).alias("s_blocks"), F.ceil(F.sum(bytes_) / MEMBER_BYTES).alias("m_blocks")))
    left = left.join(widths, "key")
    spread = F.xxhash64("node", F.lit(5))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    columns = ["key", "band", "node", "label", "sig", "items"]
    apart = left.filter(straggler).select(*columns, F.lit(True).alias("straggler"), F.pmod(spread, "s_blocks").alias("sb"), every("m_blocks").alias("mb"))
    whole = left.select(*columns, F.lit(False).alias("straggler"), F.pmod(spread, "m_blocks").alias("mb"), every("s_blocks").alias("sb"))

    def compare(rows: pa.Table) -> pa.Table:
        left, right = [], []
        mine = rows.column("straggler")
        some, others = rows.filter(mine), rows.filter(pc.invert(mine))
        if some.num_rows and others.num_rows:
            band = some.column("band")[0].as_py()
            matrix = _matrix(others.column("sig"))
            nodes, labels_ = others.column("node").to_numpy(), others.column("label").to_numpy()
            sets_ = others.column("items")
            for node, label, sig, items in zip(*(some.column(c).to_pylist() for c in ("node", "label", "sig", "items"))):
                row, set_, joined = np.frombuffer(sig, np.uint16), np.frombuffer(items, np.uint64), set()
                other = np.flatnonzero(labels_ != label)
                other = other[surviving(matrix[other], np.broadcast_to(row, (len(other), VALUES)), percent)]
                same = (matrix[other] == row).reshape(-1, BANDS, ROWS).all(axis=2)
                for o, bands in zip(other.tolist(), same):
                    if labels_[o] not in joined and bands.argmax() == band and is_link(set_, np.frombuffer(sets_[o].as_py(), np.uint64), percent):
                        joined.add(labels_[o])
                        left.append(node)
                        right.append(nodes[o])
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return written(apart.unionByName(whole).groupBy("key", "sb", "mb").applyInArrow(compare, "u long, v long"))


def near_components(stored: DataFrame, size: int, percent: int) -> DataFrame:
    """``row_id, root`` of every row of a sketched table that has shingles; root is a row id."""
    classes = stored.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("row_id").alias("node"))
    classes = written(classes)
    slim = stored.select("row_id", "set_a", "set_b", "n_shingles")
    reps = written(stored.select(F.col("row_id").alias("node"), "sig").join(classes.select("node"), "node"))
    members = band_members(reps)
    links = verified(bayes_filter(first_pairs(members), reps, percent), stored, size, percent)
    labels = components(links)
    more = remaining_links(members, labels, reps, stored, size, percent)
    if more is not None:
        labels = components(links.unionByName(more))
    rooted = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    return slim.filter("n_shingles > 0").join(rooted, ["set_a", "set_b", "n_shingles"]).select("row_id", "root")


def _decided(stored: DataFrame, size: int, percent: int) -> DataFrame:
    """``row_id, doc_id, n_shingles, first``: ``first`` is the struct of the row that stands for the component."""
    slim = stored.select("row_id", "doc_id", "n_shingles")
    rooted = cut_lineage(slim.join(near_components(stored, size, percent), "row_id", "left").withColumn("root", F.coalesce("root", "row_id")))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row_id"))
    # Most rows stand alone and need no partner's id.
    first = rooted.groupBy("root").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first")
    return rooted.join(small_side(cut_lineage(first), 48), "root", "left").withColumn("first", F.coalesce("first", own))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A to Z count as lower case. A document's set holds its distinct shingles of ``size`` words; fewer
    words make one shingle of all; null or wordless texts have none and stand alone. Two documents are
    linked when they share at least ``percent`` of the union of their sets. ``component_id`` is the
    smallest id reachable over links (null if the component has none); rows alike in that are told apart
    by reading order, so exactly one row of a component is kept. An empty table gives an empty result;
    other columns are ignored.
    """
    stored = sketch(docs, id_col, text_col, size, keep_row=False)
    return _decided(stored, size, percent).select(
        "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one of each component."""
    stored = sketch(docs, id_col, text_col, size, keep_row=True)
    dropped = cut_lineage(_decided(stored, size, percent).filter(F.col("row_id") != F.col("first.row_id")).select("row_id"))
    return unpacked(stored.join(small_side(dropped, 16), "row_id", "left_anti"), docs.columns)
