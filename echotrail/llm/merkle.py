"""Merkle manifest of a dataset: stored levels of parent-linked nodes, and a recursive query that climbs them.

Rows are leaves; per source they ascend by id, and every run of sixteen consecutive nodes has one parent
until one node, the subroot, remains. Subroots, ordered by source, likewise make the root. A row is checked
by climbing from its leaf to the root: each step appends the siblings of the node and folds the row's own
digest with them. Leaves of one run share every sibling above their run, so they climb as one row that
keeps a digest per leaf.
"""

from __future__ import annotations

import string
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.llm.common import name
from echotrail.operators.ordered import ordered_positions
from echotrail.session import cut_lineage, small_side, written

FAN = 16
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Every step of the climb divides the nodes by FAN; no table on earth needs so many steps.
MOST_STEPS = 64


def sha256_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return sha256_of(*[encoded(v) for v in values])


@dataclass(frozen=True)
class Manifest:
    """Stored tables of a tree.

    ``runs``: lowest level, one row per run of leaves: ``tree, n, run, leaves, members, digest`` and the link
    upwards. ``nodes``: the other levels, one row per node: ``tree, level, place, members, digest`` and the
    link. A link is ``up_tree, up_level, up_place`` (all null at the root) and ``slot``, the place among the
    parent's members. Tree 0 is the one over the subroots. ``trees``: ``tree, source, n``; ``subroots``:
    ``tree, digest``. ``root`` is null for an empty table.
    """

    runs: DataFrame
    nodes: DataFrame
    trees: DataFrame
    subroots: DataFrame
    root: str | None


def _at_level(n: Column, level: int, fan: int) -> Column:
    """Nodes at a level of a tree with ``n`` leaves."""
    width = fan ** level
    return F.floor((n + (width - 1)) / F.lit(width)).cast("long")


def _linked(nodes: DataFrame, level: int, n_trees: int, fan: int) -> DataFrame:
    """Adds the link of nodes ``tree, n, place`` at ``level``: the parent in their tree, or the tree of subroots, or none."""
    on = F.col("tree") == 0
    last = _at_level(F.col("n"), level, fan) <= 1
    above = F.lit(n_trees > 1)
    as_subroot = F.col("tree") - 1
    place = F.when(last, as_subroot).otherwise(F.col("place"))
    parent = F.floor(place / fan).cast("long")
    ends = last & (on | ~above)
    up = lambda value: F.when(~ends, value)
    return nodes.withColumns({
        "up_tree": up(F.when(last, F.lit(0)).otherwise(F.col("tree")).cast("long")),
        "up_level": up(F.when(last, F.lit(1)).otherwise(F.lit(level + 1)).cast("int")),
        "up_place": up(parent),
        "slot": up((place % fan).cast("int")),
    })


def _parents(below: DataFrame, fan: int) -> DataFrame:
    """The level above ``tree, n, place, digest``: a run never has more than ``fan`` rows, so no group is large."""
    runs = below.groupBy("tree", "n", F.floor(F.col("place") / fan).cast("long").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("below"))
    members = F.array_join(F.transform("below", lambda x: x["digest"]), "")
    return runs.select("tree", "n", F.col("up").alias("place"), members.alias("members"), sha256_of(members).alias("digest"))


def build(leaves: DataFrame, fan: int = FAN) -> Manifest:
    """Levels over ``doc_id, source, leaf`` and any further columns, which stay with their leaf.

    Leaves of a source ascend by id (null first), then digest; sources by their bytes (null first). A source
    may hold any share of the rows: it is range-partitioned by its order. The driver sees the number of
    sources, the size of the largest and the root.
    """
    extra = [c for c in leaves.columns if c != "source"]
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), *[F.col(c) for c in extra if c not in ("doc_id", "leaf")]]
    placed = written(ordered_positions(leaves, ["source"], order))
    sizes = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    trees = written(ordered_positions(sizes, [], [F.col("source").asc_nulls_first()], "tree"))
    n_trees, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    named = small_side(trees.withColumnRenamed("source", "_source"), 128)
    rows = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaf = F.struct((F.col("pos") - 1).alias("place"), *extra)
    runs = rows.groupBy("tree", "n", F.floor((F.col("pos") - 1) / fan).cast("long").alias("place")).agg(
        F.sort_array(F.collect_list(leaf)).alias("leaves"))
    runs = runs.withColumn("members", F.array_join(F.transform("leaves", lambda x: x["leaf"]), ""))
    # A source with one leaf has no run: the leaf is the subroot.
    runs = runs.withColumn("digest", F.when(F.col("n") == 1, F.col("members")).otherwise(sha256_of(F.col("members"))))
    runs = written(_linked(runs, 1, n_trees, fan))

    def climb_levels(below: DataFrame, level: int, size: int) -> tuple[list[DataFrame], list[DataFrame]]:
        """All levels above one, and the single nodes in which trees end."""
        levels, tops = [], []
        while True:
            width = _at_level(F.col("n"), level, fan)
            tops.append(below.filter(width <= 1).select("tree", "digest"))
            if -(-size // fan ** level) <= 1:
                return levels, tops
            table = written(_linked(_parents(below.filter(width > 1), fan), level + 1, n_trees, fan))
            levels.append(table.select("tree", F.lit(level + 1).alias("level"), *[c for c in table.columns if c not in ("tree", "n")]))
            below, level = table.select("tree", "n", "place", "digest"), level + 1

    def together(tables: list[DataFrame]) -> DataFrame:
        all_rows = tables[0]
        for t in tables[1:]:
            all_rows = all_rows.unionByName(t)
        return all_rows

    levels, tops = climb_levels(runs.select("tree", "n", "place", "digest"), 1, largest or 0)
    subroots = written(together(tops))
    top_leaves = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), (F.col("tree") - 1).alias("place"), "digest")
    top_levels, ends = climb_levels(top_leaves, 0, n_trees)
    found = together(ends).first()
    bare = runs.limit(0).select("tree", F.lit(0).alias("level"), "place", "members", "digest", "up_tree", "up_level", "up_place", "slot")
    return Manifest(runs, together([bare] + levels + top_levels), trees, subroots, found["digest"] if found else None)


@contextmanager
def _unbounded_recursion(spark: SparkSession):
    """A recursive query may return any number of rows inside; its depth stays bounded."""
    settings = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(MOST_STEPS)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


CLIMB = """
WITH RECURSIVE climb(tree, place, up_tree, up_level, up_place, slot, folded, above) AS (
  SELECT tree, place, up_tree, up_level, up_place, slot, folded, CAST('' AS STRING) FROM {starts}
  UNION ALL
  SELECT c.tree, c.place, n.up_tree, n.up_level, n.up_place, n.slot,
         transform(c.folded, f -> sha2(CAST(concat(left(n.members, {hex} * c.slot), f, substr(n.members, {hex} * c.slot + {hex} + 1)) AS BINARY), 256)),
         concat(c.above, left(n.members, {hex} * c.slot), substr(n.members, {hex} * c.slot + {hex} + 1))
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.place = c.up_place)
SELECT tree, place, folded, above FROM climb WHERE up_tree IS NULL
"""


def others(members: Column, slot: Column) -> Column:
    """Members of a run but the one at ``slot``."""
    return F.concat(members.substr(F.lit(1), slot * HEX), members.substr(slot * HEX + HEX + 1, F.char_length(members)))


def folded_with(members: Column, slot: Column, digest: Column) -> Column:
    """Digest of the run with ``digest`` at ``slot``."""
    return sha256_of(members.substr(F.lit(1), slot * HEX), digest, members.substr(slot * HEX + HEX + 1, F.char_length(members)))


def verify(manifest: Manifest, claimed: str = "claimed") -> DataFrame:
    """One row per leaf: its columns, ``subroot, root, proof_sha256, folded_root, verified``.

    ``claimed`` names the column of the leaves with the digest that is to be checked. Each step of the
    recursive query joins the climbing runs with their parents, which are broadcast only if they are few.
    """
    runs, spark = manifest.runs, manifest.runs.sparkSession
    alone = F.col("n") == 1
    folded = F.transform("leaves", lambda x, i: F.when(alone, x[claimed]).otherwise(folded_with(F.col("members"), i, x[claimed])))
    starts = runs.select("tree", "place", "up_tree", "up_level", "up_place", "slot", folded.alias("folded"))
    with _unbounded_recursion(spark):
        ended = written(spark.sql(CLIMB, starts=starts, nodes=small_side(manifest.nodes, 1280), hex=HEX))
    subroots = small_side(manifest.subroots.withColumnRenamed("digest", "subroot"), 128)
    climbed = runs.select("tree", "n", "place", "members", "leaves").join(ended, ["tree", "place"]).join(subroots, "tree")
    rows = climbed.select(
        "n", "members", "above", "subroot", F.posexplode(F.arrays_zip("leaves", "folded")).alias("_slot", "_leaf"))
    fields = [f for f in runs.schema["leaves"].dataType.elementType.names if f != "place"]
    siblings = F.when(F.col("n") == 1, F.lit("")).otherwise(others(F.col("members"), F.col("_slot")))
    root = F.lit(manifest.root).cast("string")
    return rows.select(
        *[F.col("_leaf.leaves").getField(c).alias(c) for c in fields], "subroot", root.alias("root"),
        sha256_of(siblings, F.col("above")).alias("proof_sha256"), F.col("_leaf.folded").alias("folded_root"),
        (F.col("_leaf.folded") == root).alias("verified"))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def manifest_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS, text_col: str = "text",
                    tamper_every: int = 5, fan: int = FAN) -> DataFrame:
    """Manifest of ``docs`` and a check of every row, some of them tampered with.

    A row is tampered with if ``tamper_every`` divides the unsigned CRC-32 of its decimal id: its text is
    lower-cased. One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    Null values have an encoding of their own; a null id is never tampered with, comes first in its source,
    and null sources are one source; rows that repeat are leaves of their own; an empty table gives an empty
    result; columns that are not named are ignored.
    """
    tampered = F.crc32(name(id_col).cast("string").cast("binary")) % tamper_every == 0
    own = leaf_digest([name(c) for c in columns])
    changed = leaf_digest([lowered(name(c).cast("string")) if c == text_col else name(c) for c in columns])
    leaves = docs.select(
        name(id_col).alias("doc_id"), name(source_col).alias("source"), own.alias("leaf"),
        F.when(tampered, changed).alias("changed"))
    manifest = build(cut_lineage(leaves.withColumn("claimed", F.coalesce("changed", "leaf")).drop("changed")), fan)
    return verify(manifest).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
