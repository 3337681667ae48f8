"""Exact dedup that treats frequent texts apart: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import SPACE_CLASS, name, text_of, unpacked, whole_row
from echotrail.session import cut_lineage, small_side, written

# A text held by more than this share of all rows is handled on the map side. The Misra-Gries
# summary then has at most 1 / share entries, which bounds both the summary and the broadcast.
FREQUENT_SHARE = 1 / 256


def _digest_columns(id_value: Column, text: Column) -> list[Column]:
    """Id, length and digest of the text without white space."""
    return [
        id_value.alias("doc_id"),
        F.char_length(text).cast("long").alias("length"),
        F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", "").cast("binary"), 256).alias("digest"),
    ]


def decide(digests: DataFrame, frequent_share: float = FREQUENT_SHARE) -> DataFrame:
    """Which row of each group of equal digests stays.

    ``digests`` has ``doc_id``, ``length``, ``digest`` and the unique ``row_id`` and must be a stored
    table. Adds ``winner`` (struct with the ``doc_id`` and ``row_id`` that stays) and ``group_size``.

    1. Misra-Gries (``freqItems``) names every digest above ``frequent_share``, and perhaps others.
    2. Those few digests are counted exactly, and their winners found, with map-side partial sums.
       Digests that are not frequent after all go back to the ordinary path.
    3. Rows of frequent digests meet their broadcast winners on the map side and are never shuffled.
    4. All others are grouped by digest and joined back; no such group exceeds the share.
    """
    best = F.min(F.struct(
        (-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row_id"),
    )).alias("winner")
    size = F.count(F.lit(1)).alias("group_size")
    named = digests.stat.freqItems(["digest"], frequent_share).select(F.explode("digest_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(named), "digest").groupBy("digest").agg(size, best)
    total = digests.count()
    frequent = cut_lineage(counted.filter(F.col("group_size") > frequent_share * total))
    tagged = digests.join(F.broadcast(frequent), "digest", "left")
    hot = tagged.filter(F.col("winner").isNotNull())
    rest = tagged.filter(F.col("winner").isNull()).select(*digests.columns)
    cold = rest.join(rest.groupBy("digest").agg(size, best), "digest")
    return hot.unionByName(cold)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_share: float = FREQUENT_SHARE) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space. The row with the longest original
    text stays, then the smallest id (null last), then the first read of rows alike in all that, so
    exactly one row of a group is ``kept``. Null and empty texts are one group, as are all texts of
    white space. An empty table gives an empty result; other columns are ignored.
    """
    digests = written(docs.select(
        *_digest_columns(name(id_col), text_of(text_col)), F.monotonically_increasing_id().alias("row_id")))
    return decide(digests, frequent_share).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("winner.row_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_share: float = FREQUENT_SHARE) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Rows are written once with their digest; the few columns of the decision are grouped, and only
    the list of dropped rows meets the texts again.
    """
    stored = written(docs.select(
        whole_row(docs), *_digest_columns(name(id_col), text_of(text_col)), F.monotonically_increasing_id().alias("row_id")))
    decided = decide(stored.select("doc_id", "length", "digest", "row_id"), frequent_share)
    dropped = cut_lineage(decided.filter(F.col("row_id") != F.col("winner.row_id")).select("row_id"))
    return unpacked(stored.join(small_side(dropped, 16), "row_id", "left_anti"), docs.columns)
