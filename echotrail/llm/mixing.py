"""Mix sources to target weights: hash-random order per source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of, whole_row, word_count
from echotrail.operators.ordered import ordered_positions, running_total
from echotrail.session import cut_lineage, small_side, written

# Sources in code point order get these weights in turn.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 20_113
# Rows whose prefix sums one task makes; a hot source spreads over many such chunks.
CHUNK = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per source: ``source, source_size, target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes. Targets stop at ``most_epochs`` times the source's size, and what they leave is shared anew
    by weight among the others until none is above. Each round sends three sums to the driver; the
    sources themselves stay in Spark. ``sizes`` has ``source`` and ``size``.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_positions(totals, [], [F.col("source").isNull(), F.col("source")], "_rank")
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights)))).cast("int"))
    weighed = cut_lineage(ranked.withColumn("_weight", turn.cast("double")).withColumn("_most", (F.col("source_size") * most_epochs).cast("double")))
    wanted = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    settled = -1
    while True:
        full = F.col("_weight") * F.lit(level) >= F.col("_most")
        got = weighed.agg(
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))),
            F.sum(F.when(full, 1).otherwise(0))).first()
        if not got[1] or got[2] == settled:
            break
        settled, level = got[2], (wanted - got[0]) / got[1]
    target = F.least(F.col("_most"), F.col("_weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, seed: int = SEED,
             keep_row: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Rows of a source lie in the order of a seeded hash of their id, then id, size and text hash, so
    reruns agree. Whole epochs come first; the rest of the target is cut from that order at the exact
    word, so one row per source may be taken in part. Each source takes its target rounded to a word.
    A source may hold any share of the rows: it is range-partitioned by its order, and prefix sums run
    over bounded chunks.

    Null text has size 0 and is never taken; null sources are one source, the last; rows that repeat
    are separate documents; an empty table gives an empty result. With ``keep_row`` the input row comes
    along as ``row``.
    """
    text = text_of(text_col)
    sized = docs.select(
        name(id_col).alias("doc_id"), name(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), name(id_col)).alias("_key"), F.xxhash64(text).alias("_text"),
        *([whole_row(docs)] if keep_row else []), F.monotonically_increasing_id().alias("_row_id"))
    stored = written(sized)
    narrow = stored.drop("row") if keep_row else stored
    goals = source_targets(narrow, weights, share, most_epochs)
    placed = ordered_positions(narrow, ["source"], ["_key", "doc_id", "size", "_text", "_row_id"], "_pos")
    summed = running_total(placed, ["source"], "size", "_end", CHUNK, pos="_pos")
    goals = goals.withColumnRenamed("source", "_source")
    joined = summed.join(small_side(goals, 256), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    before = F.col("_end") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    taken = (epochs * F.col("size") + part).cast("long").alias("taken")
    out = joined.select("doc_id", "size", "source_size", "target", taken, "_row_id")
    if not keep_row:
        return out.drop("_row_id")
    return out.join(stored.select("_row_id", "row"), "_row_id").drop("_row_id")


def _cut(text: Column, count: Column) -> Column:
    """The first ``count`` words of ``text`` with the white space between them as it is."""
    word = "[^\\x20\\x09-\\x0D]+"
    pieces = F.regexp_extract_all(text, F.lit("([\\x20\\x09-\\x0D]*" + word + ")"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, F.greatest(count, F.lit(0)).cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as its epochs say.

    The row at the cut of a source comes once more with its text cut after the last word the budget
    allows, and ``chars_col``, if there, counted anew. Rows that the budget leaves out are gone.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, keep_row=True, **settings)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    copies = plan.filter("taken > 0").select(
        "row", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("_words"))
    cut = _cut(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), F.col("_words"))
    copies = copies.withColumn("_cut", F.when(F.col("_words") >= 0, cut))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.when(F.col("_words") >= 0, F.col("_cut")).otherwise(value)
        elif c == chars_col:
            value = F.when(F.col("_words") >= 0, F.char_length("_cut").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return copies.select(*columns)
