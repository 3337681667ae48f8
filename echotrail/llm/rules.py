"""Quality rules that vote or abstain, weighed by expectation-maximisation: DataFrame functions only.

Each rule is a column that says good (1), bad (-1) or nothing (0) about a text. The corpus itself tells
how far each rule can be trusted: a latent-class model with one good and one bad class is fitted by
expectation-maximisation over the table of vote patterns, which holds every document, and a text stays
when its posterior probability of being good reaches one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import SPACES, name, text_of, unpacked, whole_row, words_of
from echotrail.session import cut_lineage, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 60
SETTLED = 1e-5


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are sorted by a 64-bit hash, so equal ones are neighbours; the start positions of repeated
    windows, in order, then give the covered words. Chance collisions are beyond any real text length.
    """
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))


def measures(df: DataFrame, text: Column) -> DataFrame:
    """Add the measures of the rules for ``text``, built in layers so that each array is made once."""
    one = df.withColumn("_text", text)
    one = one.withColumns({"_words": words_of(F.col("_text")), "_lines": F.split("_text", "\n")})
    one = one.withColumn("_solid", F.array_join("_words", ""))
    # Characters are counted as what is left of the words when runs of all others are gone, one match a run.
    only = lambda kept: F.char_length(F.regexp_replace("_solid", f"[^{kept}]+", "")).cast("long")
    one = one.withColumns({
        "n_words": F.size("_words"),
        "_lines": F.filter("_lines", lambda line: F.btrim(line, F.lit(SPACES)) != ""),
        "word_chars": F.char_length("_solid").cast("long"),
        "n_symbols": only("#*$%&|<>"),
        "n_letters": only("\\p{L}"),
        "n_upper": only("\\p{Lu}"),
        "n_cries": only("!?"),
        "n_ends": F.regexp_count("_text", F.lit("[.!?\\u2026\\u3002](?=[\\x20\\x09-\\x0D]|$)")).cast("long"),
        "n_bare": F.regexp_count("_text", F.lit("(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])")).cast("long"),
    })
    one = one.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": _repeat_words(F.col("_words"), F.col("n_words")),
    })
    w = F.col("_windows")
    one = one.withColumn("_again", F.sort_array(F.transform(F.filter(w, lambda x, i: (
        (F.get(w, i - 1)["h"] == x["h"]) | (F.get(w, i + 1)["h"] == x["h"]))), lambda x: x["p"])))
    again = F.col("_again")
    one = one.withColumn("n_repeat_words", F.aggregate(
        F.transform(again, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(again, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x).cast("long"))
    return one.withColumn("n_words", F.col("n_words").cast("long")).drop("_text", "_words", "_lines", "_solid", "_windows", "_again")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_letters", "n_upper", "n_cries", "n_ends", "n_bare", "n_lines", "n_dup_lines", "n_repeat_words"]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules by name, over the measures. Bounds are shares of words, letters or lines, so they hold for any length."""
    n, letters = F.col("n_words"), F.col("n_letters")
    return {
        "symbols": _vote(F.col("n_symbols") * 20 <= n, F.col("n_symbols") * 4 > n),
        "capitals": _vote(F.col("n_upper") * 5 <= letters, F.col("n_upper") * 2 > letters),
        "cries": _vote(F.col("n_cries") * 20 <= n, F.col("n_cries") * 4 > n),
        "repeats": _vote(F.col("n_repeat_words") * 10 <= n, F.col("n_repeat_words") * 3 > n),
        "lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 4 > F.col("n_lines")),
        "bare": _vote(F.col("n_bare") * 50 <= n, F.col("n_bare") * 5 > n),
        "sentences": _vote((F.col("n_ends") * 60 >= n) & (F.col("n_ends") * 2 <= n), (F.col("n_ends") * 200 < n) | (F.col("n_ends") * 10 > n * 7)),
        "letters": _vote(letters * 100 >= F.col("word_chars") * 85, letters * 100 < F.col("word_chars") * 65),
        "word_length": _vote((F.col("word_chars") >= n * 3) & (F.col("word_chars") <= n * 12), (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20)),
        "length": _vote(n >= 100, n < MIN_WORDS),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Model:
    """Share of good texts and, per rule, how often it says bad of a good and of a bad text."""

    prior: float
    false_alarm: dict[str, float]
    hit: dict[str, float]

    def posterior(self) -> Column:
        """Probability that a row is good, as a column over the votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.hit:
            fa, hit = self.false_alarm[rule], self.hit[rule]
            odds = odds + F.when(F.col(rule) < 0, math.log(fa / hit)).when(F.col(rule) > 0, math.log((1 - fa) / (1 - hit))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over ``patterns``: one row per vote pattern with its count ``n``.

    A rule has three votes, so there are at most 3 ** rules patterns, whatever the corpus: the driver reads
    that bounded table once and does the rounds on it. One document of pretended evidence per vote keeps all
    probabilities inside (0, 1), and a rule's false alarms are held below its hits, so the classes cannot
    swap names. An empty table gives the starting model.
    """
    table = patterns.select("n", *rules).collect()
    if len(table) > 3 ** len(rules):
        raise ValueError("more vote patterns than there can be")
    n = np.array([r["n"] for r in table], dtype=float)
    cast = np.array([[r[x] for x in rules] for r in table], dtype=float).reshape(len(table), len(rules))
    bad, any_vote = (cast < 0).astype(float), (cast != 0).astype(float)
    good = np.choose(np.minimum(bad.sum(axis=1), 2).astype(int), [0.95, 0.4, 0.05])
    model: Model | None = None
    for _ in range(rounds):
        fine, poor = n * good, n * (1 - good)
        prior = min(0.99, max(0.5, (fine.sum() + 1) / (n.sum() + 2)))
        alarm = np.clip((fine @ bad + 0.01) / (fine @ any_vote + 1), 1e-4, 0.2)
        hit = np.minimum(0.98, np.maximum((poor @ bad + 0.3) / (poor @ any_vote + 1), alarm))
        new = Model(float(prior), dict(zip(rules, map(float, alarm))), dict(zip(rules, map(float, hit))))
        moved = 1.0 if model is None else max(
            abs(new.prior - model.prior), *(abs(new.hit[r] - model.hit[r]) for r in rules), *(abs(new.false_alarm[r] - model.false_alarm[r]) for r in rules))
        model = new
        if moved < SETTLED:
            break
        odds = math.log(prior / (1 - prior)) + bad @ np.log(alarm / hit) + (any_vote - bad) @ np.log((1 - alarm) / (1 - hit))
        good = 1 / (1 + np.exp(-odds))
    return model


def judged(measured: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``posterior`` and ``kept`` to a stored table with the measures."""
    rules = votes()
    voted = measured.withColumns(rules)
    patterns = cut_lineage(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    model = fit(patterns, list(rules))
    return voted.withColumns({"base_failed": base_failed(), "posterior": F.round(model.posterior(), 6)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*rules)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict, one row per input row.

    Null text is a text without words: all measures are 0 and it fails the base rule. Repeated rows are
    judged alike and each counts. An empty table gives an empty result; other columns are ignored.
    """
    df = docs.select(name(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    measured = written(measures(df, F.col("t")).select("doc_id", *MEASURES))
    return judged(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose verdict is ``kept``, with all columns of ``docs``; texts are measured once."""
    rows = docs.select(whole_row(docs))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    measured = written(measures(rows, text).select("row", *MEASURES))
    return unpacked(judged(measured).filter("kept"), docs.columns)
