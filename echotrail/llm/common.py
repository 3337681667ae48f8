"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.session import prepare

# White space that separates words everywhere in this subpackage.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\u000b\f\r"

# Rows that Spark hands to a Python worker at once. Texts may be long, so this is what bounds a worker's memory.
ROWS_PER_BATCH = 1000


def text_session(spark: SparkSession) -> SparkSession:
    """The session with batches of texts kept small, unless they are smaller already."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_PER_BATCH:
        spark.conf.set(setting, str(ROWS_PER_BATCH))
    return prepare(spark)


def name(column: str) -> Column:
    """A column by its exact name, also with dots or blanks in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it cannot clash with theirs."""
    return F.struct(*[name(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row`` again."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(name(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
