"""Fixtures with the cases every operator has to define."""

import hashlib
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
# Columns whose names operators also use inside.
CLASHING = ["row", "row_id", "digest", "kept", "n_words", "posterior", "size", "names", "doc", "root", "n", "order", "_text", "label"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    """Words that look like running text, the same for the same seed."""
    out = []
    for i in range(n):
        h = hashlib.md5(f"{seed}/{i}".encode()).hexdigest()
        out.append("".join(chr(97 + int(c, 16)) for c in h[: 3 + int(h[8], 16) % 6]) + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def edge_rows():
    """Null, empty, blank and very long texts, ties, repeated rows, null ids and sources."""
    long_text = prose("long", 30_000)
    same = prose("same", 120)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\u000b\f\r ", "en", "b", 7),
        (4, "one two three", "en", "a", 13),
        (5, same, "en", "a", len(same)),
        (6, same, "en", "b", len(same)),
        (7, same.replace(" ", "\n\n"), "en", None, None),
        (7, same.replace(" ", "\n\n"), "en", None, None),
        (8, same.upper(), "en", "c", len(same)),
        (9, same + " " + prose("tail", 6), "de", "c", None),
        (10, long_text, "en", "a", len(long_text)),
        (11, long_text[: len(long_text) // 2], "en", "d", None),
        (None, prose("nobody", 80), "en", "d", None),
        (12, "the the the " * 60, "en", "e", None),
        (13, "a b \U0001f600 é́  x " * 30, "xx", "\U0001f600", None),
    ]


def edge_docs(spark, rows=None):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def empty_docs(spark):
    return edge_docs(spark, [])


def whole_docs(spark):
    """The edge cases beside the documents of the smallest scale, whose ids follow theirs."""
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    return edge_docs(spark).unionByName(real, allowMissingColumns=True)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
