"""Embedding hooks: any column function or pandas/Arrow UDF from text to a vector can be plugged in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.functions import vectors as vx

Embed = Callable[[Column], Column]


def embed_corpus(docs: DataFrame, embed: Embed = vx.hash_embedding, unit: bool = True) -> DataFrame:
    """Add ``embedding``, ``entropy`` and the text digest that tells later runs what has changed."""
    vector = embed(F.coalesce("text", F.lit("")))
    out = docs.withColumn("embedding", vx.unit(vx.doubles(vector)) if unit else vector)
    return out.withColumn("entropy", vx.vector_entropy(F.col("embedding"))).withColumn("text_digest", F.sha2("text", 256))


def refresh_embeddings(docs: DataFrame, stored: DataFrame, embed: Embed = vx.hash_embedding) -> DataFrame:
    """Vectors of ``docs(doc_id, text)``, embedding only texts that are new or changed since ``stored``."""
    digest = docs.withColumn("text_digest", F.sha2("text", 256))
    kept = stored.join(digest.select("doc_id", "text_digest"), ["doc_id", "text_digest"], "left_semi")
    changed = digest.join(stored.select("doc_id", "text_digest"), ["doc_id", "text_digest"], "left_anti").drop("text_digest")
    columns = ["doc_id", "embedding", "entropy", "text_digest"]
    return kept.select(*columns).unionByName(embed_corpus(changed, embed).select(*columns))


def record_pairs(docs: DataFrame, local: Embed, cloud: Embed) -> DataFrame:
    """Local and cloud vectors of each text, for alignment and the gated correction model.

    Rows whose cloud call returned nothing are left out.
    """
    pairs = docs.select("doc_id", local(F.col("text")).alias("local"), cloud(F.col("text")).alias("cloud"))
    return pairs.filter(F.col("cloud").isNotNull())
