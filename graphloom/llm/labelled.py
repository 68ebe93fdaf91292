"""Bounded samples of labelled documents for fitting, and the folds that are held out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, at most, and the
#: longest text (characters) among them. Scoring has no such bounds.
FIT_ROWS = 2000
FIT_CHARS = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    """True where the row is never learned from; a null id counts as held out."""
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(True))


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, fold: int, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> pd.DataFrame:
    """At most ``2 * rows`` pairs (text, label) from outside the held-out fold, the same for the same tables.

    Labels other than 0 and 1 are ignored; of repeated labels for one id the larger counts.
    Ids are chosen from the labels alone (in hash order), so the texts are scanned once
    against a list of bounded size.
    """
    known = labels.select(F.col("doc_id").alias("k"), F.col(target).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y")).filter(~held_out(F.col("k"), modulus, fold))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("y") == label).orderBy(F.xxhash64("k"), "k").limit(rows)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("d") == F.col("k")).filter(F.length("text") <= chars)
    return found.select("text", "y", "d").orderBy(F.xxhash64("d"), "d", "text").limit(2 * rows).select("text", "y").toPandas()
