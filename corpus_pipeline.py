"""Corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Quality and toxicity classifiers drop what they reject, repeated lines go, one document
of each near-duplicate group stays, and what is left is packed into sequences.

Null texts count as empty. Rows with a null doc_id pass the filters like any other row;
duplicate handling leaves them alone. A document all of whose lines occur in earlier ones
leaves the line stage with no line left and is dropped there, as nothing of it remains; a
document that had no words from the start is kept. An empty table runs through and gives
no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import linededup, neardup, packing, quality, toxicity
from graphloom.llm.common import ROW_GROUP, shared_dir

WORD = r"[\p{L}\p{N}_]"  # a character of a word, in any script
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.5; the model is learned from the labelled documents of the input."""
    model = quality.fit(*_labelled(spark, sf_dir))
    return quality.score(docs, model, COLUMNS).filter("score >= 0.5").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.fit(*_labelled(spark, sf_dir))
    return toxicity.score(docs, model, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each less the lines that occur earlier, without those that lose their last word by it; n_chars is brought up to date."""
    left = linededup.deduplicate(docs)
    return left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifiers, MinHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the session's shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
