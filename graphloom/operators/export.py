"""Exports of the graph as Markdown and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def markdown_index(e: DataFrame) -> DataFrame:
    """Per file a Markdown section of its functions, classes and methods by line, each with the first line of its docstring."""
    doc = X.first_line(F.coalesce("docstring", F.lit("")))
    shown = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("qualified_name"), F.when(doc != "", F.concat(F.lit(": "), doc)).otherwise(""))
    rows = e.filter(F.col("kind").isin("function", "class", "method")).select("file", F.struct("line", "ord", shown.alias("text")).alias("row"))
    return rows.groupBy("file").agg(F.concat(F.lit("## "), F.col("file"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["text"]), "\n")).alias("markdown"))


def relationship_json(r: DataFrame) -> DataFrame:
    """One JSON object per edge."""
    return r.select(F.to_json(F.struct("source_id", "target_id", "kind")).alias("json"))
