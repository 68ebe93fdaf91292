"""Sections of Markdown texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = r"^(#{1,6})\s+(.+)$"


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per heading: line_start, level, title, line_end, parent_line (null at the top).

    Lines inside code fences count like any other. A section ends before the next heading
    of its level or a higher one. A document's own headings are compared within one array,
    so no join is needed.
    """
    lines = F.split(text, "\n")
    shape = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_start"), F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), F.trim(F.regexp_extract(x, _HEADING, 2)).alias("title")))
    found = docs.select(key, F.size(lines).alias("total"), F.filter(shape, lambda h: h["level"] > 0).alias("h"))
    at = found.select(key, "total", "h", F.explode("h").alias("x")).select(key, "total", "h", "x.*")
    later = F.array_min(F.transform(F.filter("h", lambda o: (o["line_start"] > F.col("line_start")) & (o["level"] <= F.col("level"))), lambda o: o["line_start"]))
    above = F.array_max(F.transform(F.filter("h", lambda o: (o["line_start"] < F.col("line_start")) & (o["level"] < F.col("level"))), lambda o: o["line_start"]))
    return at.select(key, F.col("line_start"), "level", "title", F.coalesce(later - 1, F.col("total")).alias("line_end"), above.alias("parent_line"))
