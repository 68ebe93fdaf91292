"""Commit history, coverage, changelog and sliding-window usage limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import dealt, parts

MINUTE, DAY = 60, 86_400
RPM, RPD = 10, 1000
COMMIT_LIMIT = 100


def recent_commits(commits: DataFrame, authors: DataFrame, limit: int = COMMIT_LIMIT) -> DataFrame:
    """The newest commits with their author's name, "Unknown" if there is none; of several authors the last counts."""
    by = authors.groupBy("commit_id").agg(F.max_by("author_name", "ord").alias("author_name"))
    top = commits.orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)
    return top.join(by, "commit_id", "left").select("commit_id", "ts", F.coalesce("author_name", F.lit("Unknown")).alias("author_name"))


def entity_history(modified: DataFrame, commits: DataFrame, entity_id: str) -> DataFrame:
    """Commits that changed an entity, with insertions and deletions of that change."""
    return modified.filter(F.col("entity_id") == entity_id).join(commits, "commit_id").select("commit_id", "ts", "insertions", "deletions")


def modified_by_author(modified: DataFrame, authors: DataFrame) -> DataFrame:
    """Per author: commits, files touched (distinct) and lines inserted.

    Each distinct count has pairs of its own, so that no change is repeated for every
    count, and tasks by the size of ``modified``, so that none has more to sort or group
    as the table grows.
    """
    n = parts(modified)
    of = dealt(authors.select("commit_id", "author_name"), n, "commit_id")
    commits = of.join(dealt(modified.select("commit_id"), n, "commit_id"), "commit_id", "left_semi").distinct()
    touched = dealt(modified.select("commit_id", "entity_id", "insertions"), n, "commit_id").join(of, "commit_id").select("author_name", "entity_id", "insertions")
    touched = dealt(touched, n, "author_name", "entity_id").groupBy("author_name", "entity_id").agg(F.sum("insertions").alias("insertions"))
    n_commits = commits.groupBy("author_name").agg(F.count("*").alias("n_commits"), F.lit(0).cast("long").alias("n_files"), F.lit(None).cast(touched.schema["insertions"].dataType).alias("insertions"))
    n_files = touched.groupBy("author_name").agg(F.lit(0).cast("long").alias("n_commits"), F.count("entity_id").alias("n_files"), F.sum("insertions").alias("insertions"))
    return n_commits.unionByName(n_files).groupBy("author_name").agg(*[F.sum(c).alias(c) for c in ("n_commits", "n_files", "insertions")])


def parse_commits(lines: DataFrame) -> DataFrame:
    """(sha, author, day, type, scope, description) of ``hash|author|date|subject`` lines; lines with fewer parts go."""
    bits = F.split("value", r"\|", 4)
    subject = F.trim(bits[3])
    pattern = r"^(\w+)(?:\(([^)]*)\))?:\s*(.*)$"
    out = lines.filter(F.size(bits) >= 4).select(bits[0].alias("sha"), bits[1].alias("author"), bits[2].alias("day"), subject.alias("subject"))
    typed = F.col("subject").rlike(pattern)
    return out.select(
        "sha",
        "author",
        "day",
        F.when(typed, F.regexp_extract("subject", pattern, 1)).otherwise("other").alias("type"),
        F.when(typed, F.regexp_extract("subject", pattern, 2)).otherwise("").alias("scope"),
        F.when(typed, F.regexp_extract("subject", pattern, 3)).otherwise(F.col("subject")).alias("description"),
    )


def changelog(commits: DataFrame) -> DataFrame:
    """Commits grouped by type: count and the descriptions in order."""
    return commits.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("descriptions"))


def coverage_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.0, "high").when(ratio >= 0.6, "medium").otherwise("low")


def coverage(covered: DataFrame, *keys: str) -> DataFrame:
    """Per key: hits as covered/valid, the line rate, and its level."""
    sums = covered.groupBy(*keys).agg(F.sum("covered").alias("c"), F.count("*").alias("v"))
    rate = F.col("c") / F.col("v")
    return sums.select(*keys, F.concat_ws("/", F.col("c").cast("string"), F.col("v").cast("string")).alias("hits"), F.round(rate, 4).alias("line_rate"), coverage_level(rate).alias("level"))


def _earlier(seconds: int) -> Column:
    """Requests of the same model strictly less than ``seconds`` before this one, itself and later ones left out."""
    micros = F.unix_micros("ts")
    return F.count("*").over(Window.partitionBy("model").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, -1))


def usage_counts(usage: DataFrame) -> DataFrame:
    """Each request with the number of earlier ones in the last minute and day, and whether it was allowed."""
    counted = usage.withColumn("in_minute", _earlier(MINUTE)).withColumn("in_day", _earlier(DAY))
    return counted.withColumn("allowed", (F.col("in_minute") < RPM) & (F.col("in_day") < RPD))


def availability(usage: DataFrame, now: str, rpm: int = RPM, rpd: int = RPD) -> DataFrame:
    """Per model the requests strictly within the last minute and day before ``now``, and whether it may be called."""
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    age = at - F.unix_micros("ts")
    per = usage.groupBy("model").agg(F.count(F.when(age < MINUTE * 1_000_000, 1)).alias("in_minute"), F.count(F.when(age < DAY * 1_000_000, 1)).alias("in_day"))
    return per.withColumn("available", (F.col("in_minute") < rpm) & (F.col("in_day") < rpd))


def first_available(models: DataFrame, state: DataFrame) -> DataFrame:
    """The first model by priority that may be called: failover without calls."""
    open_ = models.join(state.filter(~F.col("available")), "model", "left_anti")
    return open_.agg(F.min_by("model", "priority").alias("model"))


def prune(usage: DataFrame, now: str, seconds: int = DAY) -> DataFrame:
    """Requests strictly younger than ``seconds`` at ``now``."""
    return usage.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts") < seconds * 1_000_000)
