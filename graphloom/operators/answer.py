"""Answers without a model, prompts by task, and changelog entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Instructions for a model by task; ``general`` is the default.
PROMPTS = {
    "explain": "Explain step by step how the code below works, with file and line references.",
    "debug": "Find the cause of the problem in the code below and propose a fix.",
    "extend": "Show where and how to add to the code below, in keeping with its patterns.",
    "review": "Review the code below for correctness, safety and speed.",
    "locate": "Say where in the code below the thing asked for is defined and used.",
    "general": "Answer the question from the code below.",
}
#: Commit types in the order of a changelog, with their headings.
SECTIONS = [("feat", "🚀 Features"), ("fix", "🐛 Fixes"), ("chore", "🔧 Maintenance"), ("docs", "📚 Documentation"), ("refactor", "🔨 Refactoring"), ("perf", "⚡ Performance"), ("test", "✅ Testing")]


def prompt(task: Column) -> Column:
    out = F.lit(PROMPTS["general"])
    for name, text in PROMPTS.items():
        out = F.when(task == name, text).otherwise(out)
    return out


def local_answer(task: Column, context: Column) -> Column:
    """The context with a heading that suits the task."""
    head = F.when(task == "locate", "**Found in codebase:**").when(task == "explain", "**Based on the codebase context:**").otherwise("**Relevant context from codebase:**")
    tail = F.when(task == "locate", "").otherwise("\n\n*Local answer; force the model for a longer one.*")
    return F.concat(head, F.lit("\n\n"), context, tail)


def confidence(commits: DataFrame) -> DataFrame:
    """One row: share of commits with a known type, and its level (all: high, 60 %: medium)."""
    known = F.avg(F.col("type").isin(*[t for t, _ in SECTIONS]).cast("double"))
    return commits.agg(F.coalesce(known, F.lit(0.0)).alias("share")).withColumn("level", F.when(F.col("share") >= 1.0, "high").when(F.col("share") >= 0.6, "medium").otherwise("low"))


def changelog_entry(commits: DataFrame, range_text: str, day: str) -> DataFrame:
    """One row of Markdown for parsed commits (at most the commit limit): focus, confidence and sections by type.

    Any fix makes the focus bug fixes, else any feature feature development.
    """
    line = F.concat(F.lit("* "), F.when(F.col("scope") != "", F.concat(F.lit("**"), "scope", F.lit(":** "))).otherwise(""), "description", F.lit(" (`"), "sha", F.lit("`)"))
    rank = F.lit(len(SECTIONS))
    title = F.lit("📦 Other Changes")
    for k, (t, heading) in enumerate(SECTIONS):
        rank, title = F.when(F.col("type") == t, k).otherwise(rank), F.when(F.col("type") == t, heading).otherwise(title)
    rows = commits.select(rank.alias("rank"), title.alias("title"), "type", "sha", line.alias("line"))
    parts = rows.groupBy("rank", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("#### "), "title", F.lit("\n"), "lines").alias("text")))), lambda x: x["text"]), "\n\n")
    has = lambda k: F.bool_or(F.col("rank") == k)
    focus = F.when(has(1), "Bug Fixes").when(has(0), "Feature Development").otherwise("Routine Maintenance")
    total = parts.agg(body.alias("body"), focus.alias("focus"), F.sum("n").alias("n")).join(confidence(commits))
    head = F.concat(F.lit(f"## [Unreleased] - {day}\n\n**Range:** `{range_text}`\n**Commit Count:** "), F.col("n").cast("string"), F.lit("\n**Confidence:** "), "level", F.lit("\n\n**Focus:** "), "focus", F.lit("\n\n"))
    return total.filter("n > 0").select(F.concat(head, "body").alias("markdown"))
