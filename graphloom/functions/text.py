"""Scalar functions on code and prose, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (task, pattern, weight); matched without regard to case, ties go to the earlier task.
QUESTION_PATTERNS = [
    ("explain", r"\b(explain|how\s+does|how\s+do|walk\s+through|step.by.step|describe|what\s+happens)\b", 10),
    ("explain", r"\b(flow|process|mechanism|works?|architecture)\b", 5),
    ("explain", r"\b(understand|overview|summary)\b", 3),
    ("debug", r"\b(debug|bug|error|exception|fail|crash|broken|issue|problem)\b", 10),
    ("debug", r"\b(why\s+(is|does|did|are)|what'?s?\s+wrong|not\s+working|causes?)\b", 8),
    ("debug", r"\b(fix|resolve|troubleshoot|diagnose)\b", 6),
    ("debug", r"\b(stack\s*trace|traceback|assertion)\b", 5),
    ("extend", r"\b(add|implement|create|build|extend|modify|change|update)\b", 8),
    ("extend", r"\b(how\s+(do\s+I|to|can\s+I|should\s+I))\b", 6),
    ("extend", r"\b(where\s+should|best\s+place|pattern|approach)\b", 5),
    ("extend", r"\b(new\s+(feature|endpoint|function|class|component))\b", 7),
    ("review", r"\b(review|audit|check|analyze|assess)\b", 10),
    ("review", r"\b(change[ds]?|diff|commit|what'?s?\s+new)\b", 6),
    ("review", r"\b(test\s*coverage|quality|security|performance)\b", 5),
    ("review", r"\b(since|between|compare|versus)\b", 3),
    ("locate", r"\b(where\s+(is|are|can\s+I\s+find)|find|locate|search)\b", 10),
    ("locate", r"\b(defined|declared|implemented|used|called|referenced)\b", 6),
    ("locate", r"\b(file|path|location|line)\b", 4),
    ("locate", r"\b(show\s+me|list|get)\b", 3),
]
#: Words that are no keywords of a question.
STOPWORDS = ("how", "what", "where", "when", "why", "who", "does", "did", "is", "are", "can", "will", "the", "a", "an", "in", "on", "at", "for", "to", "of", "and", "or")
TASK_ORDER = tuple(dict.fromkeys(task for task, _, _ in QUESTION_PATTERNS))


def tokenize(text: Column) -> Column:
    """Words of identifiers and prose, in order and with repeats: camel case and underscores split, lower case, longer than one."""
    spaced = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    words = F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.coalesce(F.filter(words, lambda w: F.length(w) > 1), F.array().cast("array<string>"))


def keywords(question: Column, most: int = 10) -> Column:
    """The first identifiers of a question that are longer than three characters and no stopwords."""
    found = F.regexp_extract_all(question, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_.]+)\b"), F.lit(1))
    kept = F.filter(found, lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*STOPWORDS))
    return F.slice(kept, 1, most)


def task_scores(question: Column) -> dict[str, Column]:
    """For each task the sum of the weights of its patterns that occur."""
    out: dict[str, Column] = {}
    for task, pattern, weight in QUESTION_PATTERNS:
        hit = F.when(F.rlike(question, F.lit(f"(?i){pattern}")), weight).otherwise(0)
        out[task] = out[task] + hit if task in out else hit
    return out


def classify(question: Column) -> Column:
    """struct(task, confidence): the best task, and its share of half the possible points, raised by up to 30 % for a clear lead."""
    scores = task_scores(question)
    possible = {t: sum(w for task, _, w in QUESTION_PATTERNS if task == t) for t in TASK_ORDER}
    ranked = F.array_sort(F.array(*[F.struct((-scores[t]).alias("minus"), F.lit(k).alias("place"), F.lit(t).alias("task"), F.lit(float(possible[t])).alias("possible")) for k, t in enumerate(TASK_ORDER)]))
    best, second = ranked[0], ranked[1]
    top = -best["minus"]
    base = F.least(F.lit(1.0), top / (best["possible"] * 0.5))
    lead = 1 - (-second["minus"]) / F.when(top > 0, top)
    sure = F.round(F.least(F.lit(1.0), base * (1 + lead * 0.3)), 2)
    none = top == 0
    return F.struct(F.when(none, "general").otherwise(best["task"]).alias("task"), F.when(none, 0.0).otherwise(sure).alias("confidence"))


def slugify(title: Column) -> Column:
    low = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def title_kind(kind: Column) -> Column:
    """Every part of a kind's name capitalised: config_key becomes Config_Key."""
    return F.array_join(F.transform(F.split(kind, "_"), lambda w: F.initcap(w)), "_")


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def first_line(text: Column, most: int = 80) -> Column:
    return F.substring(F.split(F.trim(text), "\n")[0], 1, most)


def first_paragraph(text: Column, most: int = 500) -> Column:
    """The first paragraph outside code fences that is no heading; null if there is none."""
    open_text = F.regexp_replace(text, r"(?s)```.*?```", "")
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(stripped(open_text), r"\n\n+"), stripped), lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    return F.when(F.size(parts) > 0, F.substring(parts[0], 1, most))


def import_lines(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x: F.startswith(F.trim(x), F.lit("import ")) | F.startswith(F.trim(x), F.lit("from "))), "\n")


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def listed(names: Column, most: int) -> Column:
    """``- name`` lines of the first few, then how many more there are."""
    shown = F.array_join(F.transform(F.slice(names, 1, most), lambda n: F.concat(F.lit("- "), n)), "\n")
    return F.when(F.size(names) > most, F.concat(shown, F.lit("\n... and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(shown)


# --- vectors ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


# --- token counting -----------------------------------------------------------------------------


def token_count(text: Column) -> Column:
    """Deterministic stand-in for a BPE counter: a token for every four characters of a word or number, and for each other sign.

    ``counted_with`` counts with a real encoder instead.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int"))


def truncate_tokens(text: Column, most: Column | int) -> Column:
    """The longest prefix of whole words that counts at most ``most`` tokens."""
    most = F.lit(most) if isinstance(most, int) else most
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\s*(?:[\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, w: Column) -> Column:
        n = acc["n"] + F.ceil(F.length(F.trim(F.regexp_replace(w, r"\s", " "))) / 4).cast("int")
        full = acc["full"] | (n > most)
        return F.struct(F.when(full, acc["n"]).otherwise(n).alias("n"), F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], w)).alias("kept"), full.alias("full"))

    return F.aggregate(parts, start, step)["kept"]


def window_count(length: Column, size: int, overlap: int) -> Column:
    """How many windows of ``size`` characters, each ``overlap`` before the end of the last, cover a text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    return F.when(length <= size, 1).otherwise(F.ceil((length - size) / (size - overlap)) + 1).cast("int")


class Counter(NamedTuple):
    """How tokens are counted, and a text cut to a number of them (a column)."""

    count: Callable[[Column], Column]
    truncate: Callable[[Column, Column], Column]


RULE = Counter(token_count, truncate_tokens)


def counted_with(encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> Counter:
    """Counting by an encoder, in Arrow batches; a null text counts as empty. Both functions are sent to the executors."""

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda x: len(encode(x)) if x else 0).astype("int32")

    @F.pandas_udf("string")
    def truncate(text: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([decode(encode(x)[: max(int(n), 0)]) if x else "" for x, n in zip(text, most, strict=True)], dtype=object)

    return Counter(count, truncate)
