"""Queries of the text functions: over the documents, and over the turns of the conversations behind fixed openings, which hold what plain text lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import headings as H
from .views import documents, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def words_sql(column: str) -> str:
    """DuckDB's form of ``tokenize``."""
    spaced = f"regexp_replace(coalesce({column}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower(regexp_replace({spaced}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


def values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


@query(f"SELECT doc_id, len({words_sql('text')}) AS n_tokens, array_to_string({words_sql('text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, d):
    t = X.tokenize(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({words_sql('text')}) AS token FROM documents) GROUP BY 1")
def token_frequency(spark, d):
    return frequency(documents(spark, d), table(spark, d, "documents").select("doc_id"))


def frequency(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """token, n, n_docs: how often each token occurs, and in how many documents (distinct ids).

    ``ids`` are the ids of ``docs``. A document in one row counts its own distinct tokens,
    so that no pair of token and document is shuffled; only of ids in several rows are the
    pairs brought together.
    """
    several = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    repeated = None
    if not several.isEmpty():
        docs, repeated = docs.join(several, "doc_id", "left_anti"), docs.join(several, "doc_id", "left_semi")
    tokens = X.tokenize(F.col("text"))
    counted = lambda t, n, d: F.struct(t.alias("token"), F.lit(n).cast("long").alias("n"), d.cast("long").alias("n_docs"))
    own = F.when(F.col("doc_id").isNotNull(), 1).otherwise(0)
    both = F.concat(F.transform("tokens", lambda t: counted(t, 1, F.lit(0))), F.transform(F.array_distinct("tokens"), lambda t: counted(t, 0, F.col("own"))))
    rows = docs.select(own.alias("own"), tokens.alias("tokens")).select(F.explode(both).alias("t")).select("t.*")
    if repeated is not None:
        per = repeated.select("doc_id", F.explode(tokens).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
        rows = rows.unionByName(per.select("token", "n", F.lit(1).cast("long").alias("n_docs")))
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def opened(rows: list[tuple]) -> str:
    """SQL for conv_id, turn and t: every turn's text in ASCII behind the opening of its number (word boundaries differ beyond ASCII)."""
    return f"""(SELECT conv_id, turn, coalesce(o.t, '') || ' ' || regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g') AS t FROM conversations JOIN {values(rows)} o(k, t) ON o.k = (conv_id + turn) % {len(rows)} + 1)"""


def openings(spark, d, rows: list[tuple]):
    """The same in Spark; the openings are a list of constants, chosen by an index."""
    first = F.array(*[F.lit(text or "") for _, text in rows])
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.element_at(first, ((F.col("conv_id") + F.col("turn")) % len(rows) + 1).cast("int")), F.lit(" "), ascii_text).alias("t"))


CODE = [(1, "parseHTTPRequest user_name"), (2, "foo(bar); baz.qux! x"), (3, "Größe Ñandú snake_case_Name2"), (4, ""), (5, None)]


@query(f"SELECT conv_id, turn, array_to_string({words_sql('t')}, ' ') AS tokens FROM {opened(CODE)}")
def tokenize_code(spark, d):
    return openings(spark, d, CODE).select("conv_id", "turn", F.array_join(X.tokenize(F.col("t")), " ").alias("tokens"))


QUESTIONS = [
    (1, "Explain how the retrieval process works"),
    (2, "Why is the build broken? There is an error in the stack trace"),
    (3, "How do I add a new endpoint to the service_layer.Router"),
    (4, "Review the security of this commit since last week"),
    (5, "Where is KnowledgeGraph defined, and in which file"),
    (6, "hello there"),
    (7, "fix and update"),
    (8, "what's wrong with parse_file and load_index and some_very_long_name and another_one and one_more_name and six_names seven_names eight_names nine_names ten_names eleven_names"),
    (9, ""),
    (10, "list changes between versions"),
]


def _scores_sql() -> str:
    parts = {t: " + ".join(f"CASE WHEN regexp_matches(t, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for task, p, w in X.QUESTION_PATTERNS if task == t) for t in X.TASK_ORDER}
    return ", ".join(f"{e} AS s_{t}" for t, e in parts.items())


def _classify_sql() -> str:
    total = {t: sum(w for task, _, w in X.QUESTION_PATTERNS if task == t) for t in X.TASK_ORDER}
    union = " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS task, s_{t} AS s, {n} AS place, {total[t]}.0 AS total FROM p" for n, t in enumerate(X.TASK_ORDER))
    return f"""WITH p AS (SELECT conv_id, turn, {_scores_sql()} FROM {opened(QUESTIONS)}), u AS ({union}),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, place) AS n FROM u)
 SELECT a.conv_id, a.turn, CASE WHEN a.s = 0 THEN 'general' ELSE a.task END AS task, CASE WHEN a.s = 0 THEN 0.0 ELSE round(least(1.0, least(1.0, a.s::DOUBLE / (a.total * 0.5)) * (1 + (1 - b.s::DOUBLE / a.s) * 0.3)), 2) END AS confidence FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.n = 1 AND b.n = 2"""


@query(_classify_sql())
def classify_questions(spark, d):
    return openings(spark, d, QUESTIONS).select("conv_id", "turn", X.classify(F.col("t")).alias("c")).select("conv_id", "turn", "c.task", "c.confidence")


@query(f"""SELECT conv_id, turn, array_to_string(list_slice(list_filter(regexp_extract_all(t, '\\b[a-zA-Z_][a-zA-Z0-9_.]+\\b'), lambda w: length(w) > 3 AND NOT list_contains({list(X.STOPWORDS)}, lower(w))), 1, 10), ',') AS keywords FROM {opened(QUESTIONS)}""")
def extract_keywords(spark, d):
    return openings(spark, d, QUESTIONS).select("conv_id", "turn", F.array_join(X.keywords(F.col("t")), ",").alias("keywords"))


TITLES = [(1, "Getting Started"), (2, "API: v2.0 -- Übersicht!"), (3, "  snake_case  title "), (4, "---"), (5, "C++ & Rust")]


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {opened(TITLES)}")
def slugify(spark, d):
    return openings(spark, d, TITLES).select("conv_id", "turn", X.slugify(F.col("t")).alias("slug"))


MARKDOWN = [
    (1, "# Top\n\nIntro text.\n\n### Deep\nx\n## Next\n```\n# fenced\n```\n# Last"),
    (2, "no headings at all\n\nsecond"),
    (3, "```\ncode only\n```\n\n# H\n\nThe description here.\n"),
    (4, "## Same\na\n## Same\nb"),
]


#: A document for each conversation: a fixed opening, then each turn's text below a heading of its level.
_MARKDOWN = f"""(SELECT conv_id AS k, o.t || string_agg(chr(10) || repeat('#', (turn % 6)::INT + 1) || ' ' || role || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations JOIN {values(MARKDOWN)} o(k, t) ON o.k = conv_id % {len(MARKDOWN)} + 1 GROUP BY conv_id, o.t)"""


def _markdown(spark, d):
    first = F.array(*[F.lit(text) for _, text in MARKDOWN])
    level = F.expr("repeat('#', int(turn % 6) + 1)")
    piece = F.concat(F.lit("\n"), level, F.lit(" "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    whole = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("pieces"))
    return whole.select("k", F.concat(F.element_at(first, (F.col("k") % len(MARKDOWN) + 1).cast("int")), F.array_join(F.transform("pieces", lambda x: x["p"]), "")).alias("t"))


@query(f"""WITH l AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n, len(string_split(t, chr(10))) AS total FROM {_MARKDOWN}),
 h AS (SELECT k, n AS line_start, length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2)) AS title, total FROM l WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.+)$'))
 SELECT a.k, a.line_start, a.level, a.title, coalesce((SELECT min(b.line_start) - 1 FROM h b WHERE b.k = a.k AND b.line_start > a.line_start AND b.level <= a.level), a.total) AS line_end,
 (SELECT max(b.line_start) FROM h b WHERE b.k = a.k AND b.line_start < a.line_start AND b.level < a.level) AS parent_line FROM h a""")
def headings_tree(spark, d):
    return H.headings(_markdown(spark, d).withColumnRenamed("t", "text"), "k")


@query(f"""WITH p AS (SELECT k, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(t, '(?s)```.*?```', '', 'g'), ' ' || chr(10)), chr(10) || chr(10) || '+'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '' AND NOT starts_with(s, '#')) AS parts FROM {_MARKDOWN})
 SELECT k, parts[1][1:500] AS description FROM p""")
def first_paragraph(spark, d):
    return _markdown(spark, d).select("k", X.first_paragraph(F.col("t")).alias("description"))


@query("SELECT conv_id, turn, role, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS shown FROM conversations")
def query_preview(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", X.preview(F.col("text"), 200).alias("shown"))


@query("SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]'), lambda w: ceil(length(w) / 4))), 0)::BIGINT AS n_tokens FROM documents")
def count_tokens(spark, d):
    return documents(spark, d).select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"))
