"""Git history, coverage reports, usage files and ground truth."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``git log --numstat --format=%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f`` writes what git_log() reads.
GIT_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f"


def missing(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)


def error_rows(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "path string, error string")


def git_log(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """commit, author, email, ts, message, files array<struct<path,insertions,deletions>> of an exported log, newest first."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\x1e")).alias("record")).filter("trim(record) <> ''")
    bits = F.split("record", "\x1f")
    stats = F.filter(F.split(bits[5], "\n"), lambda x: F.trim(x) != "")
    file = F.transform(stats, lambda x: F.struct(F.split(x, "\t")[2].alias("path"), F.coalesce(F.split(x, "\t")[0].try_cast("int"), F.lit(0)).alias("insertions"), F.coalesce(F.split(x, "\t")[1].try_cast("int"), F.lit(0)).alias("deletions")))
    out = records.select(bits[0].alias("commit"), bits[1].alias("author"), bits[2].alias("email"), F.timestamp_seconds(bits[3].cast("long")).alias("ts"), F.trim(bits[4]).alias("message"), file.alias("files"))
    return out.orderBy(F.desc("ts"), F.desc("commit")).limit(limit)


def _module_id(root: str, path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    bare = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.concat(F.lit(root.rstrip("/") + "/"), path, F.lit("::"), bare)


def history_graph(log: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of a log: commits and authors; authored, modified (with line counts) and changed_by."""
    commit, author = F.concat(F.lit("commit::"), "commit"), F.concat(F.lit("author::"), "email")
    none = F.lit(None).cast("string")
    people = log.select(author.alias("id"), F.lit("author").alias("kind"), F.col("author").alias("name"), F.col("email").alias("qualified_name"), none.alias("docstring"), F.create_map(F.lit("email"), F.col("email")).alias("metadata")).dropDuplicates(["id"])
    seconds = F.unix_seconds("ts").cast("string")
    commits = log.select(commit.alias("id"), F.lit("commit").alias("kind"), F.substring("commit", 1, 7).alias("name"), F.col("commit").alias("qualified_name"), F.col("message").alias("docstring"), F.create_map(F.lit("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("timestamp"), seconds).alias("metadata"))
    empty = F.create_map().cast("map<string,string>")
    authored = log.select(author.alias("source_id"), commit.alias("target_id"), F.lit("authored").alias("kind"), empty.alias("metadata"))
    files = log.select("commit", F.explode("files").alias("f"))
    module = _module_id(root, F.col("f.path"))
    counts = F.create_map(F.lit("insertions"), F.col("f.insertions").cast("string"), F.lit("deletions"), F.col("f.deletions").cast("string"))
    modified = files.select(commit.alias("source_id"), module.alias("target_id"), F.lit("modified").alias("kind"), counts.alias("metadata"))
    changed = files.select(module.alias("source_id"), commit.alias("target_id"), F.lit("changed_by").alias("kind"), empty.alias("metadata"))
    return people.unionByName(commits), authored.unionByName(modified).unionByName(changed)


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """report, changed, tag, has (attributes) of the root and the classes of XML reports; a report that is not well-formed is one row with tag "error"."""

    def read(text: str) -> list[tuple[str, dict[str, str]]]:
        try:
            top = ElementTree.fromstring(text)
        except ElementTree.ParseError as e:
            return [("error", {"error": str(e)})]
        return [(top.tag, top.attrib)] + [("class", c.attrib) for c in top.iter("class")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = read(text)
                of = pa.array([k] * len(found))
                has = pa.array([list(x.items()) for _, x in found], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([t for t, _ in found]), has], ["report", "changed", "tag", "has"])

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.unix_seconds("_metadata.file_modification_time").cast("string").alias("changed"), "value")
    return text.mapInArrow(run, "report string, changed string, tag string, has map<string,string>")


def cobertura_errors(spark: SparkSession, path: str) -> DataFrame:
    """path, error of reports that are missing or not well-formed."""
    if missing(spark, path):
        return error_rows(spark, (path, f"Coverage file not found: {path}"))
    return _elements(spark, path).filter("tag = 'error'").select(F.col("report").alias("path"), F.element_at("has", "error").alias("error"))


def cobertura(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of Cobertura reports: the report; covers (rate and hits) and executed_by per class with a file name.

    Reports that are not well-formed give no rows here but one in ``cobertura_errors``.
    """
    found = _elements(spark, path)
    name = F.substring_index("report", "/", -1)
    report = F.concat(F.lit("coverage::"), name)

    def attribute(key: str, other: Column) -> Column:
        return F.coalesce(F.element_at("has", key), other)

    none = F.lit("0")
    meta = F.create_map(F.lit("timestamp"), attribute("timestamp", F.col("changed")), F.lit("line-rate"), attribute("line-rate", none), F.lit("branch-rate"), attribute("branch-rate", none))
    reports = found.filter("tag = 'coverage'").select(report.alias("id"), F.lit("coverage_report").alias("kind"), F.concat(F.lit("Coverage Report ("), name, F.lit(")")).alias("name"), name.alias("qualified_name"), meta.alias("metadata"))
    wide = found.filter("tag = 'class'").filter(F.coalesce(F.element_at("has", "filename"), F.lit("")) != "")
    module = _module_id(root, F.element_at("has", "filename"))
    hits = F.concat_ws("/", attribute("lines-covered", none), attribute("lines-valid", none))
    covers = wide.select(report.alias("source_id"), module.alias("target_id"), F.lit("covers").alias("kind"), F.create_map(F.lit("line-rate"), attribute("line-rate", none), F.lit("hits"), hits).alias("metadata"))
    ran = wide.select(module.alias("source_id"), report.alias("target_id"), F.lit("executed_by").alias("kind"), F.create_map().cast("map<string,string>").alias("metadata"))
    return reports, covers.unionByName(ran)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """model, ts of a usage file (JSON object of epoch lists); a corrupt file counts as empty."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("model", "times"))
    return lists.select("model", F.explode("times").alias("t")).select("model", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))


def record_usage(events: DataFrame, path: str) -> None:
    """Append (model, ts) to a log of requests with a folder for every day (UTC), so that nothing written is read again."""
    day = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd")
    events.select("model", "ts", day.alias("day")).write.mode("append").partitionBy("day").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """model, ts, day of the log; no rows where there is none yet."""
    schema = "model string, ts timestamp, day string"
    return spark.createDataFrame([], schema) if missing(spark, f"{path}/day=*") else spark.read.schema(schema).parquet(path)


def forget_usage(spark: SparkSession, path: str, now: datetime.datetime) -> int:
    """Delete the folders of days that ended 24 hours before ``now`` or earlier; how many. What a limit counts stays."""
    last = (now.astimezone(datetime.UTC) - datetime.timedelta(days=1)).strftime("%Y-%m-%d")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in files.globStatus(where) or [] if x.getPath().getName().removeprefix("day=") < last]
    return sum(files.delete(p, True) for p in old)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, query, id of an evaluation file: a JSON list of {query, expected_ids}."""
    rows = spark.read.schema("query string, expected_ids array<string>").json(path, multiLine=True)
    return rows.select(F.xxhash64("query").alias("qid"), "query", F.explode_outer("expected_ids").alias("id"))
