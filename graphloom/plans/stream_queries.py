"""Streaming queries, drained over the events that are there; their twins are plain batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as S
from .runtime import shared_dir

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _drained(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of a stream in update mode, as a table."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = S.KeyedTable(spark, f"{folder}/table", keys)
    last = []

    def upsert(batch: DataFrame, batch_id: int) -> None:
        table.replace(batch, batch_id)
        last.append(batch_id)

    S.drain(stream, upsert, f"{folder}/checkpoint")
    return table.read(max(last)) if last else spark.createDataFrame([], stream.schema)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.read_events(spark, d)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def events_tumbling(spark, d):
    return _plain(_drained(spark, S.tumbling(_events(spark, d)), ["start", "event_type"]))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start, event_type, value FROM events)
 SELECT start, start + INTERVAL 2 DAY AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2, 3""")
def events_sliding(spark, d):
    return _plain(_drained(spark, S.sliding(_events(spark, d)), ["start", "event_type"]))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first FROM events),
 s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def events_session(spark, d):
    """Sessions need append mode on a stream, which holds back open ones; the batch form of the same operator gives all."""
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _plain(S.sessions(events))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def incremental_upsert(spark, d):
    per = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return _drained(spark, per, ["user_id"])


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
