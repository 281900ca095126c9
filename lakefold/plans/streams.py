"""Streaming queries over the events, run to the end of the input, and their batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.session import shared_dir
from lakefold.sources import table
from lakefold.streaming import events as E
from lakefold.streaming.indicators import online_ema


def _stream(spark: SparkSession, root: str) -> DataFrame:
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    return E.file_stream(spark, root, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    place = _place(spark, name)
    E.drain(stream, f"{place}/out", f"{place}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


LATE = "10 minutes"


def _windows(spark: SparkSession, root: str, make, name: str, start: str) -> DataFrame:
    """A windowed stream run to the end of its input, the last windows included."""
    out = E.drain_to_end(_stream(spark, root), make, "ts", start, _place(spark, name))
    return out.withColumn(start, F.col(start).cast("timestamp_ntz"))


def stream_tumbling(spark, root):
    """Counts per hour and type."""
    out = _windows(spark, root, lambda s: E.tumbling(s, "ts", "1 hour", ["event_type"], LATE), "tumbling", "window_start")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, root):
    out = _windows(spark, root, lambda s: E.tumbling(s, "ts", "2 hours", ["event_type"], LATE, "1 hour"), "sliding", "window_start")
    return out.select("window_start", "event_type", "n")


def stream_session(spark, root):
    return _windows(spark, root, lambda s: E.sessions(s, "ts", "30 minutes", "user_id", LATE), "session", "session_start").select("user_id", "session_start", "n")


def stream_dedup(spark, root):
    """The users and types of each day, each once; what is remembered ends a day behind the newest event."""
    s = _stream(spark, root).withColumn("day", F.to_date("ts"))
    return _run(spark, E.first_seen(s, "ts", ["user_id", "event_type", "day"], "1 day"), "dedup").select("user_id", "event_type", "day")


def stream_upsert(spark, root):
    """The newest event of each user, kept by upserts."""
    place = _place(spark, "upsert")
    stream = _stream(spark, root).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    E.drain_batches(stream, E.upsert(spark, f"{place}/t", ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]), f"{place}/checkpoint")
    return E.newest_version(spark, f"{place}/t", stream.schema).select("user_id", "event_id", "event_type")


def stream_ema(spark, root):
    """The running mean of each user's values, span 9, kept as state; the last of each user."""
    table(spark, root, "events")
    out = _run(spark, online_ema(_stream(spark, root), "user_id", "ts", "value", 9), "ema")
    return out.groupBy("user_id").agg(F.round(F.max_by("ema", "ts"), 6).alias("ema"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_upsert, stream_ema)}
SQL = {
    "stream_tumbling": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sliding": """with w as (select date_trunc('hour', ts) - interval (unnest([0, 1])) hour as window_start, event_type from events)
        select window_start, event_type, count(*) as n from w group by 1, 2""",
    "stream_session": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select *, sum(new) over (partition by user_id order by ts) as k from g)
        select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""",
    "stream_ema": """with r as (select user_id, value, row_number() over (partition by user_id order by ts) as rn from events)
        select user_id, round(sum(value * pow(0.8, -rn)) / sum(pow(0.8, -rn)), 6) as ema from r group by 1""",
    "stream_dedup": "select distinct user_id, event_type, ts::date as day from events",
    "stream_upsert": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
}
