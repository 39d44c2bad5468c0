"""Queries that run a stream over a table; SQL says the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.storage import work_path
from tessella.streaming import requests

S = SparkSession


def _events(spark: S, d: str) -> DataFrame:
    """The events table as a stream of one file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query('SELECT user_id % 20 AS viewer, max(event_id) AS event_id, arg_max((event_id * 7919) % 3000000, event_id) AS "offset" FROM events GROUP BY 1')
def stream_latest_wins(spark: S, d: str) -> DataFrame:
    rows = _events(spark, d).select((F.col("user_id") % 20).alias("viewer"), "event_id", (F.col("event_id") * 7919 % 3000000).alias("offset"))
    return requests.run_available(requests.newest(rows, "viewer", "event_id"), work_path(spark, "latest"), "complete")
