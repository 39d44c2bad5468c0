"""Queries on texts: numbers, sizes, keys and messages as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import views
from tessella.plans.registry import query

S = SparkSession


def _strip(number: str) -> str:
    """SQL: a decimal text without zeros at its end."""
    return f"rtrim(rtrim({number}, '0'), '.')"


def _fixed(v: str, digits: int) -> str:
    n = f"floor({v} * {10**digits}.0::DOUBLE + 0.5::DOUBLE)::BIGINT"
    return f"({n})::VARCHAR" if not digits else f"(({n}) // {10**digits})::VARCHAR || '.' || lpad((({n}) % {10**digits})::VARCHAR, {digits}, '0')"


def _rational(num: str, den: str) -> str:
    return f"CASE WHEN {den} IS NULL OR {den} = 0 THEN {num}::DOUBLE ELSE floor({num} / {den}::DOUBLE * 1000 + 0.5::DOUBLE) / 1000 END"


_RES = "(SELECT p_partkey, p_partkey * 7 % 5000 + 1 AS xn, p_size % 4 AS xd, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 11 % 900 END AS yn, CASE WHEN p_partkey % 3 > 0 THEN 1 + p_size % 3 END AS yd, 1 + p_partkey % 4 AS unit FROM part)"


@query(f"""SELECT p_partkey, x || ' × ' || coalesce(y, x) || CASE unit WHEN 2 THEN ' dpi' WHEN 3 THEN ' px/cm' ELSE '' END AS shown FROM (SELECT p_partkey, unit, {_strip(_fixed(f'({_rational("xn", "xd")})', 3))} AS x,
    {_strip(_fixed(f'({_rational("yn", "yd")})', 3))} AS y FROM {_RES} r)""")
def resolution_texts(spark: S, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    some = k % 3 > 0
    rows = views.table(spark, d, "part").select(k, (k * 7 % 5000 + 1).alias("xn"), (size % 4).alias("xd"), F.when(some, k * 11 % 900).alias("yn"), F.when(some, 1 + size % 3).alias("yd"), (1 + k % 4).alias("unit"))
    return rows.select("p_partkey", text.resolution("xn", "xd", "yn", "yd", "unit").alias("shown"))


_SIZE = "(SELECT doc_id, n_chars * (doc_id % 5 * 70001 + 1) * (1 + doc_id % 3 * 9999) AS n FROM documents)"


@query(f"""SELECT doc_id, n, CASE WHEN u = 0 THEN n::VARCHAR WHEN v < 10 THEN {_fixed('v', 2)} ELSE {_fixed('v', 1)} END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] AS shown
    FROM (SELECT doc_id, n, u, n / (1024.0::DOUBLE ** u) AS v FROM (SELECT doc_id, n, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS u FROM {_SIZE} q))""")
def byte_texts(spark: S, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = views.table(spark, d, "documents").select(k, (F.col("n_chars") * (k % 5 * 70001 + 1) * (1 + k % 3 * 9999)).alias("n"))
    return rows.select("doc_id", "n", text.byte_text("n").alias("shown"))


_NUMBER = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey::DOUBLE WHEN 1 THEN p_partkey / 7.0::DOUBLE WHEN 2 THEN -(p_partkey * 100003) / 13.0::DOUBLE WHEN 3 THEN p_partkey / 3.0e9::DOUBLE ELSE 'nan'::DOUBLE END AS x FROM part)"


@query(f"""SELECT p_partkey, CASE WHEN isnan(x) THEN 'NaN' WHEN x = floor(x) THEN x::BIGINT::VARCHAR WHEN e < -6 THEN {_strip("split_part(t, 'e', 1)")} || 'e-' || -e ELSE {_strip('t::DOUBLE::DECIMAL(38, 11)::VARCHAR')} END AS shown
    FROM (SELECT p_partkey, x, t, CASE WHEN isnan(x) THEN 0 ELSE split_part(t, 'e', 2)::INT END AS e FROM (SELECT p_partkey, x, CASE WHEN isnan(x) THEN '0' ELSE format('{{:.5e}}', x) END AS t FROM {_NUMBER} q))""")
def number_texts(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 5 == 0, k.cast("double")).when(k % 5 == 1, k / F.lit(7.0)).when(k % 5 == 2, -(k * 100003) / F.lit(13.0)).when(k % 5 == 3, k / F.lit(3.0e9)).otherwise(F.lit(float("nan")))
    return views.table(spark, d, "part").select("p_partkey", text.number_text(x).alias("shown"))


@query(f"SELECT doc_id, CASE WHEN p < 10 THEN {_fixed('p', 1)} ELSE floor(p)::BIGINT::VARCHAR END AS progress, CASE WHEN p < 10 THEN {_fixed('p', 1)} ELSE floor(p + 0.5::DOUBLE)::BIGINT::VARCHAR END AS zoom FROM (SELECT doc_id, (doc_id * 37 % 1000) / 10.0::DOUBLE + 0.03::DOUBLE AS p FROM documents)")
def percent_texts(spark: S, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 37 % 1000) / F.lit(10.0) + F.lit(0.03)).alias("p"))
    return rows.select("doc_id", text.percent_text("p").alias("progress"), text.percent_text("p", zoom=True).alias("zoom"))


_KEYS = "(SELECT event_id, event_id % 9 AS z, event_id % 71 AS i, event_id % 53 AS j, event_id % 4 AS page, event_id % 900 AS x0, event_id % 700 AS y0 FROM events)"


@query(f"SELECT event_id, z || '/' || i || '/' || j AS tile, page || '|' || x0 || ',' || y0 || ',' || (x0 + 64) || ',' || (y0 + 32) || '|' || '64x32' AS region, i * 1000 + j AS parsed FROM {_KEYS} q")
def key_texts(spark: S, d: str) -> DataFrame:
    """Keys of tiles and regions, and what is read out of a tile's key again."""
    e = F.col("event_id")
    rows = views.table(spark, d, "events").select(e, (e % 9).alias("z"), (e % 71).alias("i"), (e % 53).alias("j"), (e % 4).alias("page"), (e % 900).alias("x0"), (e % 700).alias("y0"))
    keyed = rows.withColumn("tile", text.tile_key("z", "i", "j"))
    _, i, j = text.tile_of_key("tile")
    region = text.region_key("page", "x0", "y0", F.col("x0") + 64, F.col("y0") + 32, 64, 32)
    return keyed.select("event_id", "tile", region.alias("region"), (i * 1000 + j).alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Compression method ' || (34000 + event_id % 1000) || ' is not supported.' ELSE 'Block ' || event_id || ' is lost' END AS shown FROM events")
def error_texts(spark: S, d: str) -> DataFrame:
    e = F.col("event_id")
    message = F.when(e % 3 == 0, F.concat(F.lit("Error: Unknown compression method identifier: "), (34000 + e % 1000).cast("string"))).otherwise(F.concat(F.lit("Block "), e.cast("string"), F.lit(" is lost")))
    return views.table(spark, d, "events").select("event_id", message.alias("message")).select("event_id", text.error_text("message").alias("shown"))
