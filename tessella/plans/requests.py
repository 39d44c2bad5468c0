"""Queries on events as a stream of requests: blocks, ranges, caches, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import requests as R
from tessella.operators import views
from tessella.plans.registry import query

S = SparkSession
_Q = "(SELECT event_id, ts, event_id // 100 AS generation, user_id % 20 AS viewer, (event_id * 7919) % 3000000 AS off, 500 + (event_id * 104729) % 20000 AS len, user_id % 20 AS path FROM events)"


def _q(spark: S, d: str) -> DataFrame:
    e = F.col("event_id")
    return views.table(spark, d, "events").select(
        "event_id", "ts", F.floor(e / 100).alias("generation"), (F.col("user_id") % 20).alias("viewer"), (e * 7919 % 3000000).alias("offset"), (500 + e * 104729 % 20000).alias("length"), (F.col("user_id") % 20).alias("path")
    )


_CLAMPED = f"(SELECT path, off, least(off + len, 2900000) - off AS len FROM {_Q} q WHERE least(off + len, 2900000) > off)"


@query(f"SELECT DISTINCT path, b AS block FROM {_CLAMPED} q, unnest(range(off // 65536, (off + len - 1) // 65536 + 1)) r(b) WHERE len < 16384")
def read_blocks(spark: S, d: str) -> DataFrame:
    return R.read_blocks(R.clamp_eof(_q(spark, d).withColumn("size", F.lit(2900000))), ["path"])


@query(f"""SELECT path, min(off) AS "offset", max(off + len) - min(off) AS length, count(*) AS parts FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY off, len ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT path, off, len, CASE WHEN off > coalesce(max(off + len) OVER (PARTITION BY path ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM {_CLAMPED} q)) GROUP BY path, island""")
def coalesce_uncapped(spark: S, d: str) -> DataFrame:
    return R.coalesce_uncapped(R.clamp_eof(_q(spark, d).withColumn("size", F.lit(2900000))), ["path"])


@query(f"""WITH RECURSIVE o AS (SELECT path, off AS s, off + len AS e, row_number() OVER (PARTITION BY path ORDER BY off, off + len) AS k FROM {_Q} q),
    m AS (SELECT path, k, s, e, 1::BIGINT AS island FROM o WHERE k = 1 UNION ALL
      SELECT o.path, o.k, CASE WHEN o.s <= m.e AND greatest(m.e, o.e) - m.s <= 100000 THEN m.s ELSE o.s END, CASE WHEN o.s <= m.e AND greatest(m.e, o.e) - m.s <= 100000 THEN greatest(m.e, o.e) ELSE o.e END,
      m.island + CASE WHEN o.s <= m.e AND greatest(m.e, o.e) - m.s <= 100000 THEN 0 ELSE 1 END FROM m JOIN o ON o.path = m.path AND o.k = m.k + 1)
    SELECT path, min(s) AS "offset", max(e) - min(s) AS length, count(*) AS parts FROM m GROUP BY path, island""")
def coalesce_capped(spark: S, d: str) -> DataFrame:
    return R.coalesce_capped(_q(spark, d), ["path"], 100000)


@query(f"SELECT viewer, id, used, bytes, total::BIGINT AS total FROM (SELECT *, sum(bytes) OVER (PARTITION BY viewer ORDER BY used DESC ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT viewer, event_id % 97 AS id, max(event_id) AS used, max(len) AS bytes FROM {_Q} q GROUP BY 1, 2)) WHERE total <= 300000")
def cache_evict(spark: S, d: str) -> DataFrame:
    uses = _q(spark, d).select("viewer", (F.col("event_id") % 97).alias("id"), F.col("event_id").alias("seq"), F.col("length").alias("bytes"))
    return R.kept_in_cache(uses, ["viewer"], 300000)


@query(f"SELECT viewer, max(event_id) AS event_id, arg_max(off, event_id) AS \"offset\" FROM {_Q} q GROUP BY 1")
def latest_wins(spark: S, d: str) -> DataFrame:
    return R.latest(_q(spark, d).select("viewer", "event_id", "offset"), "viewer", "event_id")


@query(f"SELECT event_id, viewer, generation FROM {_Q} q JOIN (SELECT viewer, max(generation) AS generation FROM {_Q} q GROUP BY 1) m USING (viewer, generation)")
def stale_drop(spark: S, d: str) -> DataFrame:
    return R.current(_q(spark, d), "viewer", "generation").select("event_id", "viewer", "generation")


@query(f"""SELECT viewer, max(ms) AS fires, count(*) AS events FROM (SELECT viewer, ms, sum(new) OVER (PARTITION BY viewer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT viewer, ts, event_id, (epoch_us(ts) // 1000) AS ms,
    CASE WHEN coalesce((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY viewer ORDER BY ts, event_id), 600000) >= 600000 THEN 1 ELSE 0 END AS new FROM {_Q} q)) GROUP BY viewer, burst""")
def debounce_sessions(spark: S, d: str) -> DataFrame:
    return R.debounce(_q(spark, d), "viewer", "ts", 600_000).select("viewer", "fires", "events")


_WANT = f"(SELECT DISTINCT generation, (event_id * 31) % 60 AS tile FROM {_Q} q)"


@query(f"""SELECT coalesce(a.generation, b.generation + 1) AS generation, coalesce(a.tile, b.tile) AS tile, CASE WHEN b.tile IS NULL THEN 'start' WHEN a.tile IS NULL THEN 'pause' ELSE 'keep' END AS act
    FROM {_WANT} a FULL JOIN {_WANT} b ON a.generation = b.generation + 1 AND a.tile = b.tile WHERE coalesce(a.generation, b.generation + 1) <= (SELECT max(generation) FROM {_WANT} w)""")
def pause_resume_sets(spark: S, d: str) -> DataFrame:
    """From one list of wanted tiles to the next: what starts, what is paused, what goes on."""
    want = _q(spark, d).select("generation", (F.col("event_id") * 31 % 60).alias("tile")).distinct()
    before = want.select((F.col("generation") + 1).alias("generation"), "tile").join(F.broadcast(want.agg(F.max("generation").alias("last"))), F.col("generation") <= F.col("last")).drop("last")
    keys = ["generation", "tile"]
    start = want.join(before, keys, "left_anti").withColumn("act", F.lit("start"))
    pause = before.join(want, keys, "left_anti").withColumn("act", F.lit("pause"))
    return start.union(pause).union(want.join(before, keys, "left_semi").withColumn("act", F.lit("keep")))


@query(f"SELECT viewer, px, z, generation, arrival FROM (SELECT *, row_number() OVER (PARTITION BY viewer, px ORDER BY z, generation DESC, arrival DESC) AS k FROM (SELECT viewer, event_id % 200 AS px, ((event_id * 17) % 5)::INT AS z, generation, event_id AS arrival FROM {_Q} q)) WHERE k = 1")
def painter_topmost(spark: S, d: str) -> DataFrame:
    tiles = _q(spark, d).select("viewer", (F.col("event_id") % 200).alias("px"), (F.col("event_id") * 17 % 5).cast("int").alias("z"), "generation", F.col("event_id").alias("arrival"))
    return R.topmost(tiles, ["viewer", "px"])


@query(f"SELECT viewer, generation, sum(done)::BIGINT AS done, sum(total)::BIGINT AS total, CASE WHEN sum(total) > 0 AND sum(done) < sum(total) THEN round(sum(done) / sum(total)::DOUBLE, 6) END AS fraction FROM (SELECT viewer, generation, event_id % 9 AS done, event_id % 9 + event_id % 4 AS total FROM {_Q} q) GROUP BY 1, 2")
def progress_fraction(spark: S, d: str) -> DataFrame:
    rows = _q(spark, d).select("viewer", "generation", (F.col("event_id") % 9).alias("done"), (F.col("event_id") % 9 + F.col("event_id") % 4).alias("total"))
    sums = rows.groupBy("viewer", "generation").agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    return sums.withColumn("fraction", F.when((F.col("total") > 0) & (F.col("done") < F.col("total")), F.round(F.col("done") / F.col("total"), 6)))


@query(f"SELECT viewer, event_id, (row_number() OVER (PARTITION BY viewer ORDER BY len, event_id) - 1) // 16 AS batch FROM {_Q} q QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY len, event_id) <= 96")
def urgent_batches(spark: S, d: str) -> DataFrame:
    """The 96 most urgent reads of each viewer, oldest first among equals, in batches of 16."""
    place = F.row_number().over(Window.partitionBy("viewer").orderBy("length", "event_id"))
    return _q(spark, d).withColumn("k", place).where("k <= 96").select("viewer", "event_id", F.floor((F.col("k") - 1) / 16).alias("batch"))


@query(f"SELECT DISTINCT generation, ids FROM (SELECT viewer, generation, string_agg(tile::VARCHAR, ',' ORDER BY tile) AS ids FROM (SELECT DISTINCT viewer, generation, event_id % 3 AS tile FROM {_Q} q) GROUP BY 1, 2)")
def request_identity(spark: S, d: str) -> DataFrame:
    """Requests of one generation and tile list are one request."""
    lists = _q(spark, d).groupBy("viewer", "generation").agg(F.array_join(F.array_sort(F.collect_set(F.col("event_id") % 3)).cast("array<string>"), ",").alias("ids"))
    return lists.select("generation", "ids").distinct()
