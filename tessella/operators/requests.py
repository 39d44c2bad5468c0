"""Read planning and request lists: byte blocks, merged ranges, caches, generations, tiles in view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.folds import fold, typed

BLOCK, DIRECT, MERGED = 64 << 10, 16 << 10, 16 << 20


def clamp_eof(df: DataFrame, size: str = "size") -> DataFrame:
    """Ranges (offset, length) cut at the file's end; empty ones go."""
    end = F.least(F.col("offset") + F.col("length"), F.col(size))
    return df.withColumn("end", end).where(F.col("end") > F.col("offset")).withColumn("length", F.col("end") - F.col("offset")).drop("end")


def read_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct cached blocks that short ranges touch."""
    last = F.col("offset") + F.col("length") - 1
    return df.where(F.col("length") < DIRECT).select(*keys, F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor(last / BLOCK))).alias("block")).distinct()


def coalesce_uncapped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Touching and overlapping ranges as one: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("offset", "length")
    before = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*keys, "offset", "length", F.when(before.isNull() | (F.col("offset") > before), 1).otherwise(0).alias("new"))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("parts")).select(*keys, "offset", (F.col("end") - F.col("offset")).alias("length"), "parts")


class _Merge:
    """The merged read that is still open."""

    def __init__(self, keys: list[str], cap: int):
        self.keys, self.cap, self.open = keys, cap, None

    def take(self, r: dict) -> list[dict]:
        first, after, now = r["offset"], r["offset"] + r["length"], self.open
        if now and first <= now["after"] and max(after, now["after"]) - now["offset"] <= self.cap:
            now["after"], now["parts"] = max(after, now["after"]), now["parts"] + 1
            return []
        out = self.end()
        self.open = {k: r[k] for k in self.keys} | {"offset": first, "after": after, "parts": 1}
        return out

    def end(self) -> list[dict]:
        return [] if self.open is None else [{k: v for k, v in self.open.items() if k != "after"} | {"length": self.open["after"] - self.open["offset"]}]


def coalesce_capped(df: DataFrame, keys: list[str], cap: int = MERGED) -> DataFrame:
    """The same while the merged span is at most ``cap``: an ordered fold over the ranges of one round trip."""
    need = df.select(*keys, F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    return fold(need, keys, ["offset", "length"], lambda: _Merge(keys, cap), f"{typed(need, keys)}, offset long, length long, parts long")


def islands(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of consecutive whole numbers, as [first, last + 1)."""
    numbered = df.select(*keys, value).distinct().withColumn("k", F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return numbered.groupBy(*keys, "k").agg(F.min(value).alias("first"), (F.max(value) + 1).alias("after")).drop("k")


def kept_in_cache(uses: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Entries (id, bytes, seq of each use) that an LRU cache of ``cap`` bytes still has: newest first while the sum fits."""
    entries = uses.groupBy(*keys, "id").agg(F.max("seq").alias("used"), F.max("bytes").alias("bytes"))
    order = Window.partitionBy(*keys).orderBy(F.col("used").desc())
    return entries.withColumn("total", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= cap)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest request of each viewer; older ones are replaced."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def current(df: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of each viewer's newest generation; results of older ones are stale."""
    newest = df.groupBy(key).agg(F.max(generation).alias(generation))
    return df.join(newest, [key, generation], "left_semi")


def debounce(df: DataFrame, key: str, ts: str, millis: int = 300) -> DataFrame:
    """Bursts whose events are less than ``millis`` apart, each with its last event's time."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    now = F.unix_millis(F.col(ts).cast("timestamp"))
    gap = now - F.lag(now).over(order)
    burst = F.sum(F.when(gap.isNull() | (gap >= millis), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("burst", burst).groupBy(key, "burst").agg(F.max(F.unix_millis(F.col(ts).cast("timestamp"))).alias("fires"), F.count("*").alias("events"))


def topmost(df: DataFrame, keys: list[str]) -> DataFrame:
    """What shows where tiles overlap: the finest level, then the newest generation and arrival."""
    order = Window.partitionBy(*keys).orderBy(F.col("z").asc(), F.col("generation").desc(), F.col("arrival").desc())
    return df.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def visible(tiles: DataFrame, view_level: Column) -> DataFrame:
    """Tiles (z, x0, y0, x1, y1) that a view (vx0, vy0, vx1, vy1) shows: those that overlap it, no finer than two levels below its own."""
    overlap = (F.col("x0") < F.col("vx1")) & (F.col("x1") > F.col("vx0")) & (F.col("y0") < F.col("vy1")) & (F.col("y1") > F.col("vy0"))
    return tiles.where(overlap & (F.col("z") >= view_level - 2))


def still_wanted(wanted: DataFrame, tiles: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted tiles that are neither here, final and of the current generation, nor have failed."""
    here = tiles.where("final").select(*keys, "generation")
    return wanted.join(here, [*keys, "generation"], "left_anti").join(failed.select(*keys), keys, "left_anti")


def answers(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with its response's columns, or nulls while it waits; responses that nobody asked for go."""
    return requests.join(responses, keys, "left")


class _Paced:
    """Gives a row when so many milliseconds have passed since the last one that was given."""

    def __init__(self, first: int, every: int, last: bool, strictly: bool):
        self.first, self.every, self.last, self.strictly, self.given = first, every, last, strictly, None

    def take(self, r: dict) -> list[dict]:
        if self.given is None:
            self.given = r["began"] - self.every + self.first
        whole = r["done"] >= r["total"]
        late = r["ms"] - self.given > self.every if self.strictly else r["ms"] - self.given >= self.every
        if whole and not self.last or not whole and not late:
            return []
        self.given = r["ms"]
        return [r]

    def end(self) -> list[dict]:
        return []


def partial_results(rows: DataFrame, keys: list[str], first: int = 600, every: int = 1500) -> DataFrame:
    """Of the steps (keys, began, ms, done, total) of reads, those at which an unfinished picture is shown: after ``first`` milliseconds, then at most each ``every``; never the last."""
    need = rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("began", "ms", "done", "total")])
    return fold(need, keys, ["ms", "done"], lambda: _Paced(first, every, False, False), typed(need, need.columns))


def progress(rows: DataFrame, keys: list[str], every: int = 200) -> DataFrame:
    """Of the same steps, those that are reported: at most each ``every`` milliseconds, and always the last."""
    need = rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("ms", "done", "total")]).withColumn("began", F.lit(0).cast("long"))
    return fold(need, keys, ["ms", "done"], lambda: _Paced(every, every, True, True), typed(need, need.columns)).drop("began")


def fires(changes: DataFrame, key: str) -> DataFrame:
    """When a view asks for its tiles: ``delay`` milliseconds after a change unless another comes before; a change of page or tone has no delay."""
    order = Window.partitionBy(key).orderBy("ms", "event_id")
    due = F.col("ms") + F.col("delay")
    following = F.lead("ms").over(order)
    return changes.withColumn("fires", due).withColumn("_next", following).where("_next IS NULL OR _next >= fires").drop("_next")
