"""Window reads: clip, tile pruning, level choice, box means and nearest samples.

A window meets the tile grid by arithmetic: the keys of its tiles are made and joined by equality, so
no interval predicate ever compares all tiles with all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry as G

#: Above so many source cells a region is sampled, not averaged.
MEAN_LIMIT = 96 << 20


def clip(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select((F.col("id") % width).alias("ox"), F.floor(F.col("id") / width).cast("long").alias("oy"))


def box_mean(df: DataFrame, window: tuple[int, int, int, int], out: tuple[int, int], bands: list[str], empty: Column | None = None) -> DataFrame:
    """Means of the window's cells by output cell, with null where nothing falls. ``empty``: pixels to skip, by the first band."""
    x0, y0, x1, y1 = window
    cells = clip(df, *window)
    if empty is not None:
        cells = cells.where(~empty)
    means = cells.groupBy(G.box_cell(F.col("x") - x0, x1 - x0, out[0]).alias("ox"), G.box_cell(F.col("y") - y0, y1 - y0, out[1]).alias("oy")).agg(*[F.avg(b).alias(b) for b in bands])
    return grid(df.sparkSession, *out).join(means, ["ox", "oy"], "left")


def nearest(df: DataFrame, window: tuple[int, int, int, int], out: tuple[int, int], bands: list[str]) -> DataFrame:
    """One source cell for each output cell, by equality on its coordinates."""
    x0, y0, x1, y1 = window
    wanted = grid(df.sparkSession, *out).select("ox", "oy", G.nearest_source("ox", x0, x1, out[0]).alias("x"), G.nearest_source("oy", y0, y1, out[1]).alias("y"))
    return clip(df, *window).join(wanted, ["x", "y"]).select("ox", "oy", "x", "y", *bands)


def read_region(df: DataFrame, window: tuple[int, int, int, int], out: tuple[int, int], bands: list[str], is_palette: bool = False, empty: Column | None = None) -> DataFrame:
    """The choice of a plan by sizes: exact, mean or nearest. Palettes are never averaged."""
    x0, y0, x1, y1 = window
    if out == (x1 - x0, y1 - y0):
        return clip(df, *window).select((F.col("x") - x0).alias("ox"), (F.col("y") - y0).alias("oy"), *bands)
    if not is_palette and (x1 - x0) * (y1 - y0) <= MEAN_LIMIT:
        return box_mean(df, window, out, bands, empty)
    return nearest(df, window, out, bands).drop("x", "y")


def tile_keys(requests: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """(request columns, tx, ty): the tiles that each request's window x0, y0, x1, y1 touches."""
    ax, bx = G.tile_span("x0", "x1", tile_w)
    ay, by = G.tile_span("y0", "y1", tile_h)
    return requests.where("x1 > x0 AND y1 > y0").withColumn("tx", F.explode(F.sequence(ax, bx - 1))).withColumn("ty", F.explode(F.sequence(ay, by - 1)))


def sampled_tiles(requests: DataFrame, lo: str, hi: str, out: str, tile: int) -> DataFrame:
    """For each request its tiles along one side that hold at least one nearest sample, found within the row."""
    cells = F.sequence(F.lit(0).cast("long"), F.col(out).cast("long") - 1)
    tiles = F.array_distinct(F.transform(cells, lambda i: F.floor(G.nearest_source(i, F.col(lo), F.col(hi), F.col(out)) / tile).cast("long")))
    return requests.withColumn("tile", F.explode(tiles))


def choose_level(requests: DataFrame, levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each request (its page's keys, w, out_w, any columns): the narrowest level wide enough, else the page itself.

    ``levels`` has the keys, level, level_w; level 0 is the page. A page's levels stand in one small array, so
    requests meet them by one join on the keys and are not grouped.
    """
    keys = keys or ["page"]
    rung = F.struct(F.col("level_w").cast("double").alias("w"), (-F.col("level")).alias("order"))
    ladder = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(rung)).alias("_ladder"), F.max(F.when(F.col("level") == 0, F.col("level_w"))).alias("_full"))
    least = F.lit(0.98) * F.col("_full") * F.col("out_w") / F.col("w")
    fits = F.filter("_ladder", lambda x: x["w"] >= least)
    return requests.join(ladder, keys, "left").withColumn("level", F.coalesce(-F.get(fits, F.lit(0))["order"], F.lit(0))).drop("_ladder", "_full")


def pyramid(df: DataFrame, width: int, height: int, levels: int) -> DataFrame:
    """(level, x, y, v): means of 2 x 2 cells, level by level, each from the one before."""
    now = df.select(F.lit(0).alias("level"), "x", "y", "v")
    out = now
    for level in range(1, levels):
        now = now.groupBy(F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y")).agg(F.avg("v").alias("v")).select(F.lit(level).alias("level"), "x", "y", "v")
        out = out.union(now)
    return out
