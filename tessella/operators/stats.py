"""Contrast statistics of a page: minimum, maximum and two percentiles by an index rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color

#: Values that systematic sampling aims at.
SAMPLE = 1 << 20


def usable(v: Column, nodata: float | None = None) -> Column:
    """Finite and not NoData."""
    return ~color.is_empty(v, nodata) & (F.abs(v) < F.lit(float("inf")))


def step(count: Column, bands: Column, most: int = SAMPLE) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(count * bands / F.lit(most)).cast("long"))


def systematic(df: DataFrame, place: Column, count: Column, bands: int = 1, most: int = SAMPLE) -> DataFrame:
    """Every step-th pixel in raster order (``place``) of ``count``; below twice ``most`` values stay."""
    return df.where(place % step(count, F.lit(bands), most) == 0)


def grouped(values: DataFrame, keys: list[str]) -> DataFrame:
    """lo, hi, p02 and p98 of each key's usable values (keys, v, nodata, place, count, bands), after systematic sampling.

    The percentile is the value at floor(q (n - 1)) of the sorted ones: the least that more values than
    that are not above. Values are counted before they are put in order, and sampling bounds how many a key has.
    """
    good = ~color.is_empty("v", None) & ~F.coalesce(F.col("v") == F.col("nodata"), F.lit(False)) & (F.abs("v") < F.lit(float("inf")))
    sampled = values.where(good & (F.col("place") % step(F.col("count"), F.col("bands")) == 0))
    each = sampled.groupBy(*keys, "v").agg(F.count("*").alias("m"))
    own = Window.partitionBy(*keys)
    ranked = each.withColumn("upto", F.sum("m").over(own.orderBy("v"))).withColumn("n", F.sum("m").over(own))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("v")))
    return ranked.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), at(0.02).alias("p02"), at(0.98).alias("p98"))


def stats(df: DataFrame, bands: list[str], nodata: float | None = None, place: Column | None = None, count: Column | None = None) -> DataFrame:
    """One row: lo, hi, p02, p98 of the pooled bands; 0, 1, 0, 1 if nothing is left. ``place`` is the raster order among ``count`` cells; small tables need neither."""
    shown = F.array(*[F.col(b).cast("double") for b in bands])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    values = df.select(F.lit(0).alias("all"), (zero if place is None else place).alias("place"), (one if count is None else count).alias("count"), F.lit(len(bands)).alias("bands"), F.lit(nodata).cast("double").alias("nodata"), F.explode(shown).alias("v"))
    got = grouped(values, ["all"])
    least = [F.coalesce(F.min(c), F.lit(d)).alias(c) for c, d in (("lo", 0.0), ("hi", 1.0), ("p02", 0.0), ("p98", 1.0))]
    return got.agg(*least)


def with_stats(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A page's statistics beside each of its rows: one row, so it is broadcast."""
    return df.crossJoin(F.broadcast(one_row))
