"""Tables viewed as rasters: pixel rows (x, y, and a value or bands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image 64 wide: x is the position, y the vector's id."""
    return table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("x", "v"), F.col("vec_id").alias("y")).select(F.col("x").cast("long").alias("x"), "y", F.col("v").cast("double").alias("v"))


def page_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-bit image 64 wide of each page's characters."""
    chars = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "")).alias("i", "c")).where("c <> ''")
    return chars.select("page_id", (F.col("i") % 64).cast("long").alias("x"), F.floor(F.col("i") / 64).cast("long").alias("y"), F.ascii("c").cast("double").alias("v"))


def exact_mean(v: str) -> Column:
    """An aggregate: the mean to six decimals, halves away from zero, whatever the order of the rows.

    Whole millionths are summed in two parts that doubles hold exactly; what values have beyond them is added. Means too large for that, or not finite, are plain ones.
    """
    x, unit, part = F.col(v).cast("double"), F.lit(1e6), F.lit(2.0**26)
    whole = F.rint(x * unit)
    high = F.rint(whole / part)
    total = F.sum(high) * part + F.sum(whole - high * part) + F.sum((x - whole / unit) * unit)
    exact = F.round(total / F.nullif(F.count(x), F.lit(0))) / unit
    return F.when(F.abs(F.avg(x)) < 1e9, exact).otherwise(rounded(F.avg(x)))


def item_grid(spark: SparkSession, sf_dir: str, cell: int = 50, days: int = 30) -> DataFrame:
    """Line items as a cloud of points, gridded by means: part keys across, days down, four bands."""
    rows = table(spark, sf_dir, "lineitem")
    return (
        rows.groupBy(
            F.floor(F.col("l_partkey") / cell).cast("long").alias("x"),
            F.floor((F.datediff("l_shipdate", F.lit("1990-01-01"))) / days).cast("long").alias("y"),
        )
        .agg(*[exact_mean(c).alias(b) for c, b in (("l_quantity", "b0"), ("l_extendedprice", "b1"), ("l_discount", "b2"), ("l_tax", "b3"))], F.count("*").alias("n"))
    )
