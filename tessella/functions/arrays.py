"""Sample arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geometry import C, col


def one_or_many(scalar: C, many: C) -> Column:
    """A value that is a number, an array of numbers or absent, as an array of doubles."""
    return F.coalesce(F.transform(col(many), lambda x: x.cast("double")), F.when(col(scalar).isNotNull(), F.array(col(scalar).cast("double"))), F.array().cast("array<double>"))


def first_rows(samples: C, rows: C, width: C) -> Column:
    """The samples of a raster's first rows."""
    return F.slice(col(samples), F.lit(1), (col(rows) * col(width)).cast("int"))


def from_rgba(rgba: C, width: C, height: C, out_width: C, samples: C) -> Column:
    """The first samples of each RGBA pixel, in rows of ``out_width`` pixels: longer rows are cut, shorter ones end in zeros."""
    total = (col(height) * col(out_width) * col(samples)).cast("int")

    def at(k: Column) -> Column:
        pixel, sample = F.floor(k / col(samples)).cast("int"), k % col(samples)
        row, x = F.floor(pixel / col(out_width)).cast("int"), pixel % col(out_width)
        value = F.get(col(rgba), ((row * col(width) + x) * 4 + sample).cast("int"))
        return F.when(x < col(width), value).otherwise(F.lit(0).cast("double"))

    return F.transform(F.sequence(F.lit(0), total - 1), at)
