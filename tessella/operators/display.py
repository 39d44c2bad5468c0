"""From samples to RGBA: what a page's cells look like, whatever its kind, in one expression.

A cell whose first sample is NaN is transparent for every kind. NoData is transparent too where the first
sample (gray, palette) or all three (rgb) have it; other kinds don't know NoData. Alpha is scaled by its
bits, and colours that were multiplied by it are divided again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators.pages import described

__all__ = ["NEEDED", "described", "rgba", "tone"]
#: Columns of a page that its display needs.
NEEDED = ["kind", "bits", "sample_format", "nodata", "color_map", "white_is_zero", "has_alpha", "alpha_associated", "tone_adjustable"]


def tone(mode: str) -> tuple[Column, Column]:
    """The range that a page's tone stretches, from its columns and statistics (lo, hi, p02, p98)."""
    bits, kind = F.col("bits"), F.col("sample_format")
    full = F.pow(F.lit(2.0), bits)
    whole = (F.when(kind == 2, -full / 2).otherwise(F.lit(0.0)), F.when(kind == 2, full / 2 - 1).otherwise(full - 1))
    measured = ("p02", "p98") if mode == "percentile" else ("lo", "hi")
    out = []
    for k, (default, name) in enumerate(((0.0, measured[0]), (1.0, measured[1]))):
        stats = F.coalesce(F.col(name), F.lit(default))
        fixed = F.lit(0.0) if k == 0 else F.when(bits >= 8, F.lit(255.0)).otherwise(full - 1)
        out.append(F.when(~F.col("tone_adjustable"), fixed).when((F.lit(mode) == "full") & (kind != 3), whole[k]).otherwise(stats))
    return out[0], out[1]


def _staged(df: DataFrame, names: list[str], columns: list[Column]) -> DataFrame:
    """Columns of one step. What later steps use more than once is computed once this way."""
    return df.withColumns(dict(zip(names, columns, strict=True)))


def rgba(cells: DataFrame, mode: str = "percentile") -> DataFrame:
    """The cells' columns with r, g, b and a. Cells have v, an array of samples, the page's columns (``NEEDED``) and its statistics."""
    kind, is_float = F.col("kind"), F.col("sample_format") == 3
    own = [c for c in cells.columns if c not in ("r", "g", "b", "a")]
    c = lambda name: F.col(f"_{name}")
    v = [c(f"v{k}") for k in range(4)]
    lo, hi = tone(mode)
    colours = F.when(kind.isin("gray", "palette"), 1).when(kind == "cmyk", 4).otherwise(3)
    opaque = F.col("has_alpha") & (F.size("v") > colours)
    alpha = F.when(opaque, F.get("v", colours) * color.alpha_scale(F.col("bits"), is_float)).otherwise(F.lit(255.0))
    out = _staged(cells, ["_v0", "_v1", "_v2", "_v3", "_lo", "_hi", "_scale", "_opaque", "_alpha"], [*[F.get("v", F.lit(k)) for k in range(4)], lo, hi, color.byte_scale_of(F.col("bits"), is_float), opaque, alpha])
    out = _staged(out, ["_l", "_la", "_lb"], [F.when(kind == "lab", x) for x in color.lab_samples(*v[:3], F.col("bits"), is_float)])
    out = _staged(out, ["_f0", "_f1", "_f2"], list(color.lab_axes(c("l"), c("la"), c("lb"))))
    out = _staged(out, ["_x", "_y", "_z"], list(color.lab_xyz(c("f0"), c("f1"), c("f2"))))
    out = _staged(out, ["_d0", "_d1", "_d2"], list(color.xyz_to_linear(c("x"), c("y"), c("z"))))
    size = (F.size("color_map") / 3).cast("int")
    gray = color.stretch(v[0], c("lo"), c("hi"))
    cmyk, ycbcr = color.cmyk(*v, scale=c("scale")), color.ycbcr(*v[:3], scale=c("scale"))
    channels = []
    for k in range(3):
        plain = F.when(kind == "rgb", color.stretch(v[k], c("lo"), c("hi"))).when(kind == "palette", color.palette_of(v[0], F.col("color_map"), k, size)).when(kind == "cmyk", cmyk[k])
        plain = plain.when(kind == "ycbcr", ycbcr[k]).when(kind == "lab", color.linear_to_byte(c(f"d{k}")))
        channels.append(plain.otherwise(F.when(F.col("white_is_zero"), color.white_is_zero(gray)).otherwise(gray)))
    out = _staged(out, ["_r", "_g", "_b"], channels)
    nodata = F.col("nodata")
    same = [F.coalesce(x == nodata, F.lit(False)) for x in v[:3]]
    empty = F.isnan(v[0]) | v[0].isNull() | F.when(kind.isin("gray", "palette"), same[0]).when(kind == "rgb", same[0] & same[1] & same[2]).otherwise(F.lit(False))
    divided = [F.when(c("opaque") & F.col("alpha_associated"), color.unpremultiply(c(n), c("alpha"))).otherwise(c(n)) for n in "rgb"]
    out = _staged(out, ["_empty", "_r", "_g", "_b"], [empty, *divided])
    shown = [F.when(c("empty"), 0).otherwise(color.to_byte(c(n))).alias(m) for n, m in (("r", "r"), ("g", "g"), ("b", "b"), ("alpha", "a"))]
    return out.select(*own, *shown)
