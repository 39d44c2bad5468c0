"""Samples to display bytes, as Column expressions on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geometry import C, col

#: Fixed: the D50 white point, the D50 to linear sRGB matrix, and the sRGB transfer constants.
D50 = (0.96422, 1.0, 0.82521)
TO_SRGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))


def to_byte(v: C) -> Column:
    """Clamp to 0..255 and round half to even; NaN gives 0."""
    return F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.nanvl(col(v).cast("double"), F.lit(0.0))))).cast("int")


def tone_range(mode: str, bits: int, signed: bool, is_float: bool, adjustable: bool, lo: C, hi: C, p02: C, p98: C) -> tuple[Column, Column]:
    """The range that a tone mode stretches. ``full`` on floats is as ``minmax``."""
    if not adjustable:
        return F.lit(0.0), F.lit(255.0 if is_float or bits == 8 else float((1 << bits) - 1))
    if mode == "full" and not is_float:
        return (F.lit(-float(1 << bits - 1)), F.lit(float((1 << bits - 1) - 1))) if signed else (F.lit(0.0), F.lit(float((1 << bits) - 1)))
    return (col(p02), col(p98)) if mode == "percentile" else (col(lo), col(hi))


def stretch(v: C, lo: C, hi: C) -> Column:
    """Linear to 0..255; a flat range gives 128."""
    span = col(hi) - col(lo)
    return F.when(span > 0, (col(v) - col(lo)) * (F.lit(255.0) / F.nullif(span, F.lit(0.0)))).otherwise(F.lit(128.0))


def white_is_zero(v: C) -> Column:
    return F.lit(255.0) - col(v)


def byte_scale_of(bits: Column, is_float: Column) -> Column:
    """What brings a sample to 0..255."""
    return F.when(is_float, F.lit(255.0)).when(bits == 8, F.lit(1.0)).otherwise(F.lit(255.0) / (F.pow(F.lit(2.0), bits) - F.lit(1.0)))


def alpha_scale(bits: Column, is_float: Column) -> Column:
    """The same for alpha, where 16 bits are divided by 257."""
    return F.when(~is_float & (bits == 16), F.lit(1.0) / F.lit(257.0)).otherwise(byte_scale_of(bits, is_float))


def unpremultiply(v: C, alpha: C) -> Column:
    """A colour that was multiplied by its alpha (0..255), without it."""
    a = col(alpha)
    return F.when((a > 0) & (a < 255), col(v) * F.lit(255.0) / F.nullif(a, F.lit(0.0))).otherwise(col(v))


def cmyk(c: C, m: C, y: C, k: C, scale: C = 1.0) -> tuple[Column, Column, Column]:
    white = F.lit(1.0) - col(k) * col(scale) / F.lit(255.0)
    return tuple((F.lit(255.0) - col(x) * col(scale)) * white for x in (c, m, y))


def ycbcr(y: C, cb: C, cr: C, scale: C = 1.0) -> tuple[Column, Column, Column]:
    y, cb, cr = (col(x) * col(scale) for x in (y, cb, cr))
    cb, cr = cb - F.lit(128.0), cr - F.lit(128.0)
    return y + F.lit(1.402) * cr, y - F.lit(0.344136) * cb - F.lit(0.714136) * cr, y + F.lit(1.772) * cb


def lab_axes(lightness: C, a: C, b: C) -> tuple[Column, Column, Column]:
    """The cube roots that CIE Lab holds, along X, Y and Z."""
    fy = (col(lightness) + F.lit(16.0)) / F.lit(116.0)
    return fy + col(a) / F.lit(500.0), fy, fy - col(b) / F.lit(200.0)


def lab_xyz(fx: C, fy: C, fz: C) -> tuple[Column, Column, Column]:
    """XYZ under D50."""
    parts = []
    for f, white in zip(map(col, (fx, fy, fz)), D50, strict=True):
        cube = f * f * f
        parts.append(F.when(cube > F.lit(0.008856), cube).otherwise((f - F.lit(16.0) / F.lit(116.0)) / F.lit(7.787)) * F.lit(white))
    return tuple(parts)


def xyz_to_linear(x: C, y: C, z: C) -> tuple[Column, Column, Column]:
    parts = [col(x), col(y), col(z)]
    return tuple(sum((F.lit(m) * p for m, p in zip(row[1:], parts[1:], strict=True)), F.lit(row[0]) * parts[0]) for row in TO_SRGB)


def linear_to_byte(linear: C) -> Column:
    """Linear light as sRGB, 0..255."""
    linear = col(linear)
    gamma = F.when(linear <= F.lit(0.0031308), F.lit(12.92) * linear).otherwise(F.lit(1.055) * F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1.0 / 2.4)) - F.lit(0.055))
    return gamma * F.lit(255.0)


def lab(lightness: C, a: C, b: C) -> tuple[Column, Column, Column]:
    """CIE Lab (L 0..100) to sRGB 0..255."""
    return tuple(map(linear_to_byte, xyz_to_linear(*lab_xyz(*lab_axes(lightness, a, b)))))


def lab_samples(lightness: C, a: C, b: C, bits: Column, is_float: Column) -> tuple[Column, Column, Column]:
    """L (0..100), a and b of stored samples: whole numbers have L in full scale, and a and b as signed numbers in 256ths beyond 8 bits."""
    full = F.pow(F.lit(2.0), bits)
    unit = F.when(bits == 8, F.lit(1.0)).otherwise(F.lit(1.0) / F.lit(256.0))
    signed = [F.when(is_float, col(x)).otherwise(F.when(col(x) >= full / 2, col(x) - full).otherwise(col(x)) * unit) for x in (a, b)]
    return F.when(is_float, col(lightness)).otherwise(col(lightness) / (full - F.lit(1.0)) * F.lit(100.0)), *signed


def palette(v: C, table: Column, plane: int, size: int) -> Column:
    """An entry of a planar table of 16-bit colours, as a byte; indexes beyond the table take its ends."""
    return palette_of(v, table, plane, F.lit(size))


def palette_of(v: C, table: Column, plane: int, size: Column) -> Column:
    at = F.least(size - 1, F.greatest(F.lit(0), col(v).cast("int")))
    return F.get(table, at + plane * size) / F.lit(257.0)


def is_empty(v: C, nodata: float | None) -> Column:
    """NaN or the NoData value. NaN is tested first: Spark holds NaN equal to itself."""
    v = col(v).cast("double")
    return F.isnan(v) if nodata is None else F.isnan(v) | (v == F.lit(float(nodata)))
