"""Texts of tags, sizes and samples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geometry import C, col

MOST_TEXT = 1500
#: Names of the public container format's compression, photometric and sample format codes.
COMPRESSION = {
    1: "None", 2: "CCITT modified Huffman RLE", 3: "CCITT Group 3 fax", 4: "CCITT Group 4 fax", 5: "LZW", 6: "Old-style JPEG", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "Deflate (legacy)",
    33003: "JPEG 2000 (Aperio)", 33005: "JPEG 2000 (Aperio)", 34712: "JPEG 2000", 34887: "LERC", 34925: "LZMA", 50000: "Zstandard", 50001: "WebP", 50002: "JPEG XL",
}
PHOTOMETRIC = {
    0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 4: "Transparency mask", 5: "Separated (CMYK)", 6: "YCbCr", 8: "CIE L*a*b*", 9: "ICC L*a*b*", 10: "ITU L*a*b*",
    32844: "LogL", 32845: "LogLuv", 34892: "Linear raw",
}
SAMPLE_FORMAT = {1: "Unsigned integer", 2: "Signed integer", 3: "Floating point", 4: "Undefined"}
#: Names of the predictors; 1 is none.
PREDICTOR = {2: "Horizontal differencing", 3: "Floating point"}


def supported() -> tuple[int, ...]:
    """Codes of the compressions that can be read: those that have a decoder."""
    from tessella.sources.codecs import CODECS

    return tuple(sorted(CODECS))


def tag_text(v: C) -> Column:
    """Without trailing NULs and outer spaces; null if blank; cut with a note of the full length."""
    text = F.trim(F.regexp_replace(col(v), "\\x00+$", ""))
    cut = F.concat(F.substring(text, 1, MOST_TEXT), F.lit("… ("), F.char_length(text).cast("string"), F.lit(" characters)"))
    return F.when(F.char_length(text) == 0, F.lit(None)).when(F.char_length(text) > MOST_TEXT, cut).otherwise(text)


def code_name(code: C, names: dict[int, str], bare: bool = False) -> Column:
    """A code's name; without one ``Unknown (n)``, or the bare number."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    number = col(code).cast("string")
    return F.coalesce(F.try_element_at(table, col(code)), number if bare else F.concat(F.lit("Unknown ("), number, F.lit(")")))


def predictor_name(code: C) -> Column:
    """Null for none."""
    return F.when(col(code) != 1, code_name(code, PREDICTOR, bare=True))


def fixed(v: C, digits: int) -> Column:
    """A number that is not negative with so many decimals; halves go up."""
    n = F.floor(col(v) * F.lit(float(10**digits)) + F.lit(0.5)).cast("long")
    if not digits:
        return n.cast("string")
    return F.concat(F.floor(n / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def byte_size(v: C) -> tuple[Column, Column]:
    """Value and unit of a byte count: powers of 1024 up to TB."""
    value, unit = col(v).cast("double"), F.lit("B")
    for k, name in enumerate(("KB", "MB", "GB", "TB"), 1):
        limit = F.lit(float(1024**k))
        big = col(v) >= limit
        value, unit = F.when(big, col(v) / limit).otherwise(value), F.when(big, F.lit(name)).otherwise(unit)
    return value, unit


def byte_text(v: C) -> Column:
    """Bytes as they are; larger units with two decimals below ten, else one."""
    value, unit = byte_size(v)
    return F.concat(F.when(unit == "B", fixed(value, 0)).when(value < 10, fixed(value, 2)).otherwise(fixed(value, 1)), F.lit(" "), unit)


def number_text(v: C) -> Column:
    """Whole numbers as they are, ``NaN``, and others to six significant digits without trailing zeros."""
    x = col(v).cast("double")
    exact = F.format_string("%.5e", x)  # d.ddddde+xx
    power = F.regexp_extract(exact, r"e([+-]\d+)$", 1).try_cast("int")
    rounded = exact.try_cast("double")
    plain = F.format_string("%.0f", rounded)
    for k in range(-6, 6):
        plain = F.when(power == k, F.format_string(f"%.{5 - k}f", rounded)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    digits = F.regexp_replace(F.regexp_replace(exact, r"e.*$", ""), r"\.?0+$", "")
    small = F.concat(digits, F.lit("e-"), (-power).cast("string"))
    whole = x % F.lit(1.0) == 0
    return F.when(F.isnan(x), "NaN").when(whole, x.try_cast("decimal(38,0)").cast("string")).when(power < -6, small).otherwise(plain)


def percent(v: C) -> Column:
    return F.when(col(v) < 10, F.floor(col(v) * 10 + F.lit(0.5)) / 10).otherwise(F.floor(col(v)).cast("double"))


def percent_text(v: C, zoom: bool = False) -> Column:
    """One decimal below ten; else whole, rounded for a zoom and cut off for progress."""
    return F.when(col(v) < 10, fixed(v, 1)).otherwise(F.floor(col(v) + F.lit(0.5 if zoom else 0.0)).cast("long").cast("string"))


def resolution(x_num: C, x_den: C, y_num: C, y_den: C, unit: C) -> Column:
    """``x × y`` and a unit: 2 is inches, 3 centimetres. A missing y is as x."""
    x = rational_text(x_num, x_den)
    y = F.coalesce(rational_text(y_num, y_den), x)
    return F.concat(x, F.lit(" × "), y, F.when(col(unit) == 2, " dpi").when(col(unit) == 3, " px/cm").otherwise(""))


def rational_text(num: C, den: C) -> Column:
    """A rational to three decimals, without zeros at the end."""
    return F.regexp_replace(fixed(rational(num, den), 3), r"\.?0+$", "")


def tile_key(z: C, i: C, j: C) -> Column:
    return F.concat_ws("/", *[col(c).cast("string") for c in (z, i, j)])


def tile_of_key(key: C) -> tuple[Column, Column, Column]:
    parts = F.split(col(key), "/")
    return tuple(F.get(parts, F.lit(k)).cast("long") for k in range(3))


def region_key(page: C, x0: C, y0: C, x1: C, y1: C, out_w: C, out_h: C) -> Column:
    """``page|x0,y0,x1,y1|wxh``: what a region read is kept under."""
    window = F.concat_ws(",", *[col(c).cast("string") for c in (x0, y0, x1, y1)])
    return F.concat_ws("|", col(page).cast("string"), window, F.concat_ws("x", col(out_w).cast("string"), col(out_h).cast("string")))


def error_text(message: C) -> Column:
    """An error as it is shown: the text of an unknown compression is made plain."""
    number = F.regexp_extract(col(message), r"Unknown compression method identifier: (\d+)", 1)
    return F.when(number != "", F.concat(F.lit("Compression method "), number, F.lit(" is not supported."))).otherwise(col(message))


def base_name(path: C) -> Column:
    return F.substring_index(col(path), "/", -1)


def sample_text(labels: list[str], values: list[Column]) -> Column:
    """``Label: v`` of one sample, ``R 1  G 2`` of several."""
    if len(values) == 1:
        return F.concat(F.lit(f"{labels[0]}: "), values[0])
    return F.concat_ws("  ", *[F.concat(F.lit(f"{n} "), v) for n, v in zip(labels, values, strict=True)])


def rational(num: C, den: C) -> Column:
    """To three decimals; a missing or zero denominator leaves the numerator."""
    bad = col(den).isNull() | (col(den) == 0)
    return F.when(bad, col(num).cast("double")).otherwise(F.floor(col(num) / F.nullif(col(den), F.lit(0)) * 1000 + F.lit(0.5)) / 1000)
