"""From image directories to pages and levels, and what a page is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.folds import fold, kind_of


class _Pages:
    """The state of a file: how many pages it has so far, and what the last one is like."""

    def __init__(self) -> None:
        self.number, self.width, self.spp, self.masks = -1, 0, 0, 0

    def take(self, r: dict) -> list[dict]:
        reduced = r["subfile"] & 1
        if reduced and self.number >= 0 and r["width"] < self.width and r["spp"] == self.spp:
            role, page = "level", self.number
        elif r["subfile"] & 4 and not reduced:
            role, page = "mask", self.masks
            self.masks += 1
        else:
            self.number += 1
            self.width, self.spp = r["width"], r["spp"]
            role, page = "page", self.number
        return [{"path": r["path"], "ifd": r["ifd"], "role": role, "page": page}]

    def end(self) -> list[dict]:
        return []


def classify(ifds: DataFrame) -> DataFrame:
    """(path, ifd, role, page) of directories (path, ifd, subfile, width, spp): an ordered fold for each file.

    A reduced image (bit 0) narrower than the last page and with its sample count is a level of it; a mask
    (bit 2, not reduced) stands aside, with page -1, and is a page only in a file without pages; all else is a page.
    """
    need = ifds.select("path", F.col("ifd").cast("int").alias("ifd"), F.col("subfile").cast("int").alias("subfile"), F.col("width").cast("long").alias("width"), F.col("spp").cast("long").alias("spp"))
    rows = fold(need, ["path"], ["ifd"], _Pages, f"path {kind_of(need, 'path')}, ifd int, role string, page int")
    alone = ~F.bool_or(F.col("role") == "page").over(Window.partitionBy("path"))
    mask = F.col("role") == "mask"
    return rows.withColumn("alone", alone).select("path", "ifd", F.when(mask & F.col("alone"), "page").otherwise(F.col("role")).alias("role"), F.when(mask & ~F.col("alone"), -1).otherwise(F.col("page")).alias("page"))


def levels(ifds: DataFrame) -> DataFrame:
    """A row for each level of each page: the directory's columns, page, level (0 is the widest; ties in file order), page_w and page_h."""
    roles = classify(ifds).where("role <> 'mask'").select("path", "ifd", "page")
    order = Window.partitionBy("path", "page").orderBy(F.col("width").desc(), "ifd")
    placed = ifds.join(roles, ["path", "ifd"]).withColumn("level", F.row_number().over(order) - 1)
    return placed.withColumn("page_w", F.first("width").over(order)).withColumn("page_h", F.first("height").over(order))


def bytes_per_pixel(level_rows: DataFrame) -> DataFrame:
    """(path, pixels, bytes_per_pixel): a file's size by the pixels of all levels of all its pages; 1 if there are none."""
    sums = level_rows.groupBy("path").agg(F.sum(F.col("width") * F.col("height")).alias("pixels"), F.max("size").alias("size"))
    return sums.select("path", "pixels", F.when(F.col("pixels") > 0, F.col("size") / F.col("pixels")).otherwise(F.lit(1.0)).alias("bytes_per_pixel"))


def counts(ifds: DataFrame) -> DataFrame:
    """(path, ifds, pages, levels): directories and pages of each file, and the levels of each page in order."""
    roles = classify(ifds)
    own = roles.where("role <> 'mask'").groupBy("path", "page").agg(F.count("*").alias("n"))
    each = own.groupBy("path").agg(F.count("*").alias("pages"), F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda x: x["n"]).alias("levels"))
    return roles.groupBy("path").agg(F.count("*").alias("ifds")).join(each, "path")


def info(level_rows: DataFrame) -> DataFrame:
    """(path, page, place, section, label, value): what an information panel shows of each page, in order."""
    keys = ["path", "page"]
    sizes = level_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", F.concat_ws("×", F.col("width").cast("string"), F.col("height").cast("string")).alias("size")))).alias("l"))
    files = level_rows.groupBy("path").agg(F.countDistinct("page").alias("pages"), F.max(F.col("ifd") + 1).alias("ifds"))
    rows = described(level_rows.where("level = 0")).join(sizes, keys).join(files, "path")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    layout = F.when(F.col("tiled"), F.concat(F.lit("Tiles "), "tile_width", F.lit(" × "), "tile_height")).otherwise(F.concat(F.lit("Strips of "), "tile_height", F.when(F.col("tile_height") == 1, " row").otherwise(" rows")))
    names = F.split(labels(F.col("kind"), F.col("spp").cast("int"), F.col("has_alpha")), " ")
    sub = F.when(F.size("l") > 1, F.array_join(F.transform("l", lambda x: x["size"]), ", "))
    has_res = F.coalesce(F.size("x_resolution") > 0, F.lit(False))
    dpi = F.when(has_res, text.resolution(F.get("x_resolution", F.lit(0)), F.get("x_resolution", F.lit(1)), F.get("y_resolution", F.lit(0)), F.get("y_resolution", F.lit(1)), F.col("resolution_unit")))
    geo = F.when(F.col("has_geo"), F.coalesce(F.concat(F.lit("EPSG:"), F.col("epsg")), F.lit("Yes")))
    page = F.when(F.col("pages") > 1, F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"))).otherwise("Image")
    shown: list[tuple[Column, str, Column]] = [
        (F.lit("File"), "Name", text.base_name("path")),
        (F.lit("File"), "Format", F.when(F.col("big"), "BigTIFF (64-bit offsets)").otherwise("TIFF (32-bit offsets)")),
        (F.lit("File"), "Byte order", F.when(F.col("little"), "Little-endian (II)").otherwise("Big-endian (MM)")),
        (F.lit("File"), "File size", text.byte_text("size")),
        (F.lit("File"), "Images (IFDs)", F.col("ifds").cast("string")),
        (F.lit("File"), "Pages", F.col("pages").cast("string")),
        (page, "Dimensions", F.concat("width", F.lit(" × "), "height")),
        (page, "Samples per pixel", F.concat(F.col("spp").cast("string"), F.lit(" ("), F.array_join(names, ", "), F.lit(")"))),
        (page, "Bits per sample", joined("all_bits")),
        (page, "Sample format", text.code_name("sample_format", text.SAMPLE_FORMAT, bare=True)),
        (page, "Photometric", text.code_name("photometric", text.PHOTOMETRIC)),
        (page, "Compression", text.code_name("compression", text.COMPRESSION)),
        (page, "Planar config", F.when(F.col("planar"), "Separate planes").otherwise("Contiguous (chunky)")),
        (page, "Layout", layout),
        (page, "Pyramid levels", sub),
        (page, "NoData", text.number_text("nodata")),
        *[(F.lit("Tags"), label, F.try_element_at("texts", F.lit(label))) for label in ("Document name", "Page name", "Description", "Make", "Model", "Software", "Date/time", "Artist", "Host computer", "Copyright")],
        (F.lit("Tags"), "Resolution", dpi),
        (F.lit("Tags"), "Predictor", text.predictor_name("predictor")),
        (F.lit("Tags"), "GeoTIFF", geo),
    ]
    every = F.array(*[F.struct(F.lit(k).alias("place"), section.alias("section"), F.lit(label).alias("label"), value.alias("value")) for k, (section, label, value) in enumerate(shown)])
    return rows.select(*keys, F.inline(F.filter(every, lambda x: x["value"].isNotNull())))


def kind(photometric: Column, spp: Column, has_map: Column) -> Column:
    return (
        F.when((photometric == 2) & (spp >= 3), "rgb")
        .when((photometric == 3) & has_map, "palette")
        .when((photometric == 5) & (spp >= 4), "cmyk")
        .when((photometric == 6) & (spp >= 3), "ycbcr")
        .when((photometric == 8) & (spp >= 3), "lab")
        .when(photometric.isin(0, 1, 2, 3, 4, 5, 6, 8), "gray")
        .when(spp >= 3, "rgb")
        .otherwise("gray")
    )


#: Names of the leading samples of each kind.
LABELS = {"rgb": ["R", "G", "B"], "cmyk": ["C", "M", "Y", "K"], "ycbcr": ["Y", "Cb", "Cr"], "lab": ["L*", "a*", "b*"], "palette": ["Index"], "gray": ["Value"]}


def labels(kind_: Column, spp: Column, alpha: Column) -> Column:
    """Names of all samples: the kind's, then A for alpha, then S and the number."""
    def extra(n: int) -> Column:
        numbers = F.when(spp > n, F.sequence(F.lit(n), F.greatest(spp - 1, F.lit(n)))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.when(alpha & (i == n), F.lit("A")).otherwise(F.concat(F.lit("S"), i.cast("string"))))

    out = F.lit("")
    for name, own in LABELS.items():
        out = F.when(kind_ == name, F.concat_ws(" ", F.array(*map(F.lit, own)), extra(len(own)))).otherwise(out)
    return out


def unsupported(compression: Column, is_float: Column, bits: Column, is_ycbcr: Column, subsampled: Column) -> Column:
    """Why a page can't be shown, or null."""
    return (
        F.when(~compression.isin(*text.supported()), F.concat(text.code_name(compression, text.COMPRESSION), F.lit(" compression is not supported.")))
        .when(is_float & ~bits.isin(16, 32, 64), F.concat(bits.cast("string"), F.lit("-bit floating point samples are not supported.")))
        .when(is_ycbcr & (compression != 7) & subsampled, F.lit("Uncompressed chroma-subsampled YCbCr is not supported."))
    )


def tone_adjustable(kind_: Column, is_unsigned: Column, bits: Column) -> Column:
    return kind_.isin("gray", "rgb") & ~(is_unsigned & (bits <= 8))


def described(ifds: DataFrame) -> DataFrame:
    """A directory's columns and what follows from them: kind, samples shown, alpha, tone and why it can't be shown."""
    kind_ = kind(F.col("photometric"), F.col("spp"), F.coalesce(F.size("color_map") > 0, F.lit(False)))
    colours = F.when(F.col("kind").isin("gray", "palette"), 1).when(F.col("kind") == "cmyk", 4).otherwise(3)
    alpha = F.col("extra").isin(1, 2) & (F.col("spp") > F.col("colours"))
    subsampled = F.coalesce(F.exists("subsampling", lambda x: x != 1), F.lit(False))
    out = ifds.withColumn("kind", kind_).withColumn("colours", colours).withColumn("has_alpha", alpha)
    return out.withColumns(
        {
            "samples": F.sequence(F.lit(0), F.col("colours") - F.when(F.col("has_alpha"), 0).otherwise(1)),
            "alpha_associated": F.col("has_alpha") & (F.col("extra") == 1),
            "white_is_zero": F.col("photometric") == 0,
            "tone_adjustable": tone_adjustable(F.col("kind"), F.col("sample_format") == 1, F.col("bits")),
            "unsupported": unsupported(F.col("compression"), F.col("sample_format") == 3, F.col("bits"), F.col("photometric") == 6, subsampled),
        }
    ).drop("colours")
