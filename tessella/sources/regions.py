"""Regions of raster files from bytes to pictures: level choice, pruned and merged reads, means or nearest samples, tones, PNG.

A request asks for a window of a page at a size. It is answered from the narrowest level that is wide
enough; only blocks that the window, or its nearest samples, touch are read. Each task gives one rectangle
of sums for a row of blocks, and a request's rectangles are put together at the end, so what moves is as
large as what was asked for and not as the source. Requests whose rectangles fail carry an error text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import display, pages, region, stats
from tessella.sources.files import NEEDED, opened, read_tiles

#: Longest side of the overview that statistics are taken from, and the most blocks that it may read.
OVERVIEW, OVERVIEW_TILES = 512, 4096
REQUEST = ["id", "path", "page", "x0", "y0", "x1", "y1", "out_w", "out_h"]


def level_table(ifds: DataFrame) -> DataFrame:
    """A row for each level of each page: the directory's columns, path, page, level (0 is the widest), page_w and page_h."""
    return pages.levels(ifds.where("error IS NULL"))


def choose(levels: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with their level's columns, the window in it (lx0, ly0, lx1, ly1), the page's kind and samples, and how it is read."""
    chosen = region.choose_level(requests.withColumn("w", F.col("x1") - F.col("x0")), levels.select("path", "page", "level", F.col("width").alias("level_w")), ["path", "page"]).drop("w")
    both = chosen.join(levels, ["path", "page", "level"])
    full = F.col("level") == 0
    fx, fy = F.col("width") / F.col("page_w"), F.col("height") / F.col("page_h")
    x0, x1 = G.level_window("x0", "x1", fx, "width")
    y0, y1 = G.level_window("y0", "y1", fy, "height")
    window = {"lx0": F.when(full, F.col("x0")).otherwise(x0), "lx1": F.when(full, F.col("x1")).otherwise(x1), "ly0": F.when(full, F.col("y0")).otherwise(y0), "ly1": F.when(full, F.col("y1")).otherwise(y1)}
    both = display.described(both.withColumns({k: v.cast("long") for k, v in window.items()}))
    w, h = F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0")
    how = F.when((w == F.col("out_w")) & (h == F.col("out_h")), "exact").when((F.col("kind") != "palette") & (w * h <= region.MEAN_LIMIT), "mean").otherwise("nearest")
    return both.withColumn("how", how)


def _sampled(lo: str, hi: str, out: str, tile: str) -> Column:
    """Numbers of the blocks along a side that hold a nearest sample."""
    places = F.sequence(F.lit(0), F.col(out).cast("int") - 1)
    return F.array_distinct(F.transform(places, lambda i: F.floor(G.nearest_source(i, F.col(lo), F.col(hi), F.col(out)) / F.col(tile)).cast("long")))


def block_rows(chosen: DataFrame) -> DataFrame:
    """A row for each request and row of blocks (ty) that it needs."""
    first, after = G.tile_span("ly0", "ly1", "tile_height")
    every = F.sequence(first, F.greatest(first, after - 1))
    return chosen.withColumn("ty", F.explode(F.when(F.col("how") == "nearest", _sampled("ly0", "ly1", "out_h", "tile_height")).otherwise(every)))


def blocks_needed(chosen: DataFrame) -> DataFrame:
    """Per request: blocks that it reads, and that its level has."""
    first, after = G.tile_span("lx0", "lx1", "tile_width")
    top, bottom = G.tile_span("ly0", "ly1", "tile_height")
    sparse = F.col("how") == "nearest"
    across = F.when(sparse, F.size(_sampled("lx0", "lx1", "out_w", "tile_width"))).otherwise(after - first)
    down = F.when(sparse, F.size(_sampled("ly0", "ly1", "out_h", "tile_height"))).otherwise(bottom - top)
    return chosen.select("id", (across * down).cast("long").alias("blocks_read"), (F.col("across") * F.col("down")).alias("blocks"))


class _Axis:
    """Where source and output cells of one side meet."""

    def __init__(self, lo: int, hi: int, out: int, mean: bool):
        self.lo, self.hi, self.out, self.mean = lo, hi, out, mean
        span = hi - lo
        if mean:
            self.cell = np.minimum(out - 1, np.arange(span, dtype=np.int64) * out // span)  # of each source place
        else:
            self.place = np.minimum(hi - 1, lo + np.floor((np.arange(out) + 0.5) * span / out).astype(np.int64))  # of each output cell

    def cells(self, first: int, after: int) -> tuple[int, int]:
        """The output cells that source places from first to after touch."""
        first, after = max(first, self.lo), min(after, self.hi)
        if after <= first:
            return 0, 0
        if self.mean:
            return int(self.cell[first - self.lo]), int(self.cell[after - 1 - self.lo]) + 1
        return int(np.searchsorted(self.place, first)), int(np.searchsorted(self.place, after))

    def tiles(self, size: int) -> list[int]:
        if self.mean:
            return list(range(self.lo // size, -(-self.hi // size)))
        return np.unique(self.place // size).tolist()


def _rectangle(r: dict, ranges) -> tuple[int, np.ndarray] | str:
    """The first output row, and (counts, sums of each sample) by output cell, of one row of blocks. Where cells are sampled, counts are ones."""
    mean, samples = r["how"] == "mean", r["samples"]
    across, down = (_Axis(r[a], r[b], r[n], mean) for a, b, n in (("lx0", "lx1", "out_w"), ("ly0", "ly1", "out_h")))
    y_from = r["ty"] * r["tile_height"]
    top, bottom = down.cells(y_from, y_from + r["tile_height"])
    out = np.zeros((len(samples) + 1, max(0, bottom - top), r["out_w"]))
    for _, tx, planes in read_tiles(ranges, r, [(r["ty"], tx) for tx in across.tiles(r["tile_width"])], samples):
        lost = next((p for p in planes if isinstance(p, str)), None)
        if lost is not None:
            return lost
        bands = [p[:, :, 0] for p in planes] if r["planar"] else [planes[0][:, :, s] for s in samples]
        x_from = tx * r["tile_width"]
        h, w = bands[0].shape
        left, right = across.cells(x_from, x_from + w)
        if right <= left:
            continue
        if not mean:
            first, after = down.cells(y_from, y_from + h)
            rows, columns = down.place[first:after] - y_from, across.place[left:right] - x_from
            out[0, first - top : after - top, left:right] = 1
            for s, band in enumerate(bands):
                out[s + 1, first - top : after - top, left:right] = band[rows[:, None], columns[None, :]]
            continue
        a, b = max(0, down.lo - y_from), min(h, down.hi - y_from)
        c, d = max(0, across.lo - x_from), min(w, across.hi - x_from)
        cell = (down.cell[y_from + a - down.lo : y_from + b - down.lo] - top)[:, None] * r["out_w"] + across.cell[x_from + c - across.lo : x_from + d - across.lo][None, :]
        v = bands[0][a:b, c:d].astype(np.float64)
        good = ~np.isnan(v) if r["nodata"] is None else ~np.isnan(v) & (v != r["nodata"])
        flat = out.reshape(len(samples) + 1, -1)
        at, n = cell[good], flat.shape[1]
        flat[0] += np.bincount(at, minlength=n)
        for s, band in enumerate(bands):
            flat[s + 1] += np.bincount(at, band[a:b, c:d][good].astype(np.float64), n)
    return top, out


def rectangles(rows: DataFrame) -> DataFrame:
    """(id, out_w, out_h, bands, how, top, rows, data, error): what each row of blocks gives to its request."""
    schema = pa.schema([("id", pa.string()), ("out_w", pa.int32()), ("out_h", pa.int32()), ("bands", pa.int32()), ("how", pa.string()), ("top", pa.int32()), ("rows", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    made = _rectangle(r, opened(r["path"], held))
                except Exception as e:  # noqa: BLE001  the request's own row tells
                    made = str(e) or type(e).__name__
                row = {"id": r["id"], "out_w": r["out_w"], "out_h": r["out_h"], "bands": len(r["samples"]), "how": r["how"]}
                if isinstance(made, str):
                    row |= {"top": 0, "rows": 0, "data": None, "error": made}
                else:
                    row |= {"top": made[0], "rows": made[1].shape[1], "data": made[1].astype("<f8").tobytes(), "error": None}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    need = rows.select(F.col("id").cast("string").alias("id"), F.col("out_w").cast("int").alias("out_w"), F.col("out_h").cast("int").alias("out_h"), "lx0", "ly0", "lx1", "ly1", "ty", "how", "samples", "nodata", *NEEDED)
    need = need.repartition("path", "ifd", "ty").sortWithinPartitions("path", "ifd", "ty")
    return need.mapInArrow(run, "id string, out_w int, out_h int, bands int, how string, top int, rows int, data binary, error string")


def read_regions(levels: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, out_w, out_h, bands, data, error) of requests (``REQUEST`` columns): data holds the samples as doubles, band by band; cells that nothing falls in are NaN."""
    chosen = choose(levels, requests)
    why = F.col("unsupported")
    wrong = chosen.where(why.isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("out_w").cast("int").alias("out_w"), F.col("out_h").cast("int").alias("out_h"), F.size("samples").alias("bands"), F.lit(None).cast("binary").alias("data"), why.alias("error"))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        w, h, bands = int(first.out_w), int(first.out_h), int(first.bands)
        errors = pdf["error"].dropna()
        data = None
        if errors.empty:
            sums = np.zeros((bands + 1, h, w))
            for top, n, raw in zip(pdf["top"], pdf["rows"], pdf["data"], strict=True):
                sums[:, top : top + n] += np.frombuffer(raw, "<f8").reshape(bands + 1, n, w)
            with np.errstate(invalid="ignore", divide="ignore"):
                data = np.where(sums[0] > 0, sums[1:] / sums[0], np.nan).astype("<f8").tobytes()
        return pd.DataFrame({"id": [first["id"]], "out_w": [w], "out_h": [h], "bands": [bands], "data": [data], "error": [None if errors.empty else sorted(errors)[0]]})

    parts = rectangles(block_rows(chosen.where(why.isNull())))
    return parts.groupBy("id").applyInPandas(together, "id string, out_w int, out_h int, bands int, data binary, error string").union(wrong)


def cells(regions: DataFrame) -> DataFrame:
    """(id, x, y, v) of regions that could be read, v the samples of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["data"], "<f8").reshape(r["bands"], -1)
                k = np.arange(v.shape[1], dtype=np.int64)
                flat = np.ascontiguousarray(v.T).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, r["bands"], dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]] * len(k)), pa.array(k % r["out_w"]), pa.array(k // r["out_w"]), lists], names=["id", "x", "y", "v"])

    return regions.where("error IS NULL").select("id", "out_w", "bands", "data").mapInArrow(run, "id string, x long, y long, v array<double>")


def overviews(levels: DataFrame) -> DataFrame:
    """Requests for the overview of each page: its longer side 512, or halved until few enough blocks are read."""
    each = levels.where("level = 0").select("path", "page", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    side = F.least(F.lit(float(OVERVIEW)), F.greatest("width", "height").cast("double")) / F.pow(F.lit(2.0), F.col("step"))
    sized = each.withColumn("side", side).withColumn("out_w", G.overview_side("width", "height", F.col("side"))).withColumn("out_h", G.overview_side("height", "width", F.col("side")))
    asked = sized.select(F.concat_ws("|", "path", "page", "step").alias("id"), "path", "page", F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), "out_w", "out_h", "side", "step")
    read = choose(levels, asked).withColumn("few", F.least("across", "out_w") * F.least("down", "out_h") <= OVERVIEW_TILES)
    fits = read.where(F.col("few") | (F.col("side") <= 32)).groupBy("path", "page").agg(F.min("step").alias("step"))
    return asked.join(fits, ["path", "page", "step"]).select(F.concat_ws("|", "path", "page").alias("id"), "path", "page", "x0", "y0", "x1", "y1", "out_w", "out_h")


def page_stats(levels: DataFrame) -> DataFrame:
    """(path, page, lo, hi, p02, p98) of the pages whose tone can be adjusted, from their overviews."""
    adjustable = display.described(levels.where("level = 0")).where("tone_adjustable AND unsupported IS NULL").select("path", "page", "kind", "nodata")
    asked = overviews(levels).join(adjustable, ["path", "page"])
    read = read_regions(levels, asked.select(*REQUEST))
    seen = asked.select("id", "path", "page", "kind", "nodata")
    shown = F.when(F.col("kind") == "rgb", F.slice("v", 1, 3)).otherwise(F.slice("v", 1, 1))
    each = cells(read).join(read.select("id", "out_w", "out_h"), "id").join(seen, "id")
    values = each.select("path", "page", "nodata", (F.col("y") * F.col("out_w") + F.col("x")).alias("place"), (F.col("out_w") * F.col("out_h")).cast("long").alias("count"), F.explode(shown).alias("v"), F.size(shown).alias("bands"))
    got = stats.grouped(values, ["path", "page"])
    return adjustable.select("path", "page").join(got, ["path", "page"], "left").select("path", "page", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("lo", 0.0), ("hi", 1.0), ("p02", 0.0), ("p98", 1.0))])


def pictures(levels: DataFrame, requests: DataFrame, tone: str = "percentile", statistics: DataFrame | None = None) -> DataFrame:
    """(id, x, y, r, g, b, a) of requests."""
    shown = cells(read_regions(levels, requests))
    own = display.described(levels.where("level = 0")).select("path", "page", *display.NEEDED)
    own = own.join(page_stats(levels) if statistics is None else statistics, ["path", "page"], "left")
    asked = requests.select(F.col("id").cast("string").alias("id"), "path", "page").join(own, ["path", "page"])
    return display.rgba(shown.join(asked, "id"), tone).select("id", "x", "y", "r", "g", "b", "a")
