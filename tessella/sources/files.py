"""From files to DataFrames: an index of directories, then block reads pruned by the window, then pixels.

``index`` opens each file once and gives a row for each directory, with the places of its block tables.
Everything afterwards reads the entries that it needs of these, and then the blocks, in merged reads. What
fails, a file, a block or a table, gives an error text in its own rows and stops nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.functions import geometry as G
from tessella.operators import region
from tessella.sources import container
from tessella.sources.codecs import Params, decode_block
from tessella.sources.ranges import RangeSource, reader, source

__all__ = ["decode", "files", "index", "pixels", "read_window", "reader", "runs", "tiles", "write_png", "write_tiles"]

PATTERN = "*.{tif,tiff,TIF,TIFF,btf,tf8,tf2}"
#: Blocks that are read and decoded at once, and the decoded bytes of these.
BATCH_TILES, BATCH_BYTES = 16, 64 << 20
#: Numbers of the tags whose texts are shown, by label.
TEXT_TAGS = {"Document name": 269, "Page name": 285, "Description": 270, "Make": 271, "Model": 272, "Software": 305, "Date/time": 306, "Artist": 315, "Host computer": 316, "Copyright": 33432}
X_RESOLUTION, Y_RESOLUTION, RESOLUTION_UNIT = 282, 283, 296
GEO_TAGS = (34735, 33922, 33550, 34264)
IFD_SCHEMA = (
    "path string, size long, big boolean, little boolean, ifd int, subfile int, width long, height long, spp long, bits int, all_bits array<int>, sample_format int, compression int, photometric int, planar boolean, tiled boolean, "
    "tile_width int, tile_height int, across long, down long, predictor int, fill_order int, t4_options int, nodata double, epsg int, has_geo boolean, tables binary, color_map array<int>, extra int, subsampling array<int>, "
    "texts map<string,string>, x_resolution array<long>, y_resolution array<long>, resolution_unit int, "
    "offsets struct<kind:int,count:long,at:long>, counts struct<kind:int,count:long,at:long>, error string"
)
BLOCK_SCHEMA = "path string, ifd int, tx int, ty int, plane int, x0 long, y0 long, w int, h int, samples int, dtype string, data binary, error string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the raster files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", "true").load(folder).select("path")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _described(path: str, size: int, big: bool, d: container.Directory) -> dict:
    K = container
    texts = {label: text for label, tag in TEXT_TAGS.items() if (text := d.text(tag))}
    numbers = lambda tag: [int(x) for x in d.tags[tag]] if tag in d.tags else None
    return {
        "path": path, "size": size, "big": big, "little": d.little, "ifd": d.ifd, "subfile": d.one(K.SUBFILE, 0), "width": d.width, "height": d.height, "spp": d.spp, "bits": d.bits,
        "all_bits": numbers(K.BITS) or [1] * d.spp, "sample_format": d.one(K.FORMAT, 1), "compression": d.one(K.COMPRESSION, 1), "photometric": d.photometric, "planar": d.planar, "tiled": d.tiled,
        "tile_width": d.tile_width, "tile_height": d.tile_height, "across": d.across, "down": d.down, "predictor": d.one(K.PREDICTOR, 1), "fill_order": d.one(K.FILL_ORDER, 1), "t4_options": d.one(K.T4, 0),
        "nodata": d.nodata, "epsg": d.epsg, "has_geo": any(t in d.tags for t in GEO_TAGS), "tables": bytes(d.tags[K.JPEG_TABLES]) if K.JPEG_TABLES in d.tags else None,
        "color_map": numbers(K.COLOR_MAP), "extra": d.one(K.EXTRA, 0), "subsampling": numbers(K.SUBSAMPLING), "texts": texts, "x_resolution": numbers(X_RESOLUTION), "y_resolution": numbers(Y_RESOLUTION),
        "resolution_unit": d.one(RESOLUTION_UNIT, 2), "offsets": d.offsets._asdict(), "counts": d.counts._asdict(), "error": None,
    }


def index(paths: DataFrame) -> DataFrame:
    """One row for each directory of each file (``path``); a file that can't be read gives a row with the error."""

    def rows(path: str, empty: dict) -> list[dict]:
        try:
            ranges = source(path)
            big = container.is_big(ranges)
            return [_described(path, ranges.size, big, d) for d in container.directories(ranges)]
        except Exception as e:  # noqa: BLE001  the file's own row tells
            return [empty | {"path": path, "error": str(e) or type(e).__name__}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_of
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(rows(path, dict.fromkeys(arrow.names)), schema=arrow)

    _arrow_of = _arrow(IFD_SCHEMA)
    return paths.select("path").mapInArrow(run, IFD_SCHEMA)


def runs(ifds: DataFrame, window: tuple | None = None) -> DataFrame:
    """The rows of blocks that a window (all of a page without one) touches: a page's columns, ty, and tx0 to tx1. No table is read for this."""
    x0, y0, x1, y1 = (F.lit(0), F.lit(0), F.col("width"), F.col("height")) if window is None else (G.col(v) for v in window)
    good = ifds.where("error IS NULL AND width > 0 AND height > 0 AND tile_width > 0 AND tile_height > 0")
    lo, hi = G.tile_span(F.greatest(x0, F.lit(0)), F.least(x1, F.col("width")), F.col("tile_width"))
    top, bottom = G.tile_span(F.greatest(y0, F.lit(0)), F.least(y1, F.col("height")), F.col("tile_height"))
    found = good.withColumn("tx0", lo).withColumn("tx1", hi).withColumn("top", top).withColumn("bottom", bottom).where("tx1 > tx0 AND bottom > top")
    return found.withColumn("ty", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1))).drop("top", "bottom")


def places(ranges: RangeSource, r: dict, wanted: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(offset, byte count) of blocks (plane, ty, tx) of a page, from the entries of its tables alone; (0, 0) where a table has none."""
    numbers = [((plane * r["down"] if r["planar"] else 0) + ty) * r["across"] + tx for plane, ty, tx in wanted]
    both = [container.Table(**r["offsets"]), container.Table(**r["counts"])]
    data = ranges.fetch([x for table in both for x in container.entry_ranges(table, [(k, k + 1) for k in numbers])])
    values = [container.entries(both[i // len(numbers)], d, r["little"]) for i, d in enumerate(data)]
    first, second = values[: len(numbers)], values[len(numbers) :]
    return [(a[0], b[0]) if a and b else (0, 0) for a, b in zip(first, second, strict=True)]


def read_tiles(ranges: RangeSource, r: dict, wanted: list[tuple[int, int]], planes: list[int]) -> Iterator[tuple[int, int, list[np.ndarray | str]]]:
    """ty, tx and the decoded planes of blocks, in batches of one trip; an error text stands for what can't be read. Blocks are cut at the image's edges."""
    samples = 1 if r["planar"] else r["spp"]
    planes = planes if r["planar"] else [0]
    one = max(1, r["tile_width"] * r["tile_height"] * samples * len(planes) * max(1, r["bits"] // 8))
    batch = max(1, min(BATCH_TILES, BATCH_BYTES // one))
    for k in range(0, len(wanted), batch):
        some = wanted[k : k + batch]
        keys = [(plane, ty, tx) for ty, tx in some for plane in planes]
        try:
            data: list = ranges.fetch(places(ranges, r, keys))
        except Exception as e:  # noqa: BLE001  the blocks' own rows tell
            data = [str(e) or type(e).__name__] * len(keys)
        for i, (ty, tx) in enumerate(some):
            y0, x0 = ty * r["tile_height"], tx * r["tile_width"]
            rows = r["tile_height"] if r["tiled"] else min(r["tile_height"], r["height"] - y0)
            h, w = min(rows, r["height"] - y0), min(r["tile_width"], r["width"] - x0)
            out: list[np.ndarray | str] = []
            for raw in data[i * len(planes) : (i + 1) * len(planes)]:
                try:
                    if isinstance(raw, str):
                        raise ValueError(raw)
                    if not raw:
                        raise ValueError("a block without bytes")
                    p = Params(r["tile_width"], rows, samples, r["bits"], r["sample_format"], r["little"], r["predictor"], r["fill_order"], r["t4_options"], r["tables"])
                    out.append(decode_block(raw, r["compression"], p)[:h, :w])
                except Exception as e:  # noqa: BLE001  one bad block does not fail the others
                    out.append(str(e) or type(e).__name__)
            yield ty, tx, out


#: What reading blocks needs of a page.
NEEDED = "path ifd width height spp bits sample_format compression planar tiled tile_width tile_height across down predictor fill_order t4_options little tables offsets counts".split()


def opened(path: str, held: list) -> RangeSource:
    """The source of a path; that of the last one is held."""
    if not held or held[0] != path:
        held[:] = [path, source(path)]
    return held[1]


def tiles(ifds: DataFrame) -> DataFrame:
    """The tile index as rows: a page's columns, with tx, ty, plane, offset and byte_count of each block, read a row of blocks at a time."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in ifds.schema if f.name != "error"]
    schema = ", ".join([*names, "tx int", "ty int", "plane int", "offset long", "byte_count long"])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in batch.to_pylist():
                keys = [(p, r["ty"], tx) for p in range(r["spp"] if r["planar"] else 1) for tx in range(r["tx0"], r["tx1"])]
                own = {k: v for k, v in r.items() if k not in ("tx0", "tx1")}
                found = places(opened(r["path"], held), r, keys)
                yield pa.RecordBatch.from_pylist([own | {"tx": tx, "ty": ty, "plane": p, "offset": o, "byte_count": n} for (p, ty, tx), (o, n) in zip(keys, found, strict=True)], schema=arrow)

    return runs(ifds).drop("error").mapInArrow(run, schema)


def decode(tile_runs: DataFrame, planes: list[int] | None = None) -> DataFrame:
    """``BLOCK_SCHEMA`` rows of ``runs``: blocks in their own sample type, row by row; of planar pages only the planes asked for."""
    arrow = _arrow(BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in batch.to_pylist():
                every = list(range(r["spp"])) if r["planar"] else [0]
                own = [p for p in every if planes is None or not r["planar"] or p in planes]
                wanted = [(r["ty"], tx) for tx in range(r["tx0"], r["tx1"])]
                try:
                    found = read_tiles(opened(r["path"], held), r, wanted, own)
                    first = next(found, None)
                except Exception as e:  # noqa: BLE001  a lost file's rows tell
                    found, first = iter(()), None
                    lost = [(ty, tx, [str(e) or type(e).__name__] * len(own)) for ty, tx in wanted]
                else:
                    lost = []
                out: list[dict] = []
                for ty, tx, blocks in [*([first] if first else []), *lost]:
                    out += _rows(r, ty, tx, own, blocks)
                for ty, tx, blocks in found:
                    if len(out) >= BATCH_TILES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                    out += _rows(r, ty, tx, own, blocks)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    need = tile_runs.select(*NEEDED, "ty", "tx0", "tx1")
    return need.repartition("path", "ifd", "ty").sortWithinPartitions("path", "ifd", "ty").mapInArrow(run, BLOCK_SCHEMA)


def _rows(r: dict, ty: int, tx: int, planes: list[int], blocks: list[np.ndarray | str]) -> list[dict]:
    out = []
    for plane, block in zip(planes, blocks, strict=True):
        row = {"path": r["path"], "ifd": r["ifd"], "tx": tx, "ty": ty, "plane": plane, "x0": tx * r["tile_width"], "y0": ty * r["tile_height"], "samples": 1 if r["planar"] else r["spp"]}
        if isinstance(block, str):
            out.append(row | {"w": 0, "h": 0, "dtype": None, "data": None, "error": block})
        else:
            plain = np.ascontiguousarray(block.astype(block.dtype.newbyteorder("<")))
            out.append(row | {"w": block.shape[1], "h": block.shape[0], "dtype": plain.dtype.newbyteorder("<").str, "data": plain.tobytes(), "error": None})
    return out


def pixels(blocks: DataFrame, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(x, y, band, v) of decoded blocks, and the block columns that ``keep`` names. ``whole``: v is a long, for integers beyond 53 bits."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "x long", "y long", "band int", f"v {'long' if whole else 'double'}"])
    arrow = _arrow(schema)
    need = ["x0", "y0", "w", "samples", "plane", "dtype", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["data"], r["dtype"])
                for at in range(0, len(v), 1 << 18):  # a block may be a whole image
                    some = v[at : at + (1 << 18)]
                    k = at + np.arange(len(some))
                    cell, band = k // r["samples"], k % r["samples"]
                    columns = [pa.array([r[c]] * len(some), arrow.field(c).type) for c in keep]
                    columns += [pa.array(r["x0"] + cell % r["w"]), pa.array(r["y0"] + cell // r["w"]), pa.array((band + r["plane"]).astype(np.int32)), pa.array(some.astype(np.int64 if whole else np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return blocks.where("error IS NULL").select(*keep, *need).mapInArrow(run, schema)


def read_window(ifds: DataFrame, path: str, ifd: int, window: tuple[int, int, int, int], bands: list[int] | None = None, whole: bool = False) -> DataFrame:
    """(x, y, band, v) of a window: only blocks that it touches, and of planar files only the planes asked for, are read."""
    page = ifds.where((F.col("path") == path) & (F.col("ifd") == ifd))
    out = region.clip(pixels(decode(runs(page, window), bands), whole=whole), *window)
    return (out if bands is None else out.where(F.col("band").isin(bands))).select("x", "y", "band", "v")


def _picture(pdf) -> np.ndarray:
    """An RGBA array of pixel rows (x, y, r, g, b, a)."""
    out = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, 4), np.uint8)
    out[pdf.y, pdf.x] = pdf[["r", "g", "b", "a"]]
    return out


def _write(folder: str, name: str, data: bytes) -> str:
    import pyarrow.fs

    fs, at = (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith(("/", "file:")) else pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{at}/{name}") as f:
        f.write(data)
    return f"{folder}/{name}"


def write_png(rgba: DataFrame, folder: str) -> DataFrame:
    """Write pictures (id, x, y, r, g, b, a) as PNG files, one for each id; returns id and file. A picture must fit a task."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf["id"].iloc[0])
        return pd.DataFrame({"id": [name], "file": [_write(folder, name.replace("/", "-") + ".png", container.png(_picture(pdf)))]})

    return rgba.groupBy("id").applyInPandas(one, "id string, file string")


def write_tiles(rgba: DataFrame, folder: str) -> DataFrame:
    """Write display tiles (z, i, j, generation, final, x, y, r, g, b, a) as z/i/j.png; returns z, i, j, generation, final and file.

    A tile that is not final yet has a name of its own, so that a finished picture is never replaced by a part of it.
    """
    import pandas as pd

    keys = ["z", "i", "j", "generation", "final"]
    kinds = {f.name: f.dataType.simpleString() for f in rgba.schema}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j, generation, final = key
        name = f"{z}/{i}/{j}" + ("" if final else f"-part-{generation}") + ".png"
        return pd.DataFrame([[*key, _write(folder, name, container.png(_picture(pdf)))]], columns=[*keys, "file"])

    return rgba.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", file string")


