"""From files to pictures: level choice, merged reads, means, tones, colours, alpha, statistics and errors, against numpy."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import rgb8, tiff

from tessella.functions import geometry as G
from tessella.operators import display, pages
from tessella.operators import requests as R
from tessella.sources import container as K
from tessella.sources import files, npy, regions
from tessella.sources.ranges import RangeSource, merged, source

H, W = 300, 400
Y, X = np.mgrid[:H, :W]
RGB = rgb8(H, W)
RGB[100:200, 150:250] = (255, 0, 0)
F32 = (np.sin(X / 30) * np.cos(Y / 25)).astype(np.float32)[:, :, None]
F32[:40, :40] = np.nan
INDEX = (RGB[:, :, 0] // 4)[:, :, None].astype(np.uint8)
MAP = [(i * 1009) % 65536 for i in range(256)] + [(i * 77 + 5) % 65536 for i in range(256)] + [65535 - i * 256 for i in range(256)]
BITS = ((X // 7 + Y // 5) % 2).astype(np.uint8)


def bilevel():
    packed = np.packbits(BITS, axis=1)
    return {"tags": {K.WIDTH: W, K.HEIGHT: H, K.COMPRESSION: 1, K.PHOTOMETRIC: 0, K.ROWS: 64}, "blocks": [packed[y : y + 64].tobytes() for y in range(0, H, 64)], "tiled": False}


def mean_of(image, h, w):
    """Box means by the rule, cell by cell."""
    rows, columns = np.arange(image.shape[0]) * h // image.shape[0], np.arange(image.shape[1]) * w // image.shape[1]
    out, n = np.zeros((h, w, image.shape[2])), np.zeros((h, w, 1))
    good = ~np.isnan(image[:, :, :1].astype(float))
    np.add.at(out, (rows[:, None], columns[None, :]), np.where(good, image, 0).astype(float))
    np.add.at(n, (rows[:, None], columns[None, :]), good.astype(float))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, out / n, np.nan)


PAGES = {
    "rgb": [tiff(RGB, 8, (64, 64), predictor=2)],
    "planar": [tiff(RGB, 1, planar=True, rows=50)],
    "rgba": [tiff(np.dstack([RGB, X * 255 // (W - 1)]).astype(np.uint8), 8, more={K.EXTRA: 2})],
    "premultiplied": [tiff(np.dstack([RGB // 2, np.full((H, W), 128)]).astype(np.uint8), 8, more={K.EXTRA: 1})],
    "gray16": [tiff((Y * 12 + 3000).astype(np.uint16)[:, :, None], 8)],
    "int16": [tiff(((X - 200) * 100).astype(np.int16)[:, :, None], 1, sample_format=2)],
    "float": [tiff(F32, 50000, (64, 64), predictor=3, sample_format=3)],
    "palette": [tiff(INDEX, 8, photometric=3, more={K.COLOR_MAP: MAP})],
    "cmyk": [tiff(np.dstack([255 - RGB, np.zeros((H, W, 1))]).astype(np.uint8), 8, photometric=5)],
    "nodata": [tiff((Y % 7).astype(np.uint8)[:, :, None], 8, more={K.NODATA: b"3\0"})],
    "bits": [bilevel()],
    "pages": [tiff(RGB, 1), tiff(RGB[::2, ::2], 1), tiff(RGB, 8, (128, 128))],
}
BIG = np.tile(RGB, (8, 8, 1))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pictures")
    for name, own in PAGES.items():
        (at / f"{name}.tif").write_bytes(K.write_container(own))
    levels = [tiff(BIG[::k, ::k], 8, (256, 256), subfile=int(k > 1)) for k in (1, 4, 2, 8)]
    (at / "pyramid.tif").write_bytes(K.write_container(levels, big=True))
    lost = tiff(RGB, 8, (64, 64))
    lost["blocks"][7] = b"not deflate"
    (at / "lost.tif").write_bytes(K.write_container([lost]))
    (at / "lerc.tif").write_bytes(K.write_container([tiff(RGB, 1) | {"tags": tiff(RGB, 1)["tags"] | {K.COMPRESSION: 34887}}]))
    (at / "broken.tif").write_bytes(b"II*\0garbage")
    return str(at)


@pytest.fixture(scope="module")
def levels(spark, folder):
    return regions.level_table(files.index(files.files(spark, folder))).persist()


def path_of(levels, name):
    return levels.where(F.col("path").endswith(f"/{name}.tif")).first()["path"]


def ask(spark, levels, rows):
    """Requests (name, page, window, size) whose ids are their numbers."""
    paths = {r["path"].rsplit("/", 1)[1][:-4]: r["path"] for r in levels.select("path").distinct().collect()}
    return spark.createDataFrame([(str(k), paths[name], page, *window, *size) for k, (name, page, window, size) in enumerate(rows)], "id string, path string, page int, x0 long, y0 long, x1 long, y1 long, out_w long, out_h long")


def arrays(got):
    return {int(r["id"]): np.frombuffer(r["data"], "<f8").reshape(r["bands"], r["out_h"], r["out_w"]).transpose(1, 2, 0) if r["data"] is not None else r["error"] for r in got.collect()}


def rasters(rgba):
    out = {}
    for k, pdf in rgba.toPandas().groupby("id"):
        out[int(k)] = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1, 4), int)
        out[int(k)][pdf.y, pdf.x] = pdf[["r", "g", "b", "a"]]
    return out


WHOLE = (0, 0, W, H)


def test_level_table(levels):
    own = levels.where(F.col("path").endswith("/pyramid.tif")).orderBy("level").collect()
    assert [(r["width"], r["height"], r["ifd"]) for r in own] == [(3200, 2400, 0), (1600, 1200, 2), (800, 600, 1), (400, 300, 3)] and all(r["page_w"] == 3200 and r["big"] for r in own)
    pages_ = levels.where(F.col("path").endswith("/pages.tif")).orderBy("page").collect()
    assert [(r["page"], r["width"], r["height"]) for r in pages_] == [(0, 400, 300), (1, 200, 150), (2, 400, 300)]


def test_regions_against_numpy(spark, levels):
    window = (37, 11, 301, 223)
    asked = [("rgb", 0, WHOLE, (W, H)), ("rgb", 0, WHOLE, (100, 75)), ("rgb", 0, window, (41, 37)), ("planar", 0, window, (264, 212)), ("palette", 0, WHOLE, (9, 40)), ("float", 0, WHOLE, (33, 21)), ("rgb", 0, (10, 10, 20, 20), (30, 25))]
    asked += [("pyramid", 0, (0, 0, 3200, 2400), (W, H)), ("pyramid", 0, (0, 0, 3200, 2400), (300, 225)), ("pyramid", 0, (1600, 800, 2400, 1400), (200, 150)), ("pyramid", 0, (801, 5, 1001, 205), (200, 200))]
    asked += [("lost", 0, WHOLE, (40, 30)), ("lost", 0, (0, 0, 64, 64), (64, 64)), ("lerc", 0, WHOLE, (40, 30)), ("nodata", 0, WHOLE, (50, 60))]
    got = arrays(regions.read_regions(levels, ask(spark, levels, asked)))
    x0, y0, x1, y1 = window
    part = RGB[y0:y1, x0:x1]
    np.testing.assert_array_equal(got[0], RGB)
    np.testing.assert_allclose(got[1], mean_of(RGB, 75, 100))
    np.testing.assert_allclose(got[2], mean_of(part, 37, 41))
    np.testing.assert_array_equal(got[3], part)
    near = lambda n, out: np.minimum(n - 1, np.floor((np.arange(out) + 0.5) * n / out).astype(int))
    np.testing.assert_array_equal(got[4], INDEX[near(H, 40)][:, near(W, 9)])
    np.testing.assert_allclose(got[5], mean_of(F32, 21, 33), rtol=1e-6)
    assert np.isnan(got[6]).any() and np.nanmax(got[6]) <= 255  # a mean to a larger size leaves holes
    np.testing.assert_array_equal(got[7], BIG[::8, ::8])  # the narrowest level that is wide enough, as it is
    np.testing.assert_allclose(got[8], mean_of(BIG[::8, ::8], 225, 300))
    np.testing.assert_array_equal(got[9], BIG[::4, ::4][200:350, 400:600])
    np.testing.assert_array_equal(got[10], BIG[5:205, 801:1001])
    assert "Error" in got[11] or "incorrect" in got[11] or "invalid" in got[11].lower()
    np.testing.assert_array_equal(got[12], RGB[:64, :64])
    assert got[13] == "LERC compression is not supported."
    np.testing.assert_allclose(got[14], mean_of(np.where(Y % 7 == 3, np.nan, Y % 7)[:, :, None], 60, 50))


def test_few_merged_reads_for_a_preview(levels, folder):
    """Opening a pyramid and reading its 400 x 300 preview takes fewer than twenty trips, and no table or block of another level is read."""
    ranges = source(f"{folder}/pyramid.tif")
    found = K.directories(ranges)
    opening = ranges.trips
    d = found[3]
    r = files._described("", ranges.size, True, d)
    tiles = list(files.read_tiles(ranges, r, [(ty, tx) for ty in range(d.down) for tx in range(d.across)], [0]))
    assert len(tiles) == 4 and all(isinstance(p, np.ndarray) for _, _, planes in tiles for p in planes)
    assert opening <= 6 and ranges.trips < 20 and ranges.bytes_read < ranges.size / 4


def test_sparse_requests_need_few_blocks(spark, levels, monkeypatch):
    from tessella.operators import region

    monkeypatch.setattr(region, "MEAN_LIMIT", 0)
    need = regions.blocks_needed(regions.choose(levels.where("level = 0"), ask(spark, levels, [("pyramid", 0, (0, 0, 3200, 2400), (5, 4)), ("pyramid", 0, (0, 0, 3200, 2400), (60, 40))]))).orderBy("id").collect()
    assert [(r["blocks_read"], r["blocks"]) for r in need] == [(20, 130), (130, 130)]
    got = arrays(regions.read_regions(levels.where("level = 0"), ask(spark, levels, [("pyramid", 0, (0, 0, 3200, 2400), (5, 4))])))[0]
    near = lambda n, out: np.floor((np.arange(out) + 0.5) * n / out).astype(int)
    np.testing.assert_array_equal(got, BIG[near(2400, 4)][:, near(3200, 5)])


def test_statistics(levels):
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in regions.page_stats(levels).where("page = 0").collect()}
    assert set(got) == {"gray16", "int16", "float"}
    for name, image in (("gray16", Y * 12 + 3000), ("int16", (X - 200) * 100), ("float", F32[:, :, 0])):
        v = np.sort(image[~np.isnan(image.astype(float))].ravel().astype(float))
        want = [v[0], v[-1], v[int(0.02 * (len(v) - 1))], v[int(0.98 * (len(v) - 1))]]
        assert [got[name][c] for c in ("lo", "hi", "p02", "p98")] == pytest.approx(want)


def test_pictures(spark, levels, tmp_path):
    names = ["rgb", "planar", "rgba", "premultiplied", "gray16", "int16", "float", "palette", "cmyk", "nodata", "bits"]
    asked = ask(spark, levels, [(n, 0, WHOLE, (W, H)) for n in names])
    shown = regions.pictures(levels, asked, "minmax").persist()
    made = rasters(shown)
    out = {n: made[k] for k, n in enumerate(names)}
    for n in ("rgb", "planar", "rgba", "cmyk"):
        np.testing.assert_allclose(out[n][:, :, :3], RGB, atol=1)
    assert (out["rgb"][:, :, 3] == 255).all() and (out["rgba"][:, 0, 3] == 0).all() and (out["rgba"][:, W - 1, 3] == 255).all()
    np.testing.assert_allclose(out["premultiplied"][:, :, :3], np.minimum(255, np.rint((RGB // 2).astype(float) * 255 / 128)), atol=1)
    assert (out["gray16"][0, :, 0] == 0).all() and (out["gray16"][H - 1, :, 0] == 255).all()
    assert (out["int16"][:, 0, 0] == 0).all() and (out["int16"][:, W - 1, 0] == 255).all()
    assert out["float"][5, 5, 3] == 0 and out["float"][200, 200, 3] == 255
    for k in range(3):
        np.testing.assert_array_equal(out["palette"][:, :, k], np.rint(np.array(MAP)[INDEX[:, :, 0].astype(int) + 256 * k] / 257).astype(int))
    assert ((out["nodata"][:, :, 3] == 0) == (Y % 7 == 3)).all()
    np.testing.assert_array_equal(out["bits"][:, :, 0], 255 - 255 * BITS)
    full = rasters(regions.pictures(levels, ask(spark, levels, [("gray16", 0, WHOLE, (W, H))]), "full"))[0]
    assert full[H - 1].max() in range(0, 256) and (full[H - 1, :, 0] < 40).all()
    made = {r["id"]: r["file"] for r in files.write_png(shown, str(tmp_path)).collect()}
    data = open(made["0"], "rb").read()
    assert struct.unpack(">II", data[16:24]) == (W, H)
    body = np.frombuffer(zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]), np.uint8).reshape(H, 1 + 4 * W)[:, 1:].reshape(H, W, 4)
    np.testing.assert_array_equal(body, out["rgb"])


def test_lab(spark):
    """Whole numbers of eight bits: a gray axis and a red."""
    page = {"kind": "lab", "bits": 8, "sample_format": 1, "nodata": None, "color_map": None, "white_is_zero": False, "has_alpha": False, "alpha_associated": False, "tone_adjustable": False, "lo": None, "hi": None, "p02": None, "p98": None}
    schema = "v array<double>, kind string, bits int, sample_format int, nodata double, color_map array<int>, white_is_zero boolean, has_alpha boolean, alpha_associated boolean, tone_adjustable boolean, lo double, hi double, p02 double, p98 double"
    rows = [([255.0, 0.0, 0.0], *page.values()), ([0.0, 0.0, 0.0], *page.values()), ([137.0, 81.0, 70.0], *page.values()), ([float("nan"), 0.0, 0.0], *page.values())]
    got = [tuple(r[c] for c in "rgba") for r in display.rgba(spark.createDataFrame(rows, schema)).collect()]
    assert min(got[0]) >= 254 and got[1] == (0, 0, 0, 255) and got[2][0] > 240 and got[2][1] < 30 and got[3] == (0, 0, 0, 0)


def test_information(levels):
    rows = pages.info(levels).where(F.col("path").endswith("/pyramid.tif")).orderBy("place").collect()
    shown = {r["label"]: r["value"] for r in rows}
    assert shown["Format"] == "BigTIFF (64-bit offsets)" and shown["Pyramid levels"] == "3200×2400, 1600×1200, 800×600, 400×300" and shown["Layout"] == "Tiles 256 × 256"
    assert shown["Samples per pixel"] == "3 (R, G, B)" and shown["Bits per sample"] == "8, 8, 8" and shown["Compression"] == "Deflate" and shown["Pages"] == "1" and shown["Name"] == "pyramid.tif"
    assert [r["section"] for r in rows][:6] == ["File"] * 6 and rows[6]["section"] == "Image"
    other = {r["label"]: r["value"] for r in pages.info(levels).where(F.col("path").endswith("/nodata.tif")).collect()}
    assert other["NoData"] == "3" and other["Layout"] == "Strips of 7 rows" and "Predictor" not in other


def test_tiles_of_a_level(levels):
    got = files.tiles(levels.where(F.col("path").endswith("/planar.tif")).drop("page", "level", "page_w", "page_h")).collect()
    assert len(got) == 3 * 6 and len({r["offset"] for r in got}) == 18 and all(r["byte_count"] == 50 * W for r in got)


def test_whole_numbers_beyond_doubles(spark, tmp_path):
    image = (np.arange(12, dtype=np.int64).reshape(3, 4, 1) + (1 << 60))
    (tmp_path / "x.tif").write_bytes(K.write_container([tiff(image, 1, sample_format=2)]))
    ifds = files.index(files.files(spark, str(tmp_path)))
    got = files.read_window(ifds, ifds.first()["path"], 0, (0, 0, 4, 3), whole=True).collect()
    assert {(r["x"], r["y"]): r["v"] for r in got} == {(x, y): (1 << 60) + y * 4 + x for y in range(3) for x in range(4)}


def test_lost_files_fail_alone(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(K.write_container([tiff(RGB[:30, :40], 1)]))
    (tmp_path / "b.tif").write_bytes(K.write_container([tiff(RGB[:30, :40], 1)]))
    ifds = files.index(files.files(spark, str(tmp_path))).persist()
    assert ifds.count() == 2
    (tmp_path / "b.tif").unlink()
    got = files.decode(files.runs(ifds)).collect()
    assert {r["path"][-5:]: r["error"] is None for r in got} == {"a.tif": True, "b.tif": False}


def test_range_source():
    data = bytes(range(256)) * 4096
    ranges = RangeSource(lambda o, n: data[o : o + n], len(data))
    asked = [(5, 10), (70_000, 100), (65_530, 20), (300_000, 50_000), (350_000, 20_000), (len(data) - 3, 10), (len(data) + 5, 10), (9, 0)]
    assert ranges.fetch(asked) == [data[o : o + n] for o, n in asked]
    assert ranges.trips == 1 and ranges.reads == 3  # three merged reads
    before = ranges.reads
    assert ranges(100, 50) == data[100:150] and ranges.reads == before
    assert merged([(0, 10), (5, 30), (30, 40), (50, 60)], 35) == [(0, 30), (30, 40), (50, 60)]


def test_npy(tmp_path):
    for image in (np.arange(24).reshape(2, 3, 4), np.asfortranarray(np.ones((3, 5), "<f4")), np.zeros((0, 2), ">i2")):
        np.save(tmp_path / "x.npy", image)
        np.testing.assert_array_equal(npy.read(source(str(tmp_path / "x.npy"))), image)


def test_display_tiles(spark, tmp_path):
    rows = [(2, 1, 0, 7, final, x, y, 10 * x, 0, 0, 255) for final in (True, False) for x in range(4) for y in range(3)]
    df = spark.createDataFrame(rows, "z int, i int, j int, generation long, final boolean, x int, y int, r int, g int, b int, a int")
    made = {r["final"]: r["file"] for r in files.write_tiles(df, str(tmp_path)).collect()}
    assert made[True].endswith("/2/1/0.png") and made[False].endswith("/2/1/0-part-7.png")
    assert open(made[True], "rb").read()[:8] == b"\x89PNG\r\n\x1a\n"


def test_paced_results(spark):
    rows = [("a", 1000, 1000 + t, k, 40) for k, t in enumerate(range(0, 8000, 200))] + [("a", 1000, 9000, 40, 40), ("b", 0, 700, 1, 2), ("b", 0, 750, 2, 2)]
    steps = spark.createDataFrame(rows, "tile string, began long, ms long, done long, total long")
    part = sorted((r["tile"], r["ms"] - r["began"]) for r in R.partial_results(steps, ["tile"]).collect())
    assert part == [("a", 600), ("a", 2200), ("a", 3800), ("a", 5400), ("a", 7000), ("b", 700)]
    told = [r["ms"] for r in R.progress(steps.where("tile = 'a'"), ["tile"]).orderBy("ms").collect()]
    assert told[0] == 1000 and all(b - a > 200 for a, b in zip(told, told[1:])) and told[-1] == 9000


def test_rows_of_a_running_read(spark):
    q = spark.createDataFrame([(0, 10, 5, 4), (0, 10, 5, 10), (0, 10, 4, 5)], "lo long, hi long, n long, bottom long")
    got = q.select(G.final_rows("bottom", "lo", "hi", "n", True).alias("m"), G.final_rows("bottom", "lo", "hi", "n", False).alias("s")).collect()
    assert [tuple(r) for r in got] == [(2, 2), (5, 5), (2, 2)]
