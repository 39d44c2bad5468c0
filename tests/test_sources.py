"""Files of our own writer, decoded and compared with their arrays."""

import io
import struct
import zlib

import numpy as np
import pytest

from tessella.operators import pages as page_rules
from tessella.sources import container as K
from tessella.sources import files
from tessella.sources.codecs import Params, ccitt, decode_block, jpeg, lzw, packbits


def rgb8(h=30, w=40):
    y, x = np.mgrid[:h, :w]
    out = np.stack([x * 255 // (w - 1), y * 255 // (h - 1), (x + y) % 256], axis=2).astype(np.uint8)
    out[10:20, 15:25] = (255, 0, 0)
    return out


def pack_packbits(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
        else:
            out += bytes([0, data[at]])
            at += 1
    return out


def pack_lzw(data: bytes) -> bytes:
    table, bits, width, last = {bytes([i]): i for i in range(256)}, "", 9, b""
    n = 258
    bits += format(256, "09b")
    for k in range(len(data)):
        now = last + data[k : k + 1]
        if now in table:
            last = now
            continue
        bits += format(table[last], f"0{width}b")
        table[now] = n
        n += 1
        last = data[k : k + 1]
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
        if n >= 4093:
            bits += format(256, f"0{width}b")
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    bits += format(table[last], f"0{width}b")
    n += 1
    bits += format(257, f"0{9 + (n >= 512) + (n >= 1024) + (n >= 2048)}b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


ENCODE = {1: lambda b: b, 5: pack_lzw, 8: zlib.compress, 32773: pack_packbits, 50000: zstd}


def tiff(image: np.ndarray, compression=1, tile=None, rows=7, planar=False, predictor=1, little=True, big=False, sample_format=1, photometric=None, subfile=0, **tags):
    h, w, spp = image.shape
    end = "<" if little else ">"
    raw = image.astype(image.dtype.newbyteorder(end))

    def diff(block):
        if predictor == 2:
            flat = block.astype(image.dtype)
            flat = np.diff(flat.view(f"u{flat.itemsize}"), axis=1, prepend=np.zeros((block.shape[0], 1, block.shape[2]), f"u{flat.itemsize}"))
            return flat.astype(flat.dtype.newbyteorder(end)).tobytes()
        if predictor == 3:
            size, (r, c, s) = image.dtype.itemsize, block.shape
            planes = np.frombuffer(block.astype(f">f{size}").tobytes(), np.uint8).reshape(r, c * s, size).transpose(0, 2, 1).reshape(r, c * size, s)
            return np.diff(planes, axis=1, prepend=np.zeros((r, 1, s), np.uint8)).tobytes()
        return block.tobytes()

    th, tw = tile or (rows, w)
    blocks = []
    for plane in range(spp if planar else 1):
        source = raw[:, :, plane : plane + 1] if planar else raw
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = source[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                blocks.append(ENCODE[compression](diff(np.ascontiguousarray(block))))
    own = {K.SUBFILE: subfile, K.WIDTH: w, K.HEIGHT: h, K.BITS: [image.dtype.itemsize * 8] * spp, K.COMPRESSION: compression, K.PHOTOMETRIC: photometric if photometric is not None else (2 if spp >= 3 else 1), K.SPP: spp, K.PLANAR: 2 if planar else 1, K.PREDICTOR: predictor, K.FORMAT: [sample_format] * spp}
    own |= {K.TILE_W: tw, K.TILE_H: th} if tile else {K.ROWS: rows}
    return {"tags": own | tags.get("more", {}), "blocks": blocks, "tiled": bool(tile)}


F32 = np.where(np.arange(30 * 40).reshape(30, 40, 1) % 37 == 0, np.nan, np.sin(np.arange(30 * 40).reshape(30, 40, 1) / 30)).astype(np.float32)
CASES = {
    "strips_none": (rgb8(), {}),
    "tiled_lzw_pred": (rgb8(), {"compression": 5, "tile": (16, 16), "predictor": 2}),
    "deflate_bigendian": (rgb8(), {"compression": 8, "little": False}),
    "packbits": (rgb8(), {"compression": 32773}),
    "planar": (rgb8(), {"planar": True}),
    "zstd_tiles": (rgb8(), {"compression": 50000, "tile": (16, 32)}),
    "gray16_big_lzw": ((np.arange(1200).reshape(30, 40, 1) * 50 + 1000).astype(np.uint16), {"compression": 5, "big": True, "predictor": 2}),
    "int16": (((np.arange(1200).reshape(30, 40, 1) - 600) * 50).astype(np.int16), {"sample_format": 2}),
    "float32_pred3": (F32, {"compression": 50000, "tile": (16, 16), "predictor": 3, "sample_format": 3}),
    "float64": (F32.astype(np.float64), {"sample_format": 3}),
    "int64": ((np.arange(1200).reshape(30, 40, 1)).astype(np.uint64), {}),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("rasters")
    for name, (image, how) in CASES.items():
        (at / f"{name}.tif").write_bytes(K.write_container([tiff(image, **how)], how.get("little", True), how.get("big", False)))
    levels = [rgb8(), rgb8()[::2, ::2], rgb8()[::4, ::4]]
    (at / "pyramid.tif").write_bytes(K.write_container([tiff(x, 8, (16, 16), subfile=int(k > 0)) for k, x in enumerate(levels)], big=True))
    (at / "broken.tif").write_bytes(b"II*\0garbage")
    (at / "notes.txt").write_bytes(b"no raster")
    return str(at)


@pytest.fixture(scope="module")
def ifds(spark, folder):
    return files.index(files.files(spark, folder)).persist()


def test_index(ifds):
    rows = {(r["path"].rsplit("/", 1)[1], r["ifd"]): r for r in ifds.collect()}
    assert len([k for k in rows if k[0] == "pyramid.tif"]) == 3 and rows["pyramid.tif", 0]["big"]
    assert rows["broken.tif", None]["error"] and not any(k[0] == "notes.txt" for k in rows)
    assert not rows["deflate_bigendian.tif", 0]["little"] and rows["planar.tif", 0]["planar"]


@pytest.mark.parametrize("name", CASES)
def test_whole_image(ifds, folder, name):
    image, _ = CASES[name]
    path = ifds.where(f"path like '%/{name}.tif'").first()["path"]
    got = files.read_window(ifds, path, 0, (0, 0, 40, 30)).toPandas()
    out = np.full(image.shape, -1.0)
    out[got.y, got.x, got.band] = got.v
    np.testing.assert_array_equal(out, image.astype(np.float64))


def test_window_reads_only_its_tiles(ifds):
    path = ifds.where("path like '%/pyramid.tif'").first()["path"]
    got = files.read_window(ifds, path, 0, (17, 1, 31, 15), [1]).toPandas()
    assert len(got) == 14 * 14 and set(got.band) == {1}
    np.testing.assert_array_equal(got.v, rgb8()[got.y, got.x, 1])


def test_pyramid_pages(spark, ifds):
    rows = page_rules.classify(ifds.where("error IS NULL").select("path", "ifd", "subfile", "width", "spp")).where("path like '%/pyramid.tif'").orderBy("ifd").collect()
    assert [(r["role"], r["page"]) for r in rows] == [("page", 0), ("level", 0), ("level", 0)]


def test_failing_block_leaves_the_others(spark, tmp_path):
    page = tiff(rgb8(), 8)
    page["blocks"][1] = b"not deflate"
    (tmp_path / "x.tif").write_bytes(K.write_container([page]))
    blocks = files.decode(files.runs(files.index(files.files(spark, str(tmp_path))))).collect()
    assert sum(b["error"] is not None for b in blocks) == 1 and len(blocks) == 5


def test_data_source(spark, folder):
    from tessella.sources.datasource import RasterSource

    spark.dataSource.register(RasterSource)
    got = spark.read.format("raster").option("path", folder).load().collect()
    assert sum(r["ifd"] is not None for r in got) == len(CASES) + 3 and sum(r["error"] is not None for r in got) == 1


def test_png(spark, tmp_path):
    rows = [("a", x, y, 10 * x, 20 * y, 0, 255) for x in range(3) for y in range(2)]
    made = files.write_png(spark.createDataFrame(rows, "id string, x int, y int, r int, g int, b int, a int"), str(tmp_path)).collect()
    data = open(made[0]["file"], "rb").read()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    body = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert body[1:9] == bytes([0, 0, 0, 255, 10, 0, 0, 255])


def test_run_codecs():
    data = bytes([1, 1, 1, 2, 3, 3] * 900 + list(range(256)) * 20)
    assert packbits(pack_packbits(data)) == data and lzw(pack_lzw(data)) == data


@pytest.mark.parametrize("bits", [1, 2, 4, 6, 12])
def test_bits_that_do_not_fill_bytes(bits):
    values = np.arange(5 * 7).reshape(5, 7) % (1 << bits)
    rows = ["".join(format(v, f"0{bits}b") for v in r) for r in values]
    data = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
    np.testing.assert_array_equal(decode_block(data, 1, Params(7, 5, 1, bits))[:, :, 0], values)


class Fax:
    """An encoder from the same published codes, for round trips."""

    def __init__(self):
        self.codes = [{n: c for c, n in t.items()} for t in ccitt.RUNS]
        self.modes = {m: c for c, m in ccitt.MODES.items()}

    def run(self, n, colour):
        out = ""
        while n >= 64:
            step = min(n // 64 * 64, 2560)
            out += self.codes[colour][step]
            n -= step
        return out + self.codes[colour][n]

    @staticmethod
    def changes(row):
        return [i for i in range(len(row)) if row[i] != (row[i - 1] if i else 0)]

    def one(self, row):
        edges = [0, *self.changes(row), len(row)]
        return "".join(self.run(b - a, k % 2) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))

    def two(self, row, above):
        w, a0, colour, out = len(row), -1, 0, ""
        own, up = self.changes(row), self.changes(above)
        while a0 < w:
            a1 = next((x for x in own if x > a0 and (row[x] != colour)), w)
            a2 = next((x for x in own if x > a1), w)
            k = next((k for k, x in enumerate(up) if x > a0 and k % 2 == colour), None)
            b1 = up[k] if k is not None else w
            b2 = up[k + 1] if k is not None and k + 1 < len(up) else w
            if b2 < a1:
                out, a0 = out + self.modes["P"], b2
            elif abs(a1 - b1) <= 3:
                out, a0, colour = out + self.modes[a1 - b1], a1, colour ^ 1
            else:
                out += self.modes["H"] + self.run(a1 - max(a0, 0), colour) + self.run(a2 - a1, colour ^ 1)
                a0 = a2
        return out


def _bytes(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_fax_codes_are_prefix_free():
    for table in ccitt.RUNS:
        assert len(table) == 64 + 27 + 13
        for a in table:
            assert not any(a != b and b.startswith(a) for b in table)


@pytest.mark.parametrize("kind", ["rle", "g3", "g32d", "g4"])
@pytest.mark.parametrize("fill", [1, 2])
def test_fax_round_trip(kind, fill):
    rng = np.random.RandomState(3)
    image = (rng.rand(40, 300) < 0.5).astype(int)
    image[5:15, 20:260] = 1
    image[20:30] = 0
    image[31] = image[30]
    fax, bits, above = Fax(), "", [0] * 300
    for y, row in enumerate(image.tolist()):
        if kind == "rle":
            bits += fax.one(row)
            bits += "0" * (-len(bits) % 8)
        elif kind == "g4":
            bits += fax.two(row, above)
        else:
            bits += "000000000001"
            two = kind == "g32d" and y % 4
            bits += ("0" if two else "1") if kind == "g32d" else ""
            bits += fax.two(row, above) if two else fax.one(row)
        above = row
    data = _bytes(bits)
    if fill == 2:
        data = bytes(int(format(b, "08b")[::-1], 2) for b in data)
    out = ccitt.decode(data, 300, 40, kind[:2] if kind != "rle" else kind, kind in ("g32d", "g4"), fill)
    np.testing.assert_array_equal(np.unpackbits(np.frombuffer(out, np.uint8).reshape(40, 38), axis=1)[:, :300], image)


def test_fax_keeps_rows_before_a_wrong_code():
    fax = Fax()
    out = ccitt.decode(_bytes(fax.one([1] * 16) + "0000000000000000"), 16, 3, "rle", False)
    assert out == b"\xff\xff\0\0\0\0"


def _jvm_jpeg(spark, image):
    jvm = spark._jvm
    h, w, _ = image.shape
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, image[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray())


def test_jpeg(spark):
    y, x = np.mgrid[:27, :35]
    image = np.stack([x * 7, y * 9, (x + y) * 4], axis=2).astype(np.uint8)
    raw = np.frombuffer(jpeg.decode(_jvm_jpeg(spark, image)), np.uint8).reshape(27, 35, 3).astype(float)
    cb, cr = raw[:, :, 1] - 128, raw[:, :, 2] - 128
    rgb = np.stack([raw[:, :, 0] + 1.402 * cr, raw[:, :, 0] - 0.344136 * cb - 0.714136 * cr, raw[:, :, 0] + 1.772 * cb], axis=2)
    assert np.abs(np.clip(rgb, 0, 255) - image).mean() < 4


def test_jpeg_with_shared_tables(spark):
    whole = _jvm_jpeg(spark, rgb8())
    first = whole.index(b"\xff\xc0")
    tables = b"\xff\xd8" + b"".join(_segment(whole, m) for m in (0xDB, 0xC4)) + b"\xff\xd9"
    short = b"\xff\xd8" + _segment(whole, 0xC0) + whole[whole.index(b"\xff\xda") :]
    assert first > 0 and jpeg.decode(short, tables) == jpeg.decode(whole)


def _segment(data, marker):
    out, at = b"", 2
    while data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big") + 2
        if data[at + 1] == marker:
            out += data[at : at + size]
        at += size
    return out


def test_read_at_is_cut_at_the_end(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    read_at, size = files.reader(str(tmp_path / "f"))
    assert (read_at(8, 10), read_at(20, 5), size) == (b"89", b"", 10)
    assert io.BytesIO(read_at(0, 3)).read() == b"012"
