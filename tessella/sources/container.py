"""The tagged raster container: classic and 64-bit offsets, either byte order; its index, and a writer.

The index reads a file's directories only, and notes where the tables of its blocks stand. A file is read
through ``read_at`` (offset, length), so that neither the pixel data nor the tables of a large file are
touched here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

#: Fixed values of the public format: bytes and struct letter of each field type.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Tag numbers.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SPP, ROWS, STRIP_COUNTS, PLANAR, T4, PREDICTOR, COLOR_MAP = 254, 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 292, 317, 320
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT, JPEG_TABLES, SUBSAMPLING, GEO_KEYS, NODATA = 322, 323, 324, 325, 338, 339, 347, 530, 34735, 42113

ReadAt = Callable[[int, int], bytes]


class Table(NamedTuple):
    """Where the offsets or byte counts of a page's blocks stand: their field type, number and place. They are read entry by entry."""

    kind: int
    count: int
    at: int


@dataclass
class Directory:
    """One image directory, with the format's defaults for absent tags."""

    ifd: int
    little: bool
    tags: dict[int, tuple] = field(default_factory=dict)
    tables: dict[int, Table] = field(default_factory=dict)

    def one(self, tag: int, default: int) -> int:
        got = self.tags.get(tag)
        return int(got[0]) if got else default

    @property
    def width(self) -> int:
        return self.one(WIDTH, 0)

    @property
    def height(self) -> int:
        return self.one(HEIGHT, 0)

    @property
    def spp(self) -> int:
        return self.one(SPP, 1)

    @property
    def tiled(self) -> bool:
        return TILE_W in self.tags

    @property
    def tile_width(self) -> int:
        return self.one(TILE_W, self.width)

    @property
    def tile_height(self) -> int:
        return self.one(TILE_H, self.height) if self.tiled else min(self.one(ROWS, self.height), self.height)

    @property
    def bits(self) -> int:
        return self.one(BITS, 1)

    @property
    def photometric(self) -> int:
        return self.one(PHOTOMETRIC, 2 if self.spp >= 3 else 1)

    @property
    def planar(self) -> bool:
        return self.one(PLANAR, 1) == 2

    @property
    def nodata(self) -> float | None:
        text = self.text(NODATA)
        try:
            return float(text) if text else None
        except ValueError:
            return None

    @property
    def epsg(self) -> int | None:
        """A projected code, else a geographic one, if it is a code proper."""
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(3072, found.get(2048))
        return code if code is not None and 0 < code < 32767 else None

    def text(self, tag: int) -> str | None:
        got = self.tags.get(tag)
        return got[0].rstrip(b"\0").decode("utf-8", "replace").strip() or None if got and isinstance(got[0], bytes) else None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width) if self.tile_width else 0

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height) if self.tile_height else 0

    @property
    def offsets(self) -> Table:
        return self.tables.get(TILE_OFFSETS if self.tiled else STRIP_OFFSETS, Table(0, 0, 0))

    @property
    def counts(self) -> Table:
        return self.tables.get(TILE_COUNTS if self.tiled else STRIP_COUNTS, Table(0, 0, 0))


def entry_ranges(table: Table, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where a table's entries stand, as (offset, length), for runs [first, after) of them; beyond its end there are none."""
    size = TYPES[table.kind][0] if table.kind else 1
    return [(table.at + a * size, max(0, min(b, table.count) - a) * size) for a, b in runs]


def entries(table: Table, data: bytes, little: bool) -> list[int]:
    """Whole numbers of a table's bytes."""
    if not table.kind:
        return []
    size, letter = TYPES[table.kind]
    return list(struct.unpack(f"{'<' if little else '>'}{len(data) // size}{letter}", data[: len(data) // size * size]))


def directories(read_at: ReadAt) -> list[Directory]:
    """All directories of a file, in order. A loop ends the walk."""
    head = read_at(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a tagged raster file")
    little = head[:2] == b"II"
    end = "<" if little else ">"
    version = struct.unpack_from(end + "H", head, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"version {version} is not supported")
    big = version == 43
    word, entry, count_bytes = (8, 20, 8) if big else (4, 12, 2)
    at = struct.unpack_from(end + ("Q" if big else "I"), head, 8 if big else 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(end + ("Q" if big else "H"), read_at(at, count_bytes))[0]
        raw = read_at(at + count_bytes, n * entry + word)
        if len(raw) < n * entry:
            raise ValueError("a directory that the file's end cuts off")
        raw = raw.ljust(n * entry + word, b"\0")
        here = Directory(len(out), little)
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + ("HHQ" if big else "HHI"), raw, k * entry)
            size, letter = TYPES.get(kind, (0, ""))
            if not size:
                continue
            value = raw[k * entry + entry - word : (k + 1) * entry]
            if tag in (STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS):
                inside = at + count_bytes + k * entry + entry - word
                here.tables[tag] = Table(kind, count, inside if size * count <= word else struct.unpack(end + ("Q" if big else "I"), value)[0])
                continue
            data = value[: size * count] if size * count <= word else read_at(struct.unpack(end + ("Q" if big else "I"), value)[0], size * count)
            if len(data) < size * count:
                continue
            here.tags[tag] = (bytes(data),) if letter == "s" else struct.unpack(end + letter * count if len(letter) > 1 else f"{end}{count}{letter}", data)
        out.append(here)
        at = struct.unpack_from(end + ("Q" if big else "I"), raw, n * entry)[0]
    return out


def is_big(read_at: ReadAt) -> bool:
    head = read_at(0, 4)
    return head[2:4] in (b"\x2b\x00", b"\x00\x2b")


def write_container(pages: list[dict], little: bool = True, big: bool = False) -> bytes:
    """A file of pages, each a dict: ``tags`` (number: values), ``blocks`` (encoded tiles or strips), ``tiled``."""
    end, word = "<" if little else ">", 8 if big else 4
    out = bytearray((b"II" if little else b"MM") + struct.pack(end + "H", 43 if big else 42) + (struct.pack(end + "HHQ", 8, 0, 0) if big else struct.pack(end + "I", 0)))
    link = 8 if big else 4
    for page in pages:
        offsets = []
        for block in page["blocks"]:
            offsets.append(len(out))
            out += block
        tags = dict(page["tags"])
        tags[TILE_OFFSETS if page.get("tiled") else STRIP_OFFSETS] = offsets
        tags[TILE_COUNTS if page.get("tiled") else STRIP_COUNTS] = [len(b) for b in page["blocks"]]
        entries = []
        for tag, values in sorted(tags.items()):
            if isinstance(values, bytes):
                kind, count, data = 7 if tag == JPEG_TABLES else 2, len(values), values
            else:
                values = [values] if isinstance(values, int) else list(values)
                kind = 16 if big and tag in (STRIP_OFFSETS, TILE_OFFSETS) else 3 if max(values) < 65536 and tag not in (STRIP_OFFSETS, TILE_OFFSETS) else 4
                count, data = len(values), struct.pack(f"{end}{len(values)}{TYPES[kind][1]}", *values)
            if len(data) > word:
                place = len(out)
                out += data
                data = struct.pack(end + ("Q" if big else "I"), place)
            entries.append(struct.pack(end + ("HHQ" if big else "HHI"), tag, kind, count) + data.ljust(word, b"\0"))
        out += b"\0" * (len(out) % 2)
        here = len(out)
        out[link : link + word] = struct.pack(end + ("Q" if big else "I"), here)
        out += struct.pack(end + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * word
    return bytes(out)


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA picture (h, w, 4) as PNG."""
    h, w, _ = rgba.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + rgba[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
