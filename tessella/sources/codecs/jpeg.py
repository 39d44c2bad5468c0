"""Baseline and extended sequential JPEG blocks to raw components, without colour conversion."""

from __future__ import annotations

import numpy as np

_K = np.arange(8)
#: Rows of the 8-point inverse cosine transform.
_IDCT = np.where(_K[None, :] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16)
#: Place of each coefficient in zigzag order, by walking the diagonals.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


class _Huffman:
    """Value and length by the next 16 bits."""

    def __init__(self, counts: bytes, values: bytes):
        self.value, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                a = code << (16 - n)
                self.value[a : a + (1 << (16 - n))], self.length[a : a + (1 << (16 - n))] = values[k], n
                code, k = code + 1, k + 1
            code <<= 1
        self.value, self.length = self.value.tolist(), self.length.tolist()


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        while self.n <= 24:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held, self.n = (self.held << 8 | byte) & 0xFFFFFFFFFF, self.n + 8

    def symbol(self, table: _Huffman) -> int:
        self._fill()
        look = self.held >> (self.n - 16) & 0xFFFF
        length = table.length[look]
        if not length:
            raise ValueError("a code that the table does not have")
        self.n -= length
        return table.value[look]

    def extend(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        self._fill()
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode(data: bytes, tables: bytes | None = None) -> bytes:
    """Interleaved 8-bit components. ``tables``: an abbreviated stream of shared tables that comes first."""
    if tables:
        data = tables.removesuffix(b"\xff\xd9") + data[2:]
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], _Huffman] = {}
    restart, parts, height, width, at = 0, [], 0, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF or marker in (0x00, 0x01, 0xD8) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8)
                quant[number] = table
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                huff[body[k] >> 4, body[k] & 15] = _Huffman(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit JPEG samples are supported")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only sequential JPEG is supported")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            scan = [p for p in parts if p["id"] in chosen]
            _scan(data[at:], scan, [(huff[0, chosen[p["id"]][0]], huff[1, chosen[p["id"]][1]]) for p in scan], quant, restart, width, height, parts)
            if all("plane" in p for p in parts):
                break
    if not parts or not all("plane" in p for p in parts):
        raise ValueError("no image in the JPEG stream")
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    out = np.empty((height, width, len(parts)), np.uint8)
    for k, p in enumerate(parts):
        plane = p["plane"].repeat(most_v // p["v"], axis=0).repeat(most_h // p["h"], axis=1)
        out[:, :, k] = plane[:height, :width]
    return out.tobytes()


def _segments(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffed zeros."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        marker = data[at + 1]
        if marker == 0:
            at += 2
        elif 0xD0 <= marker <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        else:
            out.append(data[start:at])
            break
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _scan(data: bytes, scan: list[dict], tables: list[tuple], quant: dict, restart: int, width: int, height: int, parts: list[dict]) -> None:
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    single = len(scan) == 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    grids = []
    for p in scan:
        grids.append(np.zeros((down * p["v"], across * p["h"], 64)))
    if single:  # blocks of one component stand in its own rows
        p = scan[0]
        units_x, units_y = -(-(-(-width * p["h"] // most_h)) // 8), -(-(-(-height * p["v"] // most_v)) // 8)
    else:
        units_x, units_y = across, down
    segments = iter(_segments(data))
    bits, before = _Bits(next(segments)), [0] * len(scan)
    for unit in range(units_x * units_y):
        if restart and unit and unit % restart == 0:
            bits, before = _Bits(next(segments, b"")), [0] * len(scan)
        uy, ux = divmod(unit, units_x)
        for k, p in enumerate(scan):
            dc, ac = tables[k]
            for v in range(1 if single else p["v"]):
                for h in range(1 if single else p["h"]):
                    block = grids[k][uy if single else uy * p["v"] + v, ux if single else ux * p["h"] + h]
                    before[k] += bits.extend(bits.symbol(dc))
                    block[0] = before[k]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            if i > 63:
                                raise ValueError("too many coefficients")
                            block[ZIGZAG[i]] = bits.extend(s & 15)
                        i += 1
    for p, grid in zip(scan, grids, strict=True):
        rows, columns = grid.shape[:2]
        blocks = (grid * quant[p["q"]]).reshape(rows, columns, 8, 8)
        pixels = _IDCT @ blocks @ _IDCT.T + 128
        p["plane"] = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
