"""Decoders of blocks by compression code. Each takes the bytes and the block's parameters and returns bytes."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tessella.sources.codecs import ccitt, jpeg


@dataclass
class Params:
    """What a decoder needs to know of a block."""

    width: int
    rows: int
    samples: int = 1
    bits: int = 8
    sample_format: int = 1
    little: bool = True
    predictor: int = 1
    fill_order: int = 1
    t4_options: int = 0
    tables: bytes | None = None


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends. The width grows one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(first), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = list(first), 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("a code that the table does not have")
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


Codec = Callable[[bytes, Params], bytes]

CODECS: dict[int, Codec] = {
    1: lambda b, p: b,
    2: lambda b, p: ccitt.decode(b, p.width, p.rows, "rle", False, p.fill_order),
    3: lambda b, p: ccitt.decode(b, p.width, p.rows, "g3", bool(p.t4_options & 1), p.fill_order),
    4: lambda b, p: ccitt.decode(b, p.width, p.rows, "g4", True, p.fill_order),
    5: lambda b, p: lzw(b),
    7: lambda b, p: jpeg.decode(b, p.tables),
    8: lambda b, p: zlib.decompress(b),
    32946: lambda b, p: zlib.decompress(b),
    32773: lambda b, p: packbits(b),
    50000: lambda b, p: zstd(b),
}


def dtype(bits: int, sample_format: int, little: bool) -> np.dtype:
    kind = {2: "i", 3: "f"}.get(sample_format, "u")
    size = 8 if bits > 32 else 4 if bits > 16 else 2 if bits > 8 else 1
    if sample_format == 3 and bits not in (16, 32, 64):
        raise ValueError(f"{bits}-bit floating point samples are not supported.")
    return np.dtype(("<" if little else ">") + kind + str(bits // 8 if sample_format == 3 else size))


def unpack(data: bytes, p: Params) -> np.ndarray:
    """Samples of a block as rows x width x samples; bits that don't fill bytes are packed by row, high bits first."""
    kind = dtype(p.bits, p.sample_format, p.little)
    per_row = p.width * p.samples
    if p.bits in (8, 16, 32, 64):
        need = p.rows * per_row * kind.itemsize
        whole = np.frombuffer(data[:need].ljust(need, b"\0"), kind).reshape(p.rows, p.width, p.samples)
        return undo_predictor(whole, p)
    stride = (per_row * p.bits + 7) // 8
    need = p.rows * stride
    bits = np.unpackbits(np.frombuffer(data[:need].ljust(need, b"\0"), np.uint8).reshape(p.rows, stride), axis=1)[:, : per_row * p.bits]
    weights = 1 << np.arange(p.bits - 1, -1, -1, dtype=np.int64)
    out = (bits.reshape(p.rows, per_row, p.bits) @ weights).astype(kind.newbyteorder("="))
    return undo_predictor(out.reshape(p.rows, p.width, p.samples), p)


def undo_predictor(block: np.ndarray, p: Params) -> np.ndarray:
    """2: running sums along a row, modulo the sample's size. 3: the same on bytes, whose planes hold the floats' bytes from high to low."""
    if p.predictor == 2:
        unsigned = np.dtype(f"{block.dtype.byteorder}u{block.dtype.itemsize}") if block.dtype.kind != "u" else block.dtype
        plain = block.view(unsigned).astype(unsigned.newbyteorder("="))
        return np.cumsum(plain, axis=1, dtype=plain.dtype).view(block.dtype.newbyteorder("="))
    if p.predictor == 3:
        size = block.dtype.itemsize
        rows, width, samples = block.shape
        raw = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, width * size, samples)
        summed = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, samples).astype(f"=f{size}")
    return block.astype(block.dtype.newbyteorder("=")) if block.dtype.byteorder == ">" else block


def decode_block(data: bytes, compression: int, p: Params) -> np.ndarray:
    """Decoded samples, rows x width x samples."""
    if compression not in CODECS:
        raise ValueError(f"compression {compression} is not supported")
    out = CODECS[compression](data, p)
    if compression in (2, 3, 4):
        p = Params(p.width, p.rows, 1, 1)
    return unpack(out, p)
