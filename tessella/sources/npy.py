"""Arrays in the public NPY format, from bytes or through a range source."""

from __future__ import annotations

import ast
import struct

import numpy as np

from tessella.sources.ranges import RangeSource

#: Fixed: the format's first bytes.
MAGIC = b"\x93NUMPY"


def parse(data: bytes) -> np.ndarray:
    if data[:6] != MAGIC:
        raise ValueError("not an NPY file")
    wide = data[6] > 1
    start = 12 if wide else 10
    length = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    head = ast.literal_eval(data[start : start + length].decode("utf-8" if data[6] > 2 else "latin-1"))
    flat = np.frombuffer(data, np.dtype(head["descr"]), int(np.prod(head["shape"], dtype=np.int64)), start + length)
    return flat.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def read(ranges: RangeSource) -> np.ndarray:
    return parse(ranges(0, ranges.size))
