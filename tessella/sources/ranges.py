"""A file's bytes by ranges: short ranges through cached blocks, and all of a batch in merged reads."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable

import pyarrow.fs

from tessella.operators.requests import BLOCK, DIRECT, MERGED

#: Blocks that a source keeps.
MOST_BLOCKS = 512

Range = tuple[int, int]


def merged(ranges: Iterable[Range], cap: int = MERGED) -> list[Range]:
    """Ranges (first, after), sorted, with those that touch or overlap as one while that is not above ``cap``."""
    out: list[Range] = []
    for first, after in sorted(ranges):
        if out and first <= out[-1][1] and max(out[-1][1], after) - out[-1][0] <= cap:
            out[-1] = out[-1][0], max(out[-1][1], after)
        else:
            out.append((first, after))
    return out


class RangeSource:
    """Reads ranges (offset, length) of a file, cut at its end.

    Ranges below ``DIRECT`` bytes are taken from blocks that are kept, the least recently used going first;
    longer ones are read as they are. What a call of ``fetch`` lacks comes in one trip of merged reads.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.trips = self.reads = self.bytes_read = 0

    def __call__(self, offset: int, length: int) -> bytes:
        return self.fetch([(offset, length)])[0]

    def fetch(self, ranges: list[Range]) -> list[bytes]:
        cut = [(max(0, offset), max(offset, min(offset + length, self.size))) for offset, length in ranges]
        short = [0 < b - a < DIRECT for a, b in cut]
        numbers = dict.fromkeys(k for (a, b), s in zip(cut, short, strict=True) if s for k in range(a // BLOCK, (b - 1) // BLOCK + 1))
        here = {k: self.blocks[k] for k in numbers if k in self.blocks}
        lacking = [(k * BLOCK, min((k + 1) * BLOCK, self.size)) for k in numbers if k not in here]
        direct = [(a, b) for (a, b), s in zip(cut, short, strict=True) if b > a and not s]
        got = self._read(merged(lacking + direct))
        for a, b in lacking:
            here[a // BLOCK] = self._part(got, a, b)
        for k in numbers:
            self.blocks[k] = here[k]
            self.blocks.move_to_end(k)
        while len(self.blocks) > MOST_BLOCKS:
            self.blocks.popitem(last=False)
        out = []
        for (a, b), s in zip(cut, short, strict=True):
            if not s:
                out.append(self._part(got, a, b) if b > a else b"")
                continue
            first, last = a // BLOCK, (b - 1) // BLOCK
            whole = here[first] if first == last else b"".join(here[k] for k in range(first, last + 1))
            out.append(whole[a - first * BLOCK : b - first * BLOCK])
        return out

    def _read(self, ranges: list[Range]) -> list[tuple[int, bytes]]:
        self.trips += bool(ranges)
        self.reads += len(ranges)
        self.bytes_read += sum(b - a for a, b in ranges)
        return [(a, self.read_at(a, b - a)) for a, b in ranges]

    @staticmethod
    def _part(got: list[tuple[int, bytes]], a: int, b: int) -> bytes:
        """The bytes from a to b, which one of the reads holds."""
        start, data = next((s, d) for s, d in reversed(got) if s <= a and s + len(d) >= b)
        return data if start == a and len(data) == b - a else data[a - start : b - start]


def reader(path: str) -> tuple[Callable[[int, int], bytes], int]:
    """``read_at`` of a path or URI, and the file's size; ranges are cut at the file's end."""
    if path.startswith("file:"):
        fs, path = pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif path.startswith("/"):
        fs = pyarrow.fs.LocalFileSystem()
    else:
        fs, path = pyarrow.fs.FileSystem.from_uri(path)
    size = fs.get_file_info(path).size
    file = fs.open_input_file(path)

    def read_at(offset: int, length: int) -> bytes:
        end = min(offset + length, size)
        return file.read_at(end - offset, offset) if end > offset else b""

    return read_at, size


def source(path: str) -> RangeSource:
    return RangeSource(*reader(path))
