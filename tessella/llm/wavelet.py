"""Operator 3: token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as bit-planes, highest bit first; each plane is
the bits of the sequence after the stable split of the planes before it. Counts of ones at every 512
bits give rank, and with a binary search select; so one file answers access, count and occurrence
lookup. Planes and directories are compressed one by one.

Null texts count as empty (only the end id is written). Null ids come first. Repeated rows are written
each. Columns other than id and text are not read. An empty table makes no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import encoder
from tessella.llm.common import blocks, by_shard, drop_path, read_whole, save, shuffle_width, tune, with_shard, work_path, write_whole

#: Fixed: the file's first bytes, and the bits between two directory entries.
MAGIC, STEP = b"TWM1", 512
#: A file is closed when it has so many ids, or more by one document.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Bit-planes of a sequence, with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels):
            one = (seq & seq.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(one)
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low = seq.take(np.flatnonzero(~one))
            zeros.append(len(low))
            if level < levels - 1:
                seq = np.concatenate([low, seq.take(np.flatnonzero(one))])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
        padded[: len(packed)] = packed
        each = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(each, dtype=np.uint32)]).astype(np.uint32)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // STEP, self.planes[level]
        got = int(self.ranks[level][block])
        part = plane[block * 64 : (i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        return got + ones - (int(plane[i // 8] & (0xFF >> (i % 8))).bit_count() if i % 8 else 0)

    def rank(self, level: int, bit: int, i: int) -> int:
        ones = self.rank1(level, i)
        return ones if bit else i - ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(level, bit, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            i = self.rank(level, bit, i) + (self.zeros[level] if bit else 0)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        levels = len(self.planes)
        if token >> levels:
            return 0, 0
        for level in range(levels):
            bit = token >> (levels - 1 - level) & 1
            base = self.zeros[level] if bit else 0
            start, end = base + self.rank(level, bit, start), base + self.rank(level, bit, end)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        start = min(max(start, 0), self.n)
        a, b = self._range(token, start, self.n if end is None else max(start, min(end, self.n)))
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        levels = len(self.planes)
        for level in reversed(range(levels)):
            bit = token >> (levels - 1 - level) & 1
            at = self.select(level, bit, at - (self.zeros[level] if bit else 0))
        return at

    def to_array(self) -> np.ndarray:
        """All ids: from the last plane up, each level's order is restored."""
        levels = len(self.planes)
        out = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for level in reversed(range(levels)):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = self.zeros[level]
            up = np.empty_like(out)
            up[np.flatnonzero(~one)] = out[:z]
            up[np.flatnonzero(one)] = out[z:] | out.dtype.type(1 << (levels - 1 - level))
            out = up
        return out

    def to_bytes(self, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [np.array([i is None for i in doc_ids], np.uint8).tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), starts.astype("<i8").tobytes()]
        parts += [x for p, r in zip(self.planes, self.ranks, strict=True) for x in (p.tobytes(), r.astype("<u4").tobytes())]
        parts = [pack(p) for p in parts]
        head = struct.pack("<4sQQI", MAGIC, self.n, len(doc_ids), len(self.planes)) + np.array(self.zeros, "<u8").tobytes() + np.array([len(p) for p in parts], "<u8").tobytes()
        return head + b"".join(parts)


def read_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents' ids, and where each begins (one place more than documents)."""
    magic, n, docs, levels = struct.unpack_from("<4sQQI", data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = struct.calcsize("<4sQQI")
    zeros = np.frombuffer(data, "<u8", levels, at).tolist()
    at += 8 * levels
    sizes = np.frombuffer(data, "<u8", 3 + 2 * levels, at).tolist()
    at += 8 * len(sizes)
    parts, unpack = [], zstandard.ZstdDecompressor()
    for size in sizes:
        parts.append(unpack.decompress(data[at : at + size], max_output_size=1 << 31) if size else b"")
        at += size
    null, ids = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    doc_ids = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return WaveletMatrix(n, planes, zeros, ranks), doc_ids, np.frombuffer(parts[2], "<i8")


def write_shards(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write whole texts as shard files under ``path``, in ascending id order; return the manifest: shard, part, file, n_docs, n_ids."""
    spark = df.sparkSession
    tune(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed, _, shards = with_shard(rows, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        shard, part = None, 0
        ids: list[int | None] = []
        pieces: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, pieces, lengths, held, part
            if not ids:
                return
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            file = f"{path}/shard-{shard:06d}-{part:06d}.twm"
            write_whole(file, WaveletMatrix.build(np.concatenate(pieces)).to_bytes(ids, starts))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [file], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(starts[-1])], pa.int64())})
            ids, pieces, lengths, held = [], [], [], 0
            part += 1

        for block in blocks(batches, "text"):
            flat, counts = enc.encode_many(block.column(2).to_pylist())
            ends = np.cumsum(counts)
            for s, i, a, b in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                if s != shard:
                    yield from close()
                    shard, part = s, 0
                ids.append(i)
                pieces += [flat[a:b], np.array([end_id], np.uint32)]
                lengths.append(b - a + 1)
                held += b - a + 1
                if held >= SHARD_IDS:
                    yield from close()
        yield from close()

    ordered = by_shard(placed.select("shard", "doc_id", "text"), shards, "doc_id", "text")
    return save(ordered.mapInArrow(run, "shard int, part int, file string, n_docs long, n_ids long"), "shards")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files that a manifest lists: doc_id, start, n_tokens, ids_crc32; with ``with_ids`` the ids."""
    spark = manifest.sparkSession
    sums = manifest.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))  # a row for each shard
    files = manifest.join(before, "shard").select("file", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix, docs, starts = read_shard(read_whole(file))
                flat = matrix.to_array().astype("<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([flat[a:b].astype(np.int32) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in schema.split(", ")])

    return files.repartition(2 * shuffle_width(spark), "file").mapInArrow(run, schema)


def shard_path(df: DataFrame) -> str:
    return work_path(df.sparkSession, "wavelet")


__all__ = ["WaveletMatrix", "drop_path", "read_shard", "read_shards", "shard_path", "write_shards"]
