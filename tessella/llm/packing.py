"""Operator 8: best-fit packing by exact-complement hashing.

Only the counts of the 1024 piece lengths decide a packing, so the plan is made from those alone,
whatever the corpus is. From the longest length down, the gap is looked up among single lengths, then
sums of two, then of three that are still available, and as many sequences as the counts allow are
made at once; what finds no exact complement is put by best fit. The plan is a list of runs (length,
from rank, sequence, offset); each piece finds its run by its rank among the pieces of its length.

Null texts count as empty: they make the end id alone. Null ids and repeated rows are packed like any
other. Columns other than id and text are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.llm.bpe import encoder
from tessella.llm.common import blocks, save, tune

CAPACITY = 1024


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, and the first piece may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def _complement(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths (longest first) that add up to the gap."""
    if left[gap]:
        return (gap,)
    half = np.arange((gap + 1) // 2, gap)
    if len(half):
        pairs = half[(left[half] > 0) & (left[gap - half] > (half * 2 == gap))]
        if len(pairs):
            a = int(pairs[-1])
            return a, gap - a
    for a in np.flatnonzero(left[: max(0, gap - 1)])[::-1].tolist():
        rest = gap - a
        if a * 3 < gap:
            break
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        if not len(b):
            continue
        c = rest - b
        need_b = 1 + (b == a)
        need_c = 1 + (c == b) + (c == a)
        found = b[(left[b] >= need_b) & (left[c] >= need_c)]
        if len(found):
            return a, int(found[-1]), rest - int(found[-1])
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences): its size depends on the capacity, not on the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
    left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # one is the sequence's first
            found = _complement(capacity - length, left)
            left[length] += 1
            if not found:
                break
            lengths = (length, *found)
            n = min(int(left[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                left[x] -= n
            out.append((lengths, n))
    # best fit for the rest: open sequences by room, in runs of equal ones
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((lengths, n))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length  # a sequence of its own for so many at once
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[k]
            lengths, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // length, n)
            used = min(m, n // each)
            put(lengths + (length,) * each, used)
            if m > used:
                put(lengths, m - used)
            n -= used * each
    return out + [x for room in rooms for x in open_[room]]


def runs(packing: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """length, rank (the first), sequence (of that rank) and offset of each run, by length and rank."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in packing:
        at = 0
        for x in lengths:
            rows.append((x, rank.get(x, 0), base, at))
            rank[x] = rank.get(x, 0) + n
            at += x
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and its rank among its task's pieces of that length; with ``with_ids`` the ids."""
    tune(df.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for block in blocks(batches, "text"):
            flat, counts = enc.encode_many(block.column(1).to_pylist())
            flat = flat.astype("<u4")
            ends = np.cumsum(counts)
            rows: list[tuple] = []
            for i, a, b in zip(block.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(own), capacity)):
                    part = own[start : start + length]
                    rows.append((i, k, start, length, zlib.crc32(part), task, seen[length], *([part.astype(np.int32)] if with_ids else [])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = [f.split(" ")[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``with_ids`` the ids."""
    made = save(pieces(df, tokenizer, id_col, text_col, end_id, capacity, with_ids), "pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # 1024 rows at most
    table = runs(plan(counts, capacity))
    # runs of a length follow one another, so length and rank make one sorted key
    top = max(counts.values(), default=0) + 1
    keys = table["length"] * top + table["rank"]

    @pandas_udf("struct<sequence_id: long, offset: long>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * top + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][at] + rank.to_numpy() - table["rank"][at], "offset": table["offset"][at]})

    placed = made.join(before, ["task", "length"]).withColumn("at", find("length", F.col("place") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
