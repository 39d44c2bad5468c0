"""Operator 1: exact dedup by distributed MSD radix partitioning.

Texts are equal when identical after lower-casing A-Z. Each task first splits blocks of its own rows
by successive bytes and passes each distinct text on once, with a number for the block's row group.
Groups that share their next bytes are then split further for as long as one has many rows or bytes. A
large group skips what all its texts share, which its least and its greatest text tell; where these two
are equal, all are, and the group is settled by an aggregate. So each round parts every large group it
goes on with, however long a shared start is, and only rows of large groups go on. A last exchange
brings each small group together and a task ends the recursion. No digest decides equality.

Null texts count as empty; empty texts equal each other. Of repeated rows (equal id and text) one is
kept. A null id ranks below all others. Columns other than id, text and the row's key are not read. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tessella.llm.common import save, shuffle_width, tune

#: Bytes of text that a task splits at once.
BLOCK = 48 << 20
#: A group of more rows, or of several with more bytes, is split by further bytes before rows are exchanged.
LARGE_GROUP, LARGE_BYTES = 1024, 64 << 20
#: Bytes of the first digit; each round doubles it.
FIRST_DIGIT = 32


def msd_groups(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts: split by successive bytes until a group is a single text or has ended."""
    done: list[list[int]] = []
    todo = [(range(len(texts)), 0, 16)]
    while todo:
        group, at, width = todo.pop()
        digits: dict[bytes, list[int]] = {}
        for i in group:
            digits.setdefault(texts[i][at : at + width], []).append(i)
        for digit, same in digits.items():
            if len(same) == 1 or len(digit) < width:
                done.append(same)
            else:
                todo.append((same, at + width, min(2 * width, 1 << 16)))
    return done


def _below(x: int | None) -> tuple[bool, int]:
    return (x is not None, x or 0)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, text). Gives the distinct texts of each block, with the ids and rows that have it, the largest id first."""
    base = TaskContext.get().partitionId() << 36
    rows: list[tuple[int | None, int | None]] = []
    texts: list[bytes] = []
    size = made = 0

    def split() -> Iterator[pa.RecordBatch]:
        nonlocal made
        groups = msd_groups(texts)
        groups.sort(key=lambda g: g[0])
        for k in range(0, len(groups), 256):
            some = groups[k : k + 256]
            members = [sorted((rows[i] for i in g), key=lambda x: _below(x[0]), reverse=True) for g in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(base + made, base + made + len(some)), pa.int64()),
                    pa.array([[i for i, _ in m] for m in members], pa.list_(pa.int64())),
                    pa.array([[r for _, r in m] for m in members], pa.list_(pa.int64())),
                    pa.array([texts[g[0]] for g in some], pa.binary()),
                ],
                names=["key", "members", "rows", "text"],
            )
            made += len(some)

    for batch in batches:
        for i, r, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            t = (t or b"").lower()  # bytes.lower changes A-Z only
            rows.append((i, r))
            texts.append(t)
            size += len(t)
            if size >= BLOCK:
                yield from split()
                rows, texts, size = [], [], 0
    yield from split()


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group's equal texts are found by splitting on. Groups are small in rows and bytes."""
    group, rows, texts = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for same in msd_groups(texts):
            own = [rows[i] for i in same]
            total = sum(n for _, _, n in own)
            keep_key, keep, _ = max(own, key=lambda x: (_below(x[1]), -x[0]))
            digest = hashlib.sha256(texts[same[0]]).hexdigest()
            out.extend((key, keep, total, keep_key, digest) for key, _, _ in own)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["key", "keep_id", "group_size", "keep_key", "text_sha256"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            *at, key, rep, n, text = row
            if at != group and rows:
                yield from close()
                rows, texts = [], []
            group = at
            rows.append((key, rep, n))
            texts.append(text)
    if rows:
        yield from close()


def shared_start(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


@pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_start(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _settled(rows: DataFrame) -> DataFrame:
    """The result of groups (gid) whose texts are all equal."""
    rank = F.struct(F.col("rep").isNotNull().alias("has"), F.coalesce("rep", F.lit(0)).alias("rep"), (-F.col("key")).alias("first"))
    tops = rows.groupBy("gid", "text_sha256").agg(F.sum("n").alias("group_size"), F.max(rank).alias("top"))
    found = rows.select("gid", "key").join(tops, "gid")
    return found.select("key", F.when(F.col("top.has"), F.col("top.rep")).alias("keep_id"), "group_size", (-F.col("top.first")).alias("keep_key"), "text_sha256")


def _digit(width: int) -> Column:
    return F.expr(f"substring(text, at + 1, {width})")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text. Of equal texts the largest id stays.

    With ``row_col``, a long column that tells rows apart, its value comes too, as ``row_key``.
    """
    spark = df.sparkSession
    tune(spark)
    own = F.lit(None) if row_col is None else F.col(row_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), own.cast("long").alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    local = save(rows.mapInArrow(_local, "key long, members array<long>, rows array<long>, text binary"), "exact")
    # gid: the group that a start makes; at: where its next digit begins
    live = local.select("key", F.element_at("members", 1).alias("rep"), F.size("members").cast("long").alias("n"), "text", F.lit(-1).cast("long").alias("gid"), F.lit(0).alias("at"))
    found, small, width = [], [], FIRST_DIGIT
    while True:
        digits = live.withColumn("digit", _digit(width))
        groups = digits.groupBy("gid", "digit").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min("key").alias("next"))
        large = save(groups.where((F.col("rows") > LARGE_GROUP) | ((F.col("rows") > 1) & (F.col("bytes") > LARGE_BYTES))).select("gid", "digit", "next"), "exact-large")
        if large.isEmpty():
            small.append(digits)
            break
        small.append(digits.join(large, ["gid", "digit"], "left_anti"))
        inside = save(digits.join(large, ["gid", "digit"]).select("key", "rep", "n", "text", F.col("next").alias("gid")), "exact-live")
        ends = inside.groupBy("gid").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        ends = save(ends.select("gid", _shared("low", "high").cast("int").alias("at"), (F.col("low") == F.col("high")).alias("equal"), F.sha2("low", 256).alias("text_sha256")), "exact-starts")
        found.append(_settled(inside.drop("text").join(ends.where("equal").select("gid", "text_sha256"), "gid")))
        live = inside.join(ends.where("NOT equal").select("gid", "at"), "gid").select("key", "rep", "n", "text", "gid", "at")
        width *= 2
    order = ["gid", "at", "digit"]
    grouped = small[0].select(*order, "key", "rep", "n", "text")
    for more in small[1:]:
        grouped = grouped.union(more.select(*grouped.columns))
    grouped = grouped.repartition(shuffle_width(spark), *order).sortWithinPartitions(*order)
    results = grouped.mapInArrow(_final, "key long, keep_id long, group_size long, keep_key long, text_sha256 string")
    for more in found:
        results = results.union(more)
    each = local.select("key", F.posexplode(F.arrays_zip("members", "rows")).alias("pos", "r"))
    kept = (F.col("key") == F.col("keep_key")) & (F.col("pos") == 0)
    named = [] if row_col is None else [F.col("r.rows").alias("row_key")]
    return each.join(results, "key").select(F.col("r.members").alias("doc_id"), *named, "keep_id", "group_size", kept.alias("kept"), "text_sha256")
