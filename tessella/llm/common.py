"""Helpers that the operators share: tables, the shared work folder, Arrow blocks and range shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.storage import shared_folder, work_path

#: Bytes of an Arrow batch; the operators cut batches further themselves.
BATCH_BYTES = "8m"
#: Where null ids rank.
LOWEST = -(1 << 63)
#: Bytes of text that a Python step holds at once, beside the one longest text.
BLOCK_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound an Arrow batch in bytes, as texts are long. Rows of a batch, and so all other queries, stay as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: this cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = work_path(spark, name) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table | pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts make up about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


#: Bytes that a shard aims at; shards at most, whose cuts the driver holds; bytes of a step in weighing rows.
SHARD_BYTES, MOST_SHARDS, WEIGHT_STEP = 32 << 20, 20_000, 4096


def shard_bounds(rows: DataFrame, column: str, size: Column) -> tuple[list[int], int]:
    """Cut values of a long column, in order, that deal rows to shards by their bytes; and the number of shards.

    A shard gets about ``SHARD_BYTES``, or less where the session asks for more partitions, or more beyond
    ``MOST_SHARDS``. A value that fills several shards stands in the cuts several times. Nulls rank first.
    """
    at = F.coalesce(F.col(column), F.lit(LOWEST))
    sizes = rows.select(at.alias("at"), F.coalesce(size, F.lit(0)).cast("long").alias("n"))
    each = sizes.select("at", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / WEIGHT_STEP))).alias("step"))
    total = F.sum(F.when(F.col("step") == 0, F.col("n")))
    shards = shuffle_width(rows.sparkSession)
    for _ in range(2):  # again only where the bytes ask for more shards than the session has partitions
        cuts, n = each.agg(F.percentile_approx("at", [i / shards for i in range(1, shards)] or [0.5], 10 * shards), total).first()
        wanted = min(MOST_SHARDS, max(shards, -(-(n or 0) // SHARD_BYTES)))
        if wanted == shards:
            break
        shards = wanted
    return sorted(cuts or [])[: shards - 1], shards


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI, for executors that write archives and shards themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write a file under a name of its own, then rename it: readers see whole files or none, and a task that runs again replaces a file by an equal one."""
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    hidden = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(hidden, compression=None) as out:
        out.write(data)
    store.move(hidden, path)


def read_whole(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, free: Callable[[], None]) -> None:
    """A worker keeps the caches of one operator at a time: those of others are freed."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    _HELD[name] = free
    if others:
        import ctypes
        import gc

        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def with_shard(df: DataFrame, column: str, size: Column, tie: Column | None = None) -> tuple[DataFrame, list[int], int]:
    """Add ``shard``, by ranges of a long column with about equal bytes (``size``); the cuts, and the number of shards.

    With ``tie``, a long, rows of a value that fills several shards are dealt to these by it.
    """
    bounds, shards = shard_bounds(df, column, size)
    return same_shards(df, column, bounds, tie), bounds, shards


def same_shards(df: DataFrame, column: str, bounds: list[int], tie: Column | None = None) -> DataFrame:
    """Add ``shard``: how many cut values are below the column's, or with ``tie`` are not above it, for rows that are dealt on. Only these columns go through Python."""
    cuts = np.array(bounds, np.int64)
    hot = len(cuts) > len(np.unique(cuts))

    @pandas_udf("int")
    def find(values: pd.Series, ties: pd.Series) -> pd.Series:
        low = np.searchsorted(cuts, values.to_numpy(), side="left")
        more = np.searchsorted(cuts, values.to_numpy(), side="right") - low
        return pd.Series((low + ties.to_numpy() % (more + 1) * (more > 1)).astype(np.int32))

    deal = tie if hot and tie is not None else F.lit(0).cast("long")
    return df.withColumn("shard", find(F.coalesce(F.col(column), F.lit(LOWEST)), deal))


def by_shard(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """One shard to a task, its rows in order."""
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *order)
