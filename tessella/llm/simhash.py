"""Operator 4: SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints that differ in at most three bits are linked. Each bit position has a nonzero code of
four bits; table v of fifteen keeps the positions whose code has odd parity with v. Any three
positions leave some v that is even on all of them, so each pair in the radius has an equal key in
some table: nothing is missed. Documents of equal fingerprints stand as one class, and a bucket gives
a spanning forest of its links, never its pairs. A bucket beyond ``LARGE_BUCKET`` is split by a
further covering family and dealt anew; each round fixes more bits, so this ends.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Repeated
rows stay rows of their own, with one class. Null ids make no component id unless all in a component
are null. Columns other than id and text are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, save, shuffle_width, tune

RADIUS = 3
LARGE_BUCKET = 1024


def fingerprints(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """64-bit SimHash of the shingles of so many words, as uint64; repeats count."""
    from xxhash import xxh64_digest

    digests: list[bytes] = []
    counts: list[int] = []
    for t in texts:
        own = (t or b"").lower().split()  # bytes.split: exactly 0x20 and 0x09-0x0D
        if len(own) <= words:
            made = [xxh64_digest(b" ".join(own), 42)] if own else []
        else:
            line = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            starts = (ends - np.diff(ends, prepend=0))[: len(own) - words + 1].tolist()
            made = [xxh64_digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        digests += made
        counts.append(len(made))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        starts = (np.cumsum(n) - n)[some]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_table(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            fp = fingerprints(block.column(1).to_pylist(), words).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The covering family of one level, as signed longs. Levels give the positions their codes in another order."""
    codes = (1 << (radius + 1)) - 1
    order = np.random.RandomState(7 + level).permutation(64)
    code = [0] * 64
    for k, bit in enumerate(order):
        code[bit] = 1 + k % codes
    out = []
    for v in range(1, codes + 1):
        mask = sum(1 << bit for bit in range(64) if (code[bit] & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(root, member) links that join what is linked among distinct fingerprints."""
    bits = fps.view(np.uint64)  # of signed numbers numpy would count the bits of the absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    left = np.ones(len(fps), bool)
    out = []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        reach = near[seed] & left
        while reach.any():
            at = np.flatnonzero(reach)
            left[at] = False
            out.extend((int(fps[seed]), int(fps[i])) for i in at)
            reach = near[at].any(axis=0) & left
    return out


def _bucket_links(level: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (path, fp) sorted by path, the bucket's name. Gives links, and rows of the next level for large buckets."""
    family = masks(level + 1, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a[:, 0]), pa.array(a[:, 1])], names=["path", "a", "b"])

        def deal(path: int, fps: np.ndarray) -> pa.RecordBatch:
            paths = np.concatenate([_name(np.int64(path), v, fps & np.int64(m)) for v, m in enumerate(family)])
            rows = np.tile(fps, len(family))
            return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(rows), pa.array(rows)], names=["path", "a", "b"])

        held_path: int | None = None
        held: list[np.ndarray] = []
        held_n, dealing = 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if not dealing and held_n > 1:
                found = forest(np.unique(np.concatenate(held)), radius)
                if found:
                    yield links(found)

        for batch in batches:
            path, fp = (np.asarray(batch.column(i)) for i in (0, 1))
            if not len(path):
                continue
            cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(path)]]))
            # whole buckets of two, inside this batch, at once
            two = np.flatnonzero(sizes == 2)
            two = two[(two > 0) & (two < len(starts) - 1)]
            a, b = fp[starts[two]], fp[starts[two] + 1]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)
            if near.any():
                yield links(np.stack([a[near], b[near]], axis=1))
            loose = np.flatnonzero((sizes > 2) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for k in loose:
                s, n, p = starts[k], sizes[k], int(path[starts[k]])
                if p != held_path:
                    yield from close()
                    held_path, held, held_n, dealing = p, [], 0, False
                held.append(fp[s : s + n])
                held_n += int(n)
                if held_n > LARGE_BUCKET:
                    dealing = True
                    yield deal(p, np.concatenate(held))
                    held = []
        yield from close()

    return run


def _name(path: np.ndarray, table: int, key: np.ndarray) -> np.ndarray:
    """A bucket's name, mixed from the path so far, the table and the key. Buckets that meet by chance only cost time: links are checked."""
    x = np.asarray(path, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key.astype(np.uint64) + np.uint64((table + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within the radius; each bucket gives a forest."""
    spark = distinct.sparkSession
    width = shuffle_width(spark)
    family = masks(0, radius)
    todo = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in family])).alias("v", "key")).select(F.xxhash64("v", "key").alias("path"), "fp")
    parts, level = [], 0
    while True:
        made = save(todo.repartition(width, "path").sortWithinPartitions("path").mapInArrow(_bucket_links(level, radius), "path long, a long, b long"), f"simhash-{level}")
        parts.append(made.where("path is null").select("a", "b"))
        todo = made.where("path is not null").select("path", F.col("a").alias("fp"))
        if todo.isEmpty():
            break
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a link; root is the smallest node reachable. Large-star and small-star rounds."""
    spark = edges.sparkSession
    edges = save(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "links")
    if edges.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("u", "v", "m")
        new = small.select(F.col("m").alias("u"), F.col("v")).union(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        new = save(new, "links")
        # done when no node is both a root and a member
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("v").count().where("count > 1").isEmpty():
            return new.select(F.col("v").alias("node"), F.col("u").alias("root")).union(new.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        edges = new


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id, and how many fingerprints the component has."""
    rows = save(fingerprint_table(df, id_col, text_col, words), "fingerprints")
    classes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), radius))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fingerprints"))
    by_fp = rooted.join(heads, "root").select("fp", "component_id", "n_fingerprints")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_fingerprints")
