"""Operator 2: document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes puts chunk ends where its low bits are zero, with a stricter mask
before the normal size and a looser one after it; so an edit moves only the ends near it. The
fingerprint is the set of (chunk digest, chunk length), and the likeness of one to another is the
containment weighted by length: the share of its bytes whose chunks the other has too.

Null texts count as empty; an empty text has an empty fingerprint, like only to another empty one (1,
else 0). Documents follow one another by id, then text; null ids come first; after the last comes the
first. A repeated row follows its equal. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWEST, blocks, by_shard, tune, with_shard

#: Chunk sizes in bytes, and the bits of the masks before and after the normal size.
LEAST, NORMAL, MOST = 24, 64, 256
STRICT, LOOSE = np.uint32(0x7F << 20), np.uint32(0x1F << 20)
WINDOW = 32


def _gear() -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(bytes([b]), 2) for b in range(256)], np.uint32)


GEAR = _gear()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # sums over the last 2, 4, ... 32 bytes, each byte shifted by its age
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start, i, j, ns, nl = [], 0, 0, 0, len(strict), len(loose)
    while n - start > LEAST:
        normal = start + NORMAL
        i = bisect_left(strict, start + LEAST, i)
        if i < ns and strict[i] < normal:
            start = strict[i]
        else:
            j = bisect_left(loose, normal, j)
            start = min(loose[j] if j < nl else n, start + MOST, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> frozenset[bytes]:
    """Six bytes of each chunk's digest and two of its length."""
    from xxhash import xxh3_64_digest

    start, out = 0, []
    for end in chunk_ends(data):
        out.append(xxh3_64_digest(data[start:end])[:6] + (end - start).to_bytes(2, "big"))
        start = end
    return frozenset(out)


def to_text(fp: frozenset[bytes]) -> str:
    return base64.b64encode(b"".join(sorted(fp))).decode()


def from_text(text: str) -> frozenset[bytes]:
    raw = base64.b64decode(text)
    return frozenset(raw[i : i + 8] for i in range(0, len(raw), 8))


def _weight(fp: frozenset[bytes]) -> int:
    return sum(int.from_bytes(x[6:], "big") for x in fp)


def likeness(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    """The part of a's bytes whose chunks are in b; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    whole = _weight(a)
    return _weight(a & b) / whole if whole else 0.0


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points replaced by the first of the next document's.
    """
    spark = df.sparkSession
    tune(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(LOWEST)))
    placed, bounds, shards = with_shard(rows, "at", F.octet_length("text"))
    # each shard also gets a copy of the first document of the next; a row for each shard
    firsts = sorted((r["shard"], r["at"]) for r in placed.groupBy("shard").agg(F.min("at").alias("at")).collect())  # a row for each shard
    copies = spark.createDataFrame([(at, firsts[k - 1][0]) for k, (_, at) in enumerate(firsts)], "at long, shard int")
    follow = rows.join(F.broadcast(copies), "at").groupBy("at", "shard").agg(F.min("text").alias("text"))
    both = placed.select("shard", F.lit(False).alias("copy"), "at", "text", "doc_id").union(follow.select("shard", F.lit(True), "at", "text", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last: tuple | None = None  # the document that waits for the next one: id, text, fingerprint
        for block in blocks(batches, "text"):
            out: list[tuple] = []
            for copy, text, doc_id in zip(block.column(1).to_pylist(), block.column(3).to_pylist(), block.column(4).to_pylist(), strict=True):
                own = last[2] if last and last[1] == text else fingerprint(text.encode())
                if last:
                    before, was, fp = last
                    cut = len(was) // 4
                    edited = (was[: len(was) - cut] + text[:cut] if cut else was).encode()
                    changed = fingerprint(edited)
                    out.append((before, len(was), hashlib.sha256(edited).hexdigest(), to_text(fp), to_text(changed), likeness(fp, changed), likeness(fp, own)))
                last = None if copy else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return by_shard(both, shards, "copy", "at", "text").mapInArrow(run, schema)
