"""Operator 6: a quality classifier; logistic regression on hashed word n-grams, trained with FTRL.

The n-grams are words, word pairs, and the same two of the words' shapes (upper and lower case, digits
and marks, runs as one), with a mark on a pair of equal words. A feature's value is its share of the
document's n-grams, so length does not weigh. Training reads a bounded sample of the labelled rows
(``TRAIN_ROWS``, ``TRAIN_FEATURES``); scoring reads every whole text as a sparse dot product.

Null and empty texts have the score of the bias. Rows with a null label are not learned from; of
several labels of a document the largest counts. Without labels all scores are 0.5. A null id is not
held out and learns nothing. Repeated rows score alike. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, claim, tune

DIM = 1 << 18
#: Labelled documents that training reads at most, by the order of a hash of their ids; of these, as many as have so many features; passes over them.
TRAIN_ROWS, TRAIN_FEATURES, EPOCHS = 6000, 40_000_000, 4
#: FTRL: step, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
#: Distinct words that a worker keeps at most.
MOST_WORDS = 200_000


def shape(word: str) -> str:
    """ABC, abc, 12 as A, a, 0; marks stay, repeated ones as one."""
    out, last = [], ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


class _Words(dict):
    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.shapes: list[int] = []

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        self[word] = n = len(self.hashes)
        self.hashes.append(xxh64_intdigest(word.encode("utf-8", "replace"), 1))
        self.shapes.append(xxh64_intdigest(shape(word).encode("utf-8", "replace"), 2))
        return n


_WORDS = _Words()


def _forget() -> None:
    global _WORDS
    _WORDS = _Words()


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, the value of each, and the number of each text's."""
    global _WORDS
    claim("quality", _forget)
    if len(_WORDS) > MOST_WORDS:
        _WORDS = _Words()
    lists = [(t or "").split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    codes = np.fromiter((c for x in lists for c in map(_WORDS.__getitem__, x)), np.int64, int(n.sum()))
    w, s = np.array(_WORDS.hashes, np.uint64)[codes], np.array(_WORDS.shapes, np.uint64)[codes]
    doc = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    same = (w[pair] == w[pair + 1]).astype(np.uint64)
    found = np.concatenate([_mix(w, w, 11), _mix(s, s, 12), _mix(w[pair], w[pair + 1], 13), _mix(s[pair], s[pair + 1] + same, 14)])
    owner = np.concatenate([doc, doc, doc[pair], doc[pair]])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(n))
    values = np.repeat(1.0 / np.maximum(n, 1), counts)
    return (found[order] & np.uint64(DIM - 1)).astype(np.int64), values, counts


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features, the bias last, and their values."""
    out = []
    for at in range(0, len(texts), 64):
        idx, val, counts = features(texts[at : at + 64])
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            u, inv = np.unique(idx[a:b], return_inverse=True)
            out.append((np.append(u, DIM).astype(np.int32), np.append(np.bincount(inv, val[a:b], len(u)) if len(u) else np.zeros(0), 1.0).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights, the bias last, learned by follow-the-regularised-leader from features and values."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.RandomState(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            (i, x), y = rows[k], labels[k]
            w = weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(z, n).astype(np.float32)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    idx, val, counts = features(texts)
    sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights[idx] * val, len(counts)) + weights[DIM]
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3; labels of these are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on a bounded sample in one task, which gets features, never texts; the driver gets the weights alone (1 MB)."""
    tune(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            made = counted(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], names=["doc_id", "y", "idx", "val"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, total = {}, 0
        for b in batches:
            for i, y, idx, val in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                key, x = (i, idx.values.to_numpy().tobytes()), (idx.values.to_numpy(), val.values.to_numpy())
                total += 0 if key in got else len(idx)
                if total <= TRAIN_FEATURES:  # of repeated rows one is learned
                    got[key] = (x, y)
        rows = [got[k] for k in sorted(got)]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([train([x for x, _ in rows], [y for _, y in rows]).tobytes()], pa.binary())})

    made = known.select("doc_id", "text", "y").mapInArrow(count, "doc_id long, y int, idx array<int>, val array<float>")
    ordered = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "idx")
    found = ordered.mapInArrow(run, "weights binary").first()
    return np.frombuffer(bytes(found["weights"]), np.float32) if found else np.zeros(DIM + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; with ``keep`` all columns of the input and ``quality_score``."""
    tune(df.sparkSession)
    if keep:
        name = "quality_score"
        while name in df.columns:
            name = "_" + name
        kept = df.withColumn(name, F.lit(0.0))
        at, schema = df.columns.index(text_col), kept.schema
    else:
        kept = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
        at, schema = 2, f"doc_id {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, kept_names[at]):
            found = pa.array(scores(block.column(at).to_pylist(), weights))
            columns = [block.column(i) for i in range(at)] + ([block.column(i) for i in range(at, block.num_columns - 1)] if keep else []) + [found]
            yield pa.RecordBatch.from_arrays(columns, names=kept_names if keep else ["doc_id", "held_out", "score"])

    kept_names = list(kept.columns)
    out = kept.mapInArrow(run, schema)
    return out if keep else out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
