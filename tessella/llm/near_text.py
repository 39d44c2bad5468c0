"""SimHash near-dedup by similarity: candidates from covering masks, then exact word-shingle likeness.

Here the fingerprint is of a text's distinct words, which an edit moves by few bits and which lies far
from other texts' fingerprints; the covering family of radius ``RADIUS`` brings every pair in that
radius together in some table. Every pair that a table brings together is decided by the whole sets of
five-word shingles: it is a link if their Jaccard likeness is at least 0.8. Only exact bounds, of sizes
and of sketches, tell a pair sooner, and pairs of one component need no decision.

Texts with equal sets are one class, which stands as one row everywhere. Buckets of up to ``SMALL``
classes give all their pairs. In larger ones a pair a row is tried first, with the nearest row by this
and a second fingerprint, of the shingles, or with the row in the middle; their links make components,
and buckets whose components are one are done. The others are decided whole: a task gets a bucket's classes with their sets and gives the links
that join components, so rows follow the members and never their pairs. A bucket of over ``PART``
classes is dealt to several tasks: what stands apart from its main component in blocks, each against
each other and against each block of the main component.

Null texts count as empty; texts without words are alike. Rows of one id are one document, which has
the links of each of its rows; null ids are one document too. Other columns are not read. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, claim, save, shuffle_width, tune
from tessella.llm.simhash import components

WORDS, SIMILARITY, RADIUS = 5, 0.8, 6
#: Classes of a bucket of which all pairs are candidates; rows of a larger one among which the first partners are sought.
SMALL, RUN = 8, 512
#: Classes of a bucket that a task decides at once.
PART = 2048
#: Bits of a set's sketch: the parity of its hashes in each of so many places. Sketches differ in no more bits than the sets in members.
SKETCH = 2048
LOWEST = -(1 << 63)
#: Bits of the bitmap that picks documents with candidates (1 MB), and how many of these it is used for.
BITMAP, MOST_MARKED = 1 << 23, 1 << 21
#: Distinct words whose digests a worker keeps.
MOST_WORDS = 150_000


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_digest

        self[word] = d = xxh64_digest(word, 42)
        return d


_DIGESTS = _Digests()


def word_fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the distinct words, as a signed long."""
    words = set((text or b"").lower().split())
    if not words:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(words)).view(">i8")[0])


def shingles(text: bytes | None, words: int = WORDS) -> set[int]:
    """32-bit hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    from xxhash import xxh32_intdigest

    own = (text or b"").lower().split()
    if not own:
        return set()
    if len(own) <= words:
        return {xxh32_intdigest(b" ".join(own)) - (1 << 31)}
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = (ends - np.diff(ends, prepend=0))[: len(own) - words + 1].tolist()
    return {xxh32_intdigest(line[a:b]) - (1 << 31) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)}


def shingle_fingerprint(made: np.ndarray) -> int:
    """64-bit SimHash of distinct shingles' 32-bit hashes, which are mixed to 64 bits, as a signed long."""
    if not len(made):
        return 0
    x = made.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    bits = np.unpackbits((x ^ (x >> np.uint64(33))).view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(made)).view(">i8")[0])


def sketch(made: np.ndarray) -> np.ndarray:
    """Parities of the distinct hashes by place, as longs."""
    odd = np.bincount(made & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def masks(radius: int = RADIUS) -> list[int]:
    """A covering family as signed longs: of some draws of codes, the one whose smallest mask is largest."""
    best: tuple[int, list[int]] = (-1, [])
    for seed in range(64):
        code = np.random.RandomState(seed).randint(1, 1 << (radius + 1), 64)
        family = [sum(1 << b for b in range(64) if int(code[b] & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]
        best = max(best, (min(m.bit_count() for m in family), family))
    return [m - (1 << 64) if m >> 63 else m for m in best[1]]


def _names(family: list[int]) -> np.ndarray:
    return np.array([m & (1 << 64) - 1 for m in family], np.uint64)


def _first_here(x: np.ndarray, y: np.ndarray, table: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Whether no table before this one brings the two fingerprints together."""
    differ = x ^ y
    out = np.ones(len(differ), bool)
    for v in range(int(np.max(table, initial=0))):
        out &= (differ & family[v] != 0) | (v >= table)
    return out


def _table_of(path: np.ndarray, family: np.ndarray) -> np.ndarray:
    """A path's low bits are its table's number."""
    return path & (len(family))


def _partners(fp: np.ndarray, fp2: np.ndarray, kind: int) -> np.ndarray:
    """For each of a bucket's rows the place of the one to try first: the row in the middle or the nearest one, by table; a third of the tables try none."""
    n = len(fp)
    if kind == 2:
        return np.zeros(0, np.int64)
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :]) + np.bitwise_count(fp2[:, None] ^ fp2[None, :])
    if kind == 0:
        return np.full(n, int(apart.sum(axis=1, dtype=np.int64).argmin()))
    apart[np.arange(n), np.arange(n)] = 255
    return apart.argmin(axis=1)


def _buckets(family: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (path, fp, fp2, node) sorted by path. Gives the pairs of small buckets (nodes, partners) without a path; and the runs of larger buckets with theirs."""

    def lists(path: int | None, nodes: np.ndarray, partners: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.int64()), pa.array([nodes], pa.list_(pa.int64())), pa.array([partners], pa.list_(pa.int64()))], names=["path", "nodes", "partners"])

    def small(columns: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        path, fp, _, node = columns
        left, right = [], []
        for n in range(2, SMALL + 1):
            here = starts[sizes == n]
            for i in range(n - 1 if len(here) else 0):
                for j in range(i + 1, n):
                    left.append(here + i)
                    right.append(here + j)
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            new = _first_here(fp[x].view(np.uint64), fp[y].view(np.uint64), _table_of(path[x], family), family)
            if new.any():
                yield lists(None, node[x[new]], node[y[new]])

    def large(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        path, fp, fp2, node = columns
        kind = int(_table_of(path[0], family)) % 3
        for at in range(0, len(path), RUN):
            own, first, second = (x[at : at + RUN] for x in (node, fp.view(np.uint64), fp2.view(np.uint64)))
            yield lists(int(path[0]), own, own[_partners(first, second, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last bucket, which may go on
        going_on: int | None = None  # the large bucket of which rows were given already
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            path = columns[0]
            if not len(path):
                continue
            starts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(path)]]))
            if going_on is not None and int(path[0]) == going_on:
                yield from large([c[: sizes[0]] for c in columns])
                if len(starts) == 1:
                    held = []
                    continue
                starts, sizes = starts[1:], sizes[1:]
            going_on = None
            last = int(starts[-1])
            if sizes[-1] > RUN:
                going_on, held = int(path[last]), []
                yield from large([c[last:] for c in columns])
            else:
                held = [c[last:] for c in columns]
            starts, sizes = starts[:-1], sizes[:-1]
            yield from small(columns, starts, sizes)
            for k in np.flatnonzero(sizes > SMALL):
                yield from large([c[starts[k] : starts[k] + sizes[k]] for c in columns])
        if held:
            n = len(held[0])
            if n > SMALL:
                yield from large(held)
            else:
                yield from small(held, np.array([0]), np.array([n]))

    return run


def _joined(root: np.ndarray, fp: np.ndarray, node: np.ndarray, block: np.ndarray, sets: list[np.ndarray], table: np.ndarray, across: bool, family: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of a bucket's classes: every pair of two components is decided, each in the first table that brings it together. ``across``: pairs of one block are another task's."""
    roots, at, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) < 2:
        return []
    of = list(range(len(roots)))

    def find(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    sizes = np.array([len(x) for x in sets], np.int64)
    sketches = np.stack([sketch(x) for x in sets]).view(np.uint64)
    order = np.argsort(sizes, kind="stable")  # pairs of too different sizes are far apart here
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    main = at == counts.argmax()
    rows = np.flatnonzero(~main)
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 16) // len(root))
    for k in range(0, len(rows), step):
        own = rows[k : k + step]
        now = np.array([find(i) for i in range(len(roots))])[at]
        likely = (now[own][:, None] != now[None, :]) & (main[None, :] | (place[None, :] > place[own][:, None]))
        likely &= np.minimum(sizes[own][:, None], sizes[None, :]) >= similarity * np.maximum(sizes[own][:, None], sizes[None, :])
        if across:
            likely &= block[own][:, None] != block[None, :]
        i, j = np.nonzero(likely)
        i = own[i]
        most = (sizes[i] + sizes[j]) * (1 - similarity) / (1 + similarity) + 0.001
        differ = np.zeros(len(i), np.int64)
        for words in (slice(0, 4), slice(4, SKETCH // 64)):  # a part of the sketch is a bound too
            differ += np.bitwise_count(sketches[i, words] ^ sketches[j, words]).sum(axis=1, dtype=np.int64)
            left = differ <= most
            i, j, most, differ = i[left], j[left], most[left], differ[left]
        left = _first_here(fp[i], fp[j], table[i], family)
        for a, b, d in sorted(zip(i[left].tolist(), j[left].tolist(), differ[left].tolist(), strict=True), key=lambda x: x[2]):
            x, y = find(int(at[a])), find(int(at[b]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            either = len(sets[a]) + len(sets[b]) - both
            if either == 0 or both >= similarity * either:
                of[x] = y
                out.append((int(node[a]), int(node[b])))
    return out


def _decide(family: np.ndarray, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (path, i, j, block, root, fp, node, shingles) sorted by path, i and j, of buckets' parts. Gives links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        key: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            path, i, j, block, root, fp, node = (np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True))
            sets = [x for h in held for x in h[1]]
            links = _joined(root, fp.view(np.uint64), node, block, sets, _table_of(path, family), bool(i[0] != j[0]), family, similarity)
            held.clear()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) for k in range(7)]
            lists = batch.column(7)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            new = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = tuple(int(c[s]) for c in columns[:3])
                if now != key:
                    yield from close()
                    key = now
                held.append(([c[s:e] for c in columns], sets[s:e]))
        yield from close()

    return run


def _parts(members: DataFrame) -> DataFrame:
    """Rows (path, root, node) of buckets with several components, dealt to parts (i, j) of which a task decides one: i is a block of what stands apart from the main component, j any block."""
    by_root = members.groupBy("path", "root").agg(F.count("*").alias("n"))
    buckets = by_root.groupBy("path").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    whole = F.col("all") <= PART
    apart = F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("most.n")) / PART)).cast("int")
    together = F.when(whole, 0).otherwise(F.ceil(F.col("most.n") / PART)).cast("int")
    buckets = buckets.select("path", F.when(whole, None).otherwise(F.col("most.root")).alias("main"), apart.alias("apart"), together.alias("together"))
    mixed = F.xxhash64("node", F.lit(3))
    block = F.when(F.col("root") == F.col("main"), F.col("apart") + F.pmod(mixed, F.col("together"))).otherwise(F.pmod(mixed, F.col("apart"))).cast("int")
    dealt = members.join(buckets, "path").withColumn("block", block)
    last = F.when(F.col("block") < F.col("apart"), F.col("apart") + F.col("together") - 1).otherwise(F.col("apart") - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "node")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """The hashes of nodes as a bitmap of fixed size. Hashes that meet only cost time."""
    place = nodes.select(F.pmod(F.xxhash64("node"), F.lit(BITMAP)).alias("k")).groupBy(F.floor(F.col("k") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 AS int))")).alias("bits"))
    bitmap = np.zeros(BITMAP // 64, np.int64)
    for r in place.collect():  # BITMAP / 64 rows at most
        bitmap[r["word"]] = r["bits"]
    return bitmap


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the documents that have a link; root is the smallest id of the component. A null id is ``LOWEST``."""
    spark = df.sparkSession
    tune(spark)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("node"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        claim("near_text", _DIGESTS.clear)
        for block in blocks(batches, "text"):
            if len(_DIGESTS) > MOST_WORDS:
                _DIGESTS.clear()
            texts = block.column(1).to_pylist()
            sets = [np.fromiter(x := shingles(t, words), np.int32, len(x)) for t in texts]
            second = [shingle_fingerprint(x) for x in sets]
            same = [xxh128_digest(np.sort(x).tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([word_fingerprint(t) for t in texts], pa.int64()), pa.array(second, pa.int64()), pa.array(same, pa.binary())], names=["node", "fp", "fp2", "same"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            if bitmap is not None:
                k = np.asarray(block.column(2))
                block = block.filter(pa.array((bitmap[k >> 6] >> (k & 63) & 1).astype(bool)))
            texts = block.column(1).to_pylist()
            sets = [np.sort(np.fromiter(s := shingles(t, words), np.int32, len(s))) for t in texts]
            some = [sketch(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([word_fingerprint(t) for t in texts], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(some, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))],
                names=["node", "fp", "n", "sketch", "shingles"],
            )

    prints = save(rows.mapInArrow(fingerprint, "node long, fp long, fp2 long, same binary"), "words")
    family = masks(radius)
    # a class has one set of shingles, so its least node stands for it in every comparison
    classes = save(prints.groupBy("fp", "fp2", "same").agg(F.min("node").alias("rep")), "word-classes")
    keys = classes.select("fp", "fp2", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in family])).alias("v", "key"))
    path = F.xxhash64("v", "key").bitwiseAND(F.lit(~len(family))).bitwiseOR(F.col("v"))  # a bucket is of one table
    dealt = keys.select(path.alias("path"), "fp", "fp2", "rep").repartition(shuffle_width(spark), "path").sortWithinPartitions("path", "fp2")
    dealt = save(dealt.mapInArrow(_buckets(_names(family)), "path long, nodes array<long>, partners array<long>"), "buckets")
    tried = dealt.where(F.size("partners") > 0).select(F.inline(F.arrays_zip("nodes", "partners"))).where("nodes <> partners")
    pairs = save(tried.select(F.least("nodes", "partners").alias("a"), F.greatest("nodes", "partners").alias("b")).distinct(), "candidates")
    more = save(dealt.where("path IS NOT NULL").select("path", F.explode("nodes").alias("node")), "members")
    linked = prints.join(classes, ["fp", "fp2", "same"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    nodes = save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(more.select("node")).distinct(), "compared")
    marked = rows.withColumn("k", F.pmod(F.xxhash64("node"), F.lit(BITMAP)))
    few = nodes.count() <= MOST_MARKED
    bitmap = _bitmap(nodes) if few else None  # texts of documents without candidates need no exchange
    sets = save((marked if few else marked.join(nodes, "node", "left_semi")).mapInArrow(cut, "node long, fp long, n int, sketch array<long>, shingles array<int>"), "shingles")
    one = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    either = F.size("a_set") + F.size("b_set") - both

    def alike(some: DataFrame) -> DataFrame:
        return some.join(one("a"), "a").join(one("b"), "b").where((either == 0) | (both >= F.lit(similarity) * either)).select("a", "b")

    # sizes and sketches tell most candidates that are no links, and never a link
    small = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda n, x: n + x)
    possible = differ * F.lit(1 + similarity) <= (F.col("a_n") + F.col("b_n")) * F.lit(1 - similarity) + F.lit(0.001)
    fits = F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n")
    pairs = save(pairs.join(small("a"), "a").join(small("b"), "b").where(fits & possible).select("a", "b"), "possible")

    linked = save(linked.union(alike(pairs)), "linked")
    root = save(components(linked), "roots")

    # then every pair of the buckets whose components are still apart
    rooted = save(more.join(root, "node", "left").select("path", F.coalesce("root", "node").alias("root"), "node"), "rooted")
    members = save(_parts(rooted), "apart")
    whole = members.join(sets.select("node", "fp", "shingles"), "node").select("path", "i", "j", "block", "root", "fp", "node", "shingles").repartition(shuffle_width(spark), "path", "i", "j").sortWithinPartitions("path", "i", "j")
    return components(linked.union(save(whole.mapInArrow(_decide(_names(family), similarity), "a long, b long"), "left")))
