"""Operator 7: a deterministic sharded WARC writer, and its reader.

Records are put in order of page id by ranges, written as one gzip member each into files that roll by
compressed size, with headers and digests made anew. Ranges hold about equal bytes, and a task writes one. A file is written under a temporary name and then
renamed; the manifest, a table that Spark commits, lists what readers may read. Of records with equal
payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page id is the response and the
others are revisits that name it. Equality is by length and SHA-256.

A null payload counts as empty. A null page id comes first and ranks below all others. Of repeated rows
(equal id and payload) the first is the response and the rest revisit it. A null url has no target
header. Other columns are not read. An empty table makes no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWEST, blocks, by_shard, read_whole, same_shards, save, shuffle_width, tune, with_shard, work_path, write_whole

LEAST_REVISIT = 1000
#: Compressed bytes after which a file is closed.
ROLL = 16 << 20
#: Fixed: the profile of revisit records (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, payload_sha256: str, repeat: int = 0) -> str:
    """A version 8 UUID: 32 bits of the payload's digest, 25 of the number among equal rows (its others are mixed with the digest), the page id."""
    value = ((1 << 64) - 1) & (page_id or 0)
    high = (int(payload_sha256[:8], 16) ^ repeat >> 25) << 16 | (repeat & 0x7FFF) << 1 | (page_id is None)
    middle = (repeat >> 15 & 0x3FF) << 2 | value >> 62
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | value & ((1 << 62) - 1))}>"


def page_of(record: str) -> int | None:
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if x >> 80 & 1:
        return None
    value = (x >> 64 & 3) << 62 | x & ((1 << 62) - 1)
    return value - (1 << 64) if value >> 63 else value


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(own_id: str, url: str | None, payload: bytes, refers: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(body)}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write the archives and return the manifest: shard, part, file, n_records, n_bytes, sha256."""
    spark = df.sparkSession
    tune(spark)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("at", F.coalesce("page_id", F.lit(LOWEST)))
    digests = pages.select("at", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest")).where(F.col("n") >= LEAST_REVISIT)
    copies = digests.groupBy("digest", "n").agg(F.max("at").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    revisits = digests.join(copies, ["digest", "n"]).where("at < first").select("at", "digest", "first").distinct()
    # the pages of one id that fills several shards are dealt by their payloads, so equal ones meet
    placed, bounds, shards = with_shard(pages, "at", F.octet_length("payload"), F.xxhash64(F.sha2("payload", 256)))
    decided = same_shards(revisits, "at", bounds, F.xxhash64("digest"))
    rows = decided.select("shard", "at", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(b"").alias("payload"), F.col("first").alias("page_id")).union(
        placed.select("shard", "at", F.lit(1), "url", "payload", "page_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, n = None, 0, 0
        out = io.BytesIO()
        at, revisit, seen = None, {}, {}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, part, n
            if not n:
                return
            data = out.getvalue()
            file = f"{path}/pages-{shard:06d}-{part:06d}.warc.gz"
            write_whole(file, data)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [file], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})
            out, n = io.BytesIO(), 0
            part += 1

        for block in blocks(batches, "payload"):
            for s, key, kind, url, payload, page_id in zip(*(block.column(i).to_pylist() for i in range(6)), strict=True):
                if s != shard:
                    yield from close()
                    shard, part, at = s, 0, None
                if key != at:
                    at, revisit, seen = key, {}, {}
                if kind == 0:
                    revisit[url] = page_id  # a digest, and the page that keeps its payload
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                repeat, refers = seen.get(digest, 0), None
                seen[digest] = repeat + 1
                if len(payload) >= LEAST_REVISIT:
                    if digest in revisit:
                        first = revisit[digest]
                        refers = record_id(None if first == LOWEST else first, digest)
                    elif repeat:
                        refers = record_id(page_id, digest)
                out.write(gzip.compress(record(record_id(page_id, digest, repeat), url, payload, refers, date), 6, mtime=0))
                n += 1
                if out.tell() >= roll:
                    yield from close()
        yield from close()

    ordered = by_shard(rows, shards, "at", "kind", "payload", "url")
    return save(ordered.mapInArrow(run, "shard int, part int, file string, n_records long, n_bytes long, sha256 string"), "warc")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip file with a member for each record."""
    with gzip.open(io.BytesIO(data)) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("a record must begin with its version")
            head: dict[str, str] = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record must end with two empty lines")
            yield head, block


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per record of the files that a manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    spark = manifest.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if with_payload else 6]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            for file, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = read_whole(file)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{file} is not what the manifest lists")
                rows: list[tuple] = []
                for head, block in parse(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    said = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    response = head["WARC-Type"] == "response"
                    if response and (hashlib.sha1(payload).hexdigest() != said or len(payload) != size):
                        raise ValueError(f"{file}: a payload does not match its digest")
                    rows.append((page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, said, head["WARC-Type"], None if response else page_of(head["WARC-Refers-To"]), payload if response else None))
                    if len(rows) >= 256:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return manifest.select("file", "sha256").repartition(2 * shuffle_width(spark), "file").mapInArrow(run, schema)


def warc_path(df: DataFrame) -> str:
    return work_path(df.sparkSession, "warc-files")
