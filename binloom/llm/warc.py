"""Deterministic sharded WARC archives: written, committed by manifest, and read back.

Records are range-sorted by ``page_id``, then digest. A shard holds the records that start within one stretch of ``SHARD_BYTES`` of the sorted
rows' running size; that size is an exact sum over all keys, so shards depend on the rows only, not on how the input was
partitioned or how ids are spread. A shard is written by one task, as files rolled by compressed size. Each is
written under a temporary name and renamed; the table of files (the manifest) is written last, by Spark's own commit,
and readers open only what it lists, and check its sizes and digests. A task that runs twice writes the same bytes under the same name.
Every task gets the keys that begin a shard, some 40 bytes for each ``SHARD_BYTES`` of the input.

Of records with equal payloads of at least ``LEAST`` bytes that of the smallest id is a response; the others are
revisits without payload. Only ids and digests are shuffled to find them; a digest's rows are aggregated before.

Odd cases: a null payload is an empty one, a null url gives ``urn:page:``; a null ``page_id`` sorts first, is never
referred to and has no id in its record. Rows that repeat id and payload are responses if their id is the smallest; their records
share one WARC-Record-ID, as nothing tells them apart, and where they fill more than a shard they are dealt over the shards they fill. An
empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, STR, join_hot, own_columns, schema, scratch_path, stored

LEAST = 100
SHARD_BYTES, ROLL_BYTES = 16 << 20, 4 << 20
#: Beyond this many shards a task writes several; and the compressed bytes that a task reads back.
MOST_TASKS, READ_BYTES = 20_000, 64 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    block = http if again else http + payload
    head = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page, digest) if not again else record_id(page, f"{digest}/again")), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else "urn:page:"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if again:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(base: str, roll: int):
    names = ["file", "records", "bytes", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        now: dict = {}

        def close() -> list:
            if not now:
                return []
            now["out"].close()
            name = f"shard-{now['shard']:06d}-{now['roll']:05d}.warc.gz"
            fs.move(now["tmp"], f"{root}/{name}")
            return [(name, now["records"], now["bytes"], now["sha"].hexdigest())]

        def open_(shard: int, number: int) -> None:
            tmp = f"{root}/.tmp-{attempt}-{shard}-{number}"
            now.clear()
            now.update(shard=shard, roll=number, tmp=tmp, out=fs.open_output_stream(tmp, compression=None), records=0, bytes=0, sha=hashlib.sha256())

        refs: tuple = (None, {})
        for b in batches:
            done = []
            for shard, page, kind, url, payload, digest, target in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "kind", "url", "payload", "digest", "refers_to"))):
                if refs[0] != (page,):
                    refs = ((page,), {})
                if kind == 0:  # stands before the page's own rows
                    refs[1][digest] = target
                    continue
                if not now or now["shard"] != shard or now["bytes"] >= roll:
                    number = now["roll"] + 1 if now and now["shard"] == shard else 0
                    done += close()
                    open_(shard, number)
                data = _member(record(page, url, payload or b"", digest, refs[1].get(digest)))
                now["out"].write(data)
                now["sha"].update(data)
                now["records"] += 1
                now["bytes"] += len(data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)
        if done := close():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)

    return run


def revisits(meta: DataFrame, total: int) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another; ``meta(page_id, digest, n_bytes)`` has ``total`` rows."""
    large = meta.where(F.col("n_bytes") >= LEAST).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_hot(large, first, ["digest"], "n", total).where("not page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted keys with their sizes: the size of what stands before each in its task, and before the key before it."""
    total, last, task = 0, None, TaskContext.get().partitionId()
    for b in batches:
        ends = total + np.cumsum(np.asarray(b.column("size")))
        starts = np.concatenate(([total], ends[:-1])).astype(np.int64) if len(ends) else ends
        before = pa.array([last, *starts[:-1].tolist()][: len(starts)], pa.int64())
        total, last = (int(ends[-1]), int(starts[-1])) if len(ends) else (total, last)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts), before, pa.array([task] * b.num_rows, pa.int64())], [*b.schema.names, "start", "before", "task"])


def _first_keys(meta: DataFrame, shard_bytes: int) -> tuple[list, int]:
    """(no id, page_id, d, shard, shards) of the keys that begin a shard or fill several, in order; number of shards."""
    sizes = meta.groupBy("page_id", "d").agg(F.sum(F.col("n_bytes") + 500).alias("size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("page_id").asc_nulls_first(), F.col("d").asc()]
    kept = schema(page_id=LONG, d=LONG, size=LONG, n=LONG, start=LONG, before=LONG, task=LONG)
    keys = stored(sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, kept), "keys")
    base, at = {}, 0
    for r in keys.groupBy("task").agg(F.sum("size").alias("size")).orderBy("task").collect():  # one row a task
        base[r.task] = at
        at += r.size
    if not base:
        return [], 1
    offsets = keys.sparkSession.createDataFrame(list(base.items()), "task long, offset long")  # one row a task
    keys = keys.join(F.broadcast(offsets), "task")
    shard = lambda c: F.floor((F.col(c) + F.col("offset")) / F.lit(shard_bytes))
    begins = F.col("before").isNull() | (shard("start") != shard("before")) | (F.col("size") > shard_bytes)
    found = keys.where(begins).select(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "d", shard("start").alias("shard"), F.greatest(F.lit(1), F.least("n", F.floor(F.col("size") / shard_bytes))).alias("shards"))
    rows = sorted((not r.none, r.page_id, r.d, r.shard, r.shards) for r in found.collect())  # at most three a shard, and one a task
    return rows, -(-at // shard_bytes)


def _shard_of(firsts):
    """First shard of a row by its key, and how many its key fills."""

    def shards(page: pd.Series, d: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        some, pages, ds, shard, n = firsts.value
        none, d = page.isna().to_numpy(), d.to_numpy(np.int64)
        page, nulls = page.fillna(0).to_numpy(np.int64), int(np.searchsorted(some, 1))
        lo = np.where(none, 0, nulls + np.searchsorted(pages[nulls:], page, "left"))
        hi = np.where(none, nulls, nulls + np.searchsorted(pages[nulls:], page, "right"))
        at = lo.copy()  # keys at or before each row's
        for i in np.flatnonzero(hi > lo):
            at[i] += np.searchsorted(ds[lo[i] : hi[i]], d[i], "right")
        at = np.maximum(at - 1, 0)
        same = (hi > lo) & (ds[at] == d)
        return shard[at], np.where(same, n[at], 1)

    @F.pandas_udf("struct<shard:long,shards:long>")
    def of(page: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("shard", "shards"), shards(page, d))))

    return of


def write(pages: DataFrame, base: str, shard_bytes: int = SHARD_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under ``base`` and returns the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    own = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = own.withColumn("digest", F.sha2("payload", 256))
    key = F.xxhash64("digest").alias("d")
    meta = stored(rows.select("page_id", "digest", F.length("payload").cast("long").alias("n_bytes"), key), "meta")
    firsts, n = _first_keys(meta, shard_bytes)
    table = tuple(np.array(c, np.int64) for c in zip(*firsts)) or (np.zeros(0, np.int64),) * 5
    none = lambda t: F.lit(None).cast(t)
    pages_ = rows.select("page_id", key, F.lit(1).alias("kind"), "url", "payload", "digest", none("long").alias("refers_to"))
    refs_ = revisits(meta, meta.count()).select("page_id", key, F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "digest", "refers_to")
    of = _shard_of(spark.sparkContext.broadcast(table))("page_id", "d")
    if firsts:
        dealt = F.col("at.shard") + F.when(F.col("at.shards") > 1, F.pmod(F.monotonically_increasing_id(), F.col("at.shards"))).otherwise(0)
        pages_ = pages_.withColumn("at", of).withColumn("shard", dealt)
        refs_ = refs_.withColumn("at", of).withColumn("shard", F.explode(F.sequence(F.col("at.shard"), F.col("at.shard") + F.col("at.shards") - 1)))
        both = pages_.unionByName(refs_).drop("at")
    else:
        both = pages_.withColumn("shard", F.lit(0).cast("long"))
    a_task = -(-n // MOST_TASKS)
    placed = both.repartitionById(-(-n // a_task), F.floor(F.col("shard") / a_task).cast("int"))  # a shard is one task's, and tasks are alike
    order = placed.sortWithinPartitions("shard", "page_id", "d", "kind", "digest", "url").drop("d")
    manifest = order.mapInArrow(_writer(base, roll), schema(file=STR, records=LONG, bytes=LONG, sha256=STR))
    manifest.write.parquet(f"{base}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{base}/manifest")


class _Counted:
    """A stream that notes the size and digest of what was read."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.bytes += len(data)
        self.sha.update(data)
        return data


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a gzip member stream."""
    data, z = b"", zlib.decompressobj(31)
    parts: list[bytes] = []
    while chunk := (data or stream.read(1 << 20)):
        parts.append(z.decompress(chunk))
        data = z.unused_data
        if z.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            parts, z = [], zlib.decompressobj(31)


def _reader(base: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name, records, size_, sha in zip(*(b.column(c).to_pylist() for c in ("file", "records", "bytes", "sha256"))):
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in parse(counted := _Counted(stream)):
                        if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: the block of {h['WARC-Record-ID']} isn't what its headers say")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                        if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{name}: the payload of {h['WARC-Record-ID']} isn't what its headers say")
                        rows.append((number(h.get("X-Page-Id")), size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id")), name))
                if (len(rows), counted.bytes, counted.sha.hexdigest()) != (records, size_, sha):
                    raise ValueError(f"{name}: {len(rows)} records and {counted.bytes} bytes aren't what the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def read(spark: SparkSession, base: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file of each record that the manifest vouches for."""
    manifest = spark.read.schema(schema(file=STR, records=LONG, bytes=LONG, sha256=STR)).parquet(f"{base}/manifest")
    kind = schema(page_id=LONG, payload_bytes=LONG, payload_digest=STR, record_type=STR, refers_to=LONG, file=STR)
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    return manifest.repartition(max(1, -(-size // READ_BYTES))).mapInArrow(_reader(base), kind)


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    write(pages, base)
    return read(spark, base)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
