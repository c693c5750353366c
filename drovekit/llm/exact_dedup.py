"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is two polynomial hashes modulo primes below 2**31. The hash of a
concatenation follows from the hashes of its parts, H(a + b) = H(a) * B**len(b) + H(b): the chunks
of a huge document are hashed in parallel, each is shifted by the bytes that follow it, and their
sum is the document's. Equal fingerprints are then compared chunk by chunk as a stream: per
fingerprint and chunk number the least and the greatest chunk are equal only if all are. These
aggregates combine on the map side, so that a group of copies, however large, reaches the shuffle
as at most two chunks from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, small, tidied
from .flat import slices, spans, squeeze

PRIMES = (2147483647, 2147483629)
BASES = (1103515249, 998244341)
CHUNK = 1 << 20
HUGE = 8 << 20
_powers: dict[tuple[int, int], np.ndarray] = {}


def _falling(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo prime."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:  # x**0..x**(m-1), times x**m, are the next m
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)))
        _powers[base, prime] = have = have[::-1].copy()
    return have[len(have) - n :]


def chunk_hash(data: np.ndarray, base: int, prime: int) -> int:
    """Polynomial hash of at most CHUNK bytes; each byte counts as its value plus one."""
    # 2**8 * 2**31 * 2**20 terms stay below 2**64
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), _falling(base, prime, len(data))) % prime) if len(data) else 0


def shifted(h: int, after: int, base: int, prime: int) -> int:
    """The part that a chunk has in the hash of a text in which ``after`` bytes follow it."""
    return h * pow(base, after, prime) % prime


def fingerprint(data: np.ndarray, chunk: int = CHUNK, primes: tuple = PRIMES, bases: tuple = BASES) -> tuple[int, ...]:
    return tuple(sum(shifted(chunk_hash(data[i : i + chunk], b, p), max(0, len(data) - i - chunk), b, p) for i in range(0, len(data), chunk)) % p for b, p in zip(bases, primes, strict=True))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        data, offsets = spans(batch.column("text"))
        for i, j in slices(offsets, 2 << 20):
            part, at = squeeze(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                yield batch, i + k, part[at[k] : at[k + 1]]


def _rows(schema: pa.Schema, rows: Iterator[tuple], most: int = 8192, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame, *, chunk: int = CHUNK, huge: int = HUGE, primes: tuple = PRIMES) -> DataFrame:
    """(doc_id, n_bytes, f1, f2, text_sha256) of each row of docs (doc_id, text); a null text is empty.

    Rows over ``huge`` bytes leave their task as chunks, which are hashed wherever there is room.
    """
    chunk = min(chunk, CHUNK)
    whole = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("text_sha256", pa.string())])
    parts = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("after", pa.int64()), ("chunk", pa.binary())])
    hashed = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])

    def of_rows(batches):
        yield from _rows(whole, ((b.column("doc_id")[k].as_py(), len(x), *fingerprint(x, chunk, primes), hashlib.sha256(x).hexdigest()) for b, k, x in _normalised(batches)))

    def chunks(batches):
        def rows():
            for b, k, x in _normalised(batches):
                sha = hashlib.sha256(x).hexdigest()
                for i in range(0, len(x), chunk):
                    yield b.column("uid")[k].as_py(), b.column("doc_id")[k].as_py(), len(x), sha, max(0, len(x) - i - chunk), x[i : i + chunk].tobytes()

        yield from _rows(parts, rows())

    def of_chunks(batches):
        for b in batches:
            got = [np.frombuffer(x.as_py(), np.uint8) for x in b.column("chunk")]
            for_each = [[shifted(chunk_hash(x, base, p), a.as_py(), base, p) for x, a in zip(got, b.column("after"), strict=True)] for base, p in zip(BASES, primes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "doc_id", "n_bytes", "text_sha256")), *(pa.array(x, pa.int64()) for x in for_each)], schema=hashed)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long_ones = docs.filter(F.octet_length("text") > huge).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(tidied(chunks), "uid long, doc_id long, n_bytes long, text_sha256 string, after long, chunk binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long_ones = long_ones.repartition(n, "uid", "after").mapInArrow(tidied(of_chunks), "uid long, doc_id long, n_bytes long, text_sha256 string, h1 long, h2 long")
    long_ones = long_ones.groupBy("uid", "doc_id", "n_bytes", "text_sha256").agg((F.sum("h1") % primes[0]).alias("f1"), (F.sum("h2") % primes[1]).alias("f2"))
    return docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= huge).mapInArrow(tidied(of_rows), "doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string").unionByName(long_ones.select("doc_id", "n_bytes", "f1", "f2", "text_sha256"))


def differing(docs: DataFrame, groups: DataFrame, keys: list[str], *, chunk: int = CHUNK, primes: tuple = PRIMES) -> DataFrame:
    """The keys among ``groups`` whose texts aren't all equal, by a comparison of their chunks."""
    chunk = min(chunk, CHUNK)
    schema = pa.schema([("n_bytes", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *([("text_sha256", pa.string())] if "text_sha256" in keys else []), ("seq", pa.int64()), ("chunk", pa.binary())])

    def chunks(batches):
        def rows():
            for _, _, x in _normalised(batches):
                f = fingerprint(x, chunk, primes)
                sha = (hashlib.sha256(x).hexdigest(),) if "text_sha256" in keys else ()
                for i in range(0, max(1, len(x)), chunk):
                    yield len(x), *f, *sha, i, x[i : i + chunk].tobytes()

        yield from _rows(schema, rows())

    ddl = "n_bytes long, f1 long, f2 long, " + ("text_sha256 string, " if "text_sha256" in keys else "") + "seq long, chunk binary"
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(chunks), ddl)
    rows = rows.join(small(groups.select(*keys)), keys, "left_semi")
    return rows.groupBy(*keys, "seq").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo != hi").select(*keys).distinct()


def exact_groups(docs: DataFrame, *, chunk: int = CHUNK, huge: int = HUGE, primes: tuple = PRIMES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null is
    the empty text. Of equal texts the row with the smallest doc_id is kept (a null doc_id comes
    last; of rows that repeat that doc_id, one). Other columns don't matter. An empty table gives
    an empty result. A difference that the comparison finds behind one fingerprint separates the
    texts by their SHA-256 besides, and is compared again.
    """
    prints = cut(fingerprints(docs, chunk=chunk, huge=huge, primes=primes).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    keys = ["n_bytes", "f1", "f2"]
    for keys in (keys, [*keys, "text_sha256"]):
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        groups = cut(prints.groupBy(*keys).agg(F.count("*").alias("group_size"), first).filter("group_size > 1"), "groups")
        if differing(docs, groups, keys, chunk=chunk, primes=primes).isEmpty():
            break
    else:
        raise RuntimeError("texts differ behind one SHA-256")
    b = small(groups.select(*keys, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    return prints.alias("a").join(b.alias("b"), keyed(keys), "left").select(
        "a.doc_id",
        F.when(F.col("group_size").isNull(), F.col("a.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("a.row") == F.col("keep_row"))).alias("kept"),
        "a.text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_groups drops; columns and other rows as they are.

    Dropped rows are named by doc_id, so that rows which repeat a kept doc_id with an equal text
    become one and a dropped doc_id goes only where its text is the dropped one.
    """
    gone = cut(exact_groups(docs), "exact")
    lost = gone.filter("not kept and doc_id is not null").select("doc_id", "text_sha256", (F.col("doc_id") == F.col("keep_id")).alias("twin")).distinct()
    count = lost.count()
    twins = lost.filter("twin").select("doc_id").distinct()
    plain = small(lost.filter("not twin").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")), count)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    sha = F.sha2(F.regexp_replace(F.coalesce("_text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    out = rows.join(plain, F.col("_id") == F.col("_gone"), "left").filter(F.col("_gone").isNull() | (sha != F.col("_sha"))).select("_row", "_id", "_text")
    if not twins.isEmpty():
        again = small(twins.withColumnRenamed("doc_id", "_twin"))
        twice = out.join(again, F.col("_id") == F.col("_twin"), "left_semi").dropDuplicates(["_id", "_text"])
        out = out.join(again, F.col("_id") == F.col("_twin"), "left_anti").unionByName(twice)
    return out.select("_row.*")
