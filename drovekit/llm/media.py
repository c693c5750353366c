"""Media columns: content-defined chunks, stored once, and ordered chunk lists that rebuild the media.

A document's payload is its UTF-8 text, filled with spaces to a positive multiple of 192 bytes,
kept as the 8-bit samples of a mono WAVE file. A rolling gear hash cuts the file into chunks, so that
equal passages give equal chunks wherever they stand. Chunks are named by SHA-256; a Spark join
on the names decides which document's occurrence of a chunk is stored. Pack files in the shared folder
hold the stored chunks, packed by zstandard. To read media back, chunk lists are joined with the
chunks' places, the chunks are range-read, checked by name, and put together in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, measured, new_path, tidied
from .files import Ranges, put
from .flat import spans

UNIT = 192
RATE = 8000
#: Least and greatest chunk, and the hash bits that are zero at a cut (one place in 2048).
LEAST, MOST, BITS = 512, 8192, 11
_WINDOW = 32
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT))


def wave(payload: bytes) -> bytes:
    """A WAVE file whose 8-bit mono samples are the payload; texts stay below its limit of 4 GB."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAVE file as ``wave`` makes it."""
    tag, _, kind, fmt, n, code, channels, _, _, _, bits, data, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (tag, kind, fmt, n, code, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or len(media) != 44 + size:
        raise ValueError("not a WAVE file of 8-bit mono samples")
    return media[44:]


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Places behind which the gear hash of the last 32 bytes asks for a cut; the first 31 hashes are of fewer bytes."""
    out, step = [], 1 << 20
    for lo in range(0, len(data), step):
        a = max(0, lo - _WINDOW + 1)
        h = _GEAR[data[a : lo + step]]
        for j in (1, 2, 4, 8, 16):  # h[i] then covers 2 * j bytes: sums of gear[byte] << age
            new = h.copy()
            new[j:] += h[:-j] << np.uint32(j)
            h = new
        out.append(np.flatnonzero((h[lo - a :] >> np.uint32(32 - BITS)) == 0) + lo + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a file: the first cut from LEAST bytes on, or MOST bytes."""
    cuts, ends, at, n = gear_cuts(np.frombuffer(data, np.uint8)).tolist(), [], 0, len(data)
    while at < n:
        k = bisect_left(cuts, at + LEAST)
        at = min(cuts[k] if k < len(cuts) else n, at + MOST, n)
        ends.append(at)
    return ends


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, bytes]]:
    """(batch, row, text bytes, media file) of each row."""
    for batch in batches:
        data, offsets = spans(batch.column("text"))
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            yield batch, k, len(text), wave(padded(text))


def _out(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, media_bytes, media_sha256, chunks) of each row; key: the text's SHA-256, chunks: that of each, in order."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("chunks", pa.list_(pa.binary()))])

    def run(batches):
        def rows():
            for batch, k, n, media in _media(batches):
                ends = chunk_ends(media)
                names = [hashlib.sha256(media[a:b]).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield batch.column("doc_id")[k].as_py(), hashlib.sha256(memoryview(samples(media))[:n]).digest(), n, len(media), hashlib.sha256(media).hexdigest(), names

        yield from _out(schema, rows())

    return docs.mapInArrow(tidied(run), "doc_id long, key binary, n_bytes long, media_bytes long, media_sha256 string, chunks array<binary>")


def stored_elsewhere(lists: DataFrame) -> DataFrame:
    """(id, of, skip): the places in a document's list of the chunks that another occurrence stores, the least (doc_id, key, place).

    A document is its doc_id (id) and its text's key (of): rows that share a doc_id have each their own text.
    """
    each = lists.select("doc_id", "key", F.posexplode("chunks").alias("seq", "name"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "seq")
    # written first: a name that many have is then a plain shuffle on both sides, which AQE splits
    several = cut(each.groupBy("name").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"), "chunk-firsts")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("seq") == F.col("first.seq"))
    other = each.join(several, "name").filter(~own)
    return other.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(F.collect_set("seq").alias("skip"))


def write_packs(docs: DataFrame, skip: DataFrame, path: str) -> DataFrame:
    """Write each task's own chunks to one pack file; (name, pack, at, length) of each chunk.

    A pack's name holds the attempt, and only a finished attempt's places are returned.
    """
    schema = pa.schema([("name", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches):
        where = TaskContext.get()
        pack, places, at = f"{path}/pack-{where.partitionId():06d}-{where.taskAttemptId()}.bin", [], 0
        compress = zstandard.ZstdCompressor(level=9).compress

        def parts():
            nonlocal at
            for batch, k, _, media in _media(batches):
                others = batch.column("skip")[k].as_py()
                others = set(others) if others else ()
                ends = chunk_ends(media)
                if len(others) == len(ends):
                    continue
                for seq, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if seq not in others:
                        out = compress(media[a:b])
                        places.append((hashlib.sha256(media[a:b]).digest(), pack, at, len(out)))
                        at += len(out)
                        yield out

        put(pack, parts())
        yield from _out(schema, iter(places))

    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    docs = docs.join(measured(skip), F.col("doc_id").eqNullSafe(F.col("id")) & (key == F.col("of")), "left") if not skip.isEmpty() else docs.withColumn("skip", F.lit(None).cast("array<int>"))
    return docs.select("text", "skip").mapInArrow(tidied(run), "name binary, pack string, at long, length long")


def feature_of(payload: bytes) -> str:
    """Sample statistics: mean, root mean square about 128, crossings of 128, and peak, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def rebuilt(plans: DataFrame) -> DataFrame:
    """From (media_sha256, plan), plan the places of all chunks in order: what the files hold, checked against every name."""
    schema = pa.schema([("media", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        packs, unpack = Ranges(), zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                for media, plan in zip(batch.column("media").to_pylist(), batch.column("plan"), strict=True):
                    parts = []
                    for c in plan.as_py():
                        if c["pack"] is None:
                            raise ValueError(f"a chunk of {media} isn't stored")
                        parts.append(unpack.decompress(packs.read(c["pack"], c["at"], c["length"])))
                        if hashlib.sha256(parts[-1]).digest() != c["name"]:
                            raise ValueError(f"a chunk in {c['pack']} isn't what its name says")
                    whole = b"".join(parts)
                    sha = hashlib.sha256(whole).hexdigest()
                    if sha != media:
                        raise ValueError(f"the chunk list of {media} gives another file")
                    payload = samples(whole)
                    yield media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), sha, feature_of(payload)

        yield from _out(schema, rows())
        packs.close()

    return plans.mapInArrow(tidied(run), "media string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and what the stored media read back as.

    A null text is empty: one unit of spaces. Null and repeated doc_ids are rows like others; a
    text's values depend on the text alone. Other columns don't matter. An empty table gives an
    empty result. A chunk that doesn't match its name, or a list that doesn't give its file, raises.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lists = cut(chunk_lists(docs), "chunk-lists")
    skip = cut(stored_elsewhere(lists), "chunk-skips")
    places = cut(write_packs(docs, skip, new_path(spark, "packs")), "chunk-places")
    drop(skip)
    once = cut(places.groupBy("name").agg(F.min(F.struct("pack", "at", "length")).alias("place")), "chunk-places")
    drop(places)
    each = lists.groupBy("media_sha256").agg(F.first("chunks").alias("chunks")).select(F.col("media_sha256").alias("media"), F.posexplode("chunks").alias("seq", "name"))
    plans = each.join(once, "name", "left").groupBy("media").agg(F.sort_array(F.collect_list(F.struct("seq", "place.pack", "place.at", "place.length", "name"))).alias("plan"))
    plans = plans.withColumn("pack", F.col("plan")[0]["pack"]).withColumn("at", F.col("plan")[0]["at"]).repartition("pack").sortWithinPartitions("pack", "at")
    media = rebuilt(plans.select("media", "plan"))
    return lists.select("doc_id", "n_bytes", F.col("media_sha256").alias("media")).join(media, "media", "left").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
