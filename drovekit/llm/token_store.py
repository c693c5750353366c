"""Token ids on disk: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard holds the documents of one range of doc_id in ascending order. Each frame holds the ids of
one or more whole documents as little-endian unsigned 32-bit integers, with the content size and
zstandard's own checksum in the frame. Behind the frames stands the seek table, in skippable frames
that other zstandard readers pass over:

* magic 0x184D2A5E, length, and a zstandard frame with the document index: doc_id, ids before the
  document in the shard, number of ids, 1 if it has no doc_id (four arrays of little-endian signed
  64-bit integers);
* magic 0x184D2A5E, length, and one entry per frame - compressed size, decompressed size, low 32
  bits of the content's XXH64 - then the number of frames, a descriptor byte (0x80: checksums
  present) and the magic 0x8F92EAB1.

A reader needs the last nine bytes, then the table, and then only the frames of the documents asked for.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, new_path, tidied
from .files import opened, put
from .flat import slices, spans

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16
LEVEL = 3
END_ID = 2
#: Bytes of text that are encoded at a time, of text in a shard, and documents that are read back at a time.
PIECE, SHARD, READ = 8 << 20, 256 << 20, 1 << 16


class FrameWriter:
    """Collects documents' ids and yields the file's bytes."""

    def __init__(self, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.limit, self.pack = frame_ids, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size, self.frames, self.index, self.ids = 0, [], [array("q") for _ in range(4)], 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        if self.held and self.size + len(ids) > 4 * self.limit:
            yield self._frame()
        for column, x in zip(self.index, (doc_id or 0, self.ids, len(ids) // 4, doc_id is None), strict=True):
            column.append(x)
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.limit:
            yield self._frame()

    @property
    def documents(self) -> int:
        return len(self.index[0])

    def _frame(self) -> bytes:
        raw = b"".join(self.held)
        out = self.pack.compress(raw)
        self.frames.append((len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0
        return out

    def finish(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        index = self.pack.compress(np.array(self.index, "<i8").tobytes())
        yield struct.pack("<II", SKIPPABLE, len(index)) + index
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        yield struct.pack("<II", SKIPPABLE, len(table)) + table


class FrameReader:
    """Random access to a shard: ``documents()`` lists it, ``read`` fetches documents by position."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(start, 8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.offsets = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.starts = np.concatenate(([0], np.cumsum(table[:, 1]))) // 4
        magic, length = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if magic != SKIPPABLE or self.offsets[-1] + 8 + length != start:
            raise ValueError("the document index is damaged")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[-1]) + 8, length))
        self.doc_ids, self.before, self.counts, unnamed = np.frombuffer(index, "<i8").reshape(4, -1)
        self.unnamed = unnamed != 0
        self.cache: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("the file is cut short")
        return out

    def _frame(self, k: int) -> bytes:
        if self.cache[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.cache = (k, raw)
        return self.cache[1]

    def read(self, position: int) -> np.ndarray:
        """Ids of the document at a position in the index; one frame is decompressed, or kept from the last call."""
        start, n = int(self.before[position]), int(self.counts[position])
        if not n:
            return np.empty(0, "<u4")
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        return np.frombuffer(self._frame(k), "<u4")[start - self.starts[k] : start - self.starts[k] + n]


class Encoder:
    """The tokenizer's ids of whole texts, by units that it never merges across.

    A byte-level BPE vocabulary splits a text by its own pattern before it merges. Single spaces
    and line ends between other characters always stand at such a split, the space with what
    follows; marks behind a letter begin a new part, too. So the units of many texts are found at
    once, as byte ranges, and each distinct one is encoded by the library once and kept in a bounded
    table. A unit of letters is one part of the pattern: only the library's merges are asked for it.
    Texts that hold an added token's string or white space beyond ASCII, and vocabularies of any
    other kind, go to the library whole.
    """

    #: Bytes of the table; when it is full, units that were met once only are forgotten.
    KEPT = 16 << 20
    _WHITE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
    _WHITE[[*range(9, 14), *range(28, 33)]] = True
    _LETTER[[*range(65, 91), *range(97, 123)]] = True
    _MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    _BEYOND = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    _WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+$"

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.odd = "|".join([self._BEYOND, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
        # the model's letters for bytes: printable ones are themselves, the others follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self._forget()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, each text's with the end id last, and the number of each text's."""
        texts = texts.cast(pa.large_string()).fill_null("")
        rows = len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.plain else np.ones(rows, bool)
        data, offsets = spans(texts)
        starts = np.flatnonzero(self._begins(data, offsets, odd))
        bounds = np.append(starts, len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        code = self._known(units.dictionary)[units.indices.to_numpy()]
        ids, edges, n = self.ids, np.cumsum(self.counts) - self.counts, self.counts[code]
        upto = np.concatenate(([0], np.cumsum(n)))
        counts = np.diff(upto[np.searchsorted(starts, offsets)]) + 1
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), "<u4")
        mine = np.ones(len(out), bool)
        mine[last] = False
        out[last] = self.end
        out[mine] = ids[np.arange(upto[-1]) + np.repeat(edges[code] - upto[:-1], n)]
        if self.units.nbytes + ids.nbytes > self.KEPT:
            self._forget()
        return out, counts

    def _begins(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte."""
        white = self._WHITE[data]
        beside = np.zeros(len(data) + 2, bool)  # white[i - 1] is beside[i]
        beside[1:-1] = white
        before, after = beside[:-2].copy(), beside[2:]
        full = offsets[:-1] < offsets[1:]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        before[first] = False
        after[last] = False
        out = white & ~before & ~after
        lines = out & (data == 10)
        out &= (data == 32) | lines
        out[1:] |= self._MARK[data[1:]] & self._LETTER[data[:-1]] | lines[:-1]
        if odd.any():
            out &= ~np.repeat(odd, np.diff(offsets))
        out[first] = True
        return out

    def _forget(self) -> None:
        again = np.flatnonzero(self.met > 1) if hasattr(self, "met") else np.empty(0, np.int64)
        if len(again) and 2 * self.counts[again].sum() < len(self.ids):
            starts, n = (np.cumsum(self.counts) - self.counts)[again], self.counts[again]
            self.ids = self.ids[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]
            self.units, self.counts, self.met = self.units.take(pa.array(again)), n, np.zeros(len(n), np.int64)
        else:
            self.units, self.ids, self.counts, self.met = pa.array([], pa.large_binary()), np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _known(self, units: pa.Array) -> np.ndarray:
        """Where distinct units stand in the table; those that don't yet are encoded."""
        at = pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.units) + np.arange(len(new))
            fresh = units.take(pa.array(new))
            ids, counts = self._encoded(fresh)
            self.units = pa.concat_arrays([self.units, fresh])
            self.ids, self.counts, self.met = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts)), np.concatenate((self.met, np.zeros(len(new), np.int64)))
        self.met[at] += 1
        return at

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one behind the other, and the number of each one's."""
        texts = units.cast(pa.large_string())
        word = pc.match_substring_regex(texts, self._WORD).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(texts), bool)
        space, tokenize, found = self.letters[32], self.model.tokenize, []
        for name in texts.filter(pa.array(word)).to_pylist():
            if not name.isascii():
                name = name.encode().decode("latin-1").translate(self.letters)
            elif name[0] == " ":
                name = space + name[1:]
            found.append([x.id for x in tokenize(name)])
        rest = texts.filter(pa.array(~word)).to_pylist()
        for k in range(0, len(rest), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), "<u4", int(n.sum()))
        # words came first: back to the order of the units
        place = np.empty(len(n), np.int64)
        place[np.concatenate((np.flatnonzero(word), np.flatnonzero(~word)))] = np.arange(len(n))
        starts, counts = (np.cumsum(n) - n)[place], n[place]
        return ids[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)], counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, partitions: int | None = None) -> DataFrame:
    """Encode docs and write shards in ascending doc_id order under ``path``; (shard, file, documents, ids) of each.

    Texts are dealt out by ranges of doc_id first, so that they are encoded once, where they are
    written. A file's name has the attempt in it and only a finished attempt's name is returned: a
    task which is run again, or twice at once, leaves no torn shard. Null doc_ids come first.
    """
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        where = TaskContext.get()
        writer, encode = FrameWriter(), encoder(tokenizer).encode
        name = f"{path}/shard-{where.partitionId():06d}-{where.taskAttemptId()}.ids.zst"

        def parts():
            for batch in batches:
                _, offsets = spans(batch.column("text"))
                for i, j in slices(offsets, PIECE):
                    ids, counts = encode(batch.column("text").slice(i, j - i))
                    raw, ends = memoryview(ids).cast("B"), (4 * np.cumsum(counts)).tolist()
                    for doc_id, a, b in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                        yield from writer.add(doc_id, raw[a:b])
            yield from writer.finish()

        put(name, parts())
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((where.partitionId(), name, writer.documents, writer.ids), schema, strict=True)], schema=schema)

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # an id that many rows have is split by a hash of their texts
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD))
    ordered = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    return cut(ordered.mapInArrow(tidied(run), "shard int, file string, documents long, ids long").filter("documents > 0"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    spark = shards.sparkSession
    # one row per shard and no more: their running sum is the only step that a single task makes
    base, todo = 0, []
    for r in shards.select("shard", "file", "ids").orderBy("shard").toLocalIterator():
        todo.append((r.file, base))
        base += r.ids
    todo = spark.createDataFrame(todo, "file string, base long").repartition(max(1, len(todo)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with opened(file) as f:
                    r = FrameReader(f)
                    for k in range(0, len(r.doc_ids), READ):
                        part = slice(k, k + READ)
                        sums = [zlib.crc32(r.read(d)) for d in range(k, min(k + READ, len(r.doc_ids)))]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[part], mask=r.unnamed[part]), pa.array(r.before[part] + base), pa.array(r.counts[part]), pa.array(sums, pa.int64())], schema=schema)

    return todo.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, and read back: one row per row of docs.

    A null or empty text is the end id alone. Rows that repeat a doc_id follow each other in the
    order of a hash of their texts; null doc_ids come first and are read back as null. Other columns don't
    matter. An empty table writes no shard and gives an empty result.
    """
    spark = docs.sparkSession
    shards = write_shards(docs, tokenizer, new_path(spark, "tokens"))
    out = read_shards(shards)
    drop(shards)
    return out


def fetch(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one shard, by doc_id; only their frames are read."""
    with opened(path) as f:
        r = FrameReader(f)
        wanted = set(wanted)
        return {int(d): r.read(k).copy() for k, d in enumerate(r.doc_ids) if int(d) in wanted and not r.unnamed[k]}
