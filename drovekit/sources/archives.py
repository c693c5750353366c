"""Archives as a data source: members are read as streams, one partition for each tar file and for each range of a zip file.

``spark.read.format("archives")`` gives a row for each member. Only headers are read, unless bodies are asked for, and a tar
file is never held: its members pass one by one. An index over many archives is made in waves, whose results are
written before the next, so that a run which breaks off goes on after the last one, and one that has found all it looks for stops.
"""

from __future__ import annotations

import codecs
import json
import posixpath
import re
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks import safe_member, scratch

NAMES = r"\.(tgz|tar|tar\.gz|zip)$"
SCHEMA = "archive string, place long, member string, kind string, length long, content binary"
#: Bytes of rows in an Arrow batch, and of a zip file in a partition.
BATCH, SPAN = 8 << 20, 256 << 20


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def listed(folder: str, pattern: str = NAMES) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's archives in order of their names; a path of one archive is that archive."""
    fs, path = located(folder)
    prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else "file://" if folder.startswith("file:") else ""
    info = fs.get_file_info(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((prefix + i.path, i.size) for i in found if i.is_file and re.search(pattern, i.path))


@contextmanager
def _opened(uri: str) -> Iterator[pa.NativeFile]:
    fs, path = located(uri)
    with fs.open_input_file(path) as f:
        yield f


def members(uri: str, span: tuple[int, int] | None = None) -> Iterator[tuple[int, str, str, int, object]]:
    """(place, name, kind, bytes, reader of the body) of an archive's members in order; kind is file, dir, link or other. A reader is
    good until the next member. ``span`` takes the zip members whose header begins in a range of bytes."""
    with _opened(uri) as f:
        if uri.endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                for k, i in enumerate(z.infolist()):
                    if span is None or span[0] <= i.header_offset < span[1]:
                        link = (i.external_attr >> 28) == 0xA
                        yield k, i.filename, "dir" if i.is_dir() else "link" if link else "file", i.file_size, lambda z=z, i=i: z.open(i)
            return
        with tarfile.open(fileobj=f, mode="r|*") as t:
            for k, m in enumerate(t):
                t.members = []  # a long archive's headers aren't kept
                kind = "file" if m.isfile() else "dir" if m.isdir() else "link" if m.issym() or m.islnk() else "other"
                yield k, m.name, kind, m.size, lambda t=t, m=m: t.extractfile(m)


class Range(InputPartition):
    def __init__(self, uri: str, span: tuple[int, int] | None):
        self.uri, self.span = uri, span


class Members(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.want = options["path"], options.get("pattern", NAMES), options.get("bodies")
        self.names, self.span = json.loads(options["archives"]) if "archives" in options else None, int(options.get("span", SPAN))

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri, size in listed(self.path, self.pattern):
            if self.names is None or uri in self.names:
                ranges = [(a, a + self.span) for a in range(0, max(size, 1), self.span)] if uri.endswith(".zip") else [None]
                out += [Range(uri, r) for r in ranges]
        return out or [Range("", None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["archive", "place", "member", "kind", "length", "content"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows, size = [], 0
        for place, name, kind, length, body in members(partition.uri, partition.span) if partition.uri else ():
            wanted = self.want is not None and kind == "file" and re.search(self.want, name)
            if wanted and length >= 2**31 - 64:
                raise ValueError(f"{name} of {partition.uri} is too long for a value: extract it")
            rows.append((partition.uri, place, name, kind, length, body().read() if wanted else None))
            size += 200 + (length if wanted else 0)
            if size >= BATCH:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class Archives(DataSource):
    """Options: path (a folder or an archive), pattern (of archives' paths), bodies (a pattern of members whose bodies are read),
    archives (a JSON list of paths to read), span (bytes of a zip file in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Members:
        return Members(dict(self.options))


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(archive, place, member, kind, length, content) of all members; content is null where no body was asked for."""
    spark.dataSource.register(Archives)
    return spark.read.format("archives").options(**{k: str(v) for k, v in options.items()}).load(path)


def objects(stream: object, chunk: int = 1 << 20) -> Iterator[str]:
    """The elements of a JSON list as texts, read bit by bit: no more than an element and a chunk is held."""
    decoder, held, at, more = json.JSONDecoder(), "", 0, True
    decode = codecs.getincrementaldecoder("utf-8")().decode
    blank = re.compile(r"[ \t\r\n,]*")

    def fill() -> bool:
        nonlocal held, at, more
        got = stream.read(chunk)
        more = bool(got)
        held, at = held[at:] + decode(got, final=not more), 0
        return more

    while not held.strip() and fill():
        pass
    at = len(held) - len(held.lstrip())
    if held[at : at + 1] != "[":
        raise ValueError("not a JSON list")
    at += 1
    while True:
        at = blank.match(held, at).end()
        if at >= len(held):
            if not fill():
                raise ValueError("the list has no end")
            continue
        if held[at] == "]":
            return
        try:
            _, end = decoder.raw_decode(held, at)
            whole = end < len(held) or held[end - 1] in '}]"'  # a number at the very end may go on
        except ValueError:
            whole = False
        if whole:
            yield held[at:end]
            at = end
        elif not fill():
            raise ValueError("the list has no end")


def tables(spark: SparkSession, path: str, prefix: str, names: list[str]) -> DataFrame:
    """(table, row: JSON text) of the tables ``prefix/name.json`` in archives, each a list of objects, read as streams; a tar file's
    reading ends when it has given all tables. A table that isn't there raises."""
    wanted = {f"{prefix}/{n}.json": n for n in names}
    rows = spark.createDataFrame([(uri,) for uri, _ in listed(path)], "uri string")
    rows = rows.repartition(max(1, rows.count()), "uri")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                left = set(wanted)
                for _, name, kind, _, body in members(uri):
                    name = name.removeprefix("./")
                    if kind == "file" and name in left:
                        left.discard(name)
                        held: list[str] = []
                        for x in objects(body()):
                            held.append(x)
                            if len(held) == 4096:
                                yield pd.DataFrame({"table": wanted[name], "row": held})
                                held = []
                        if held:
                            yield pd.DataFrame({"table": [wanted[name]] * len(held), "row": held})
                    if not left:
                        break
                for name in set(wanted) - left:  # also a table without rows is there
                    yield pd.DataFrame({"table": [wanted[name]], "row": [""]})

    out = rows.mapInPandas(load, "table string, row string")
    out.write.parquet(stored := scratch(spark, "tables"))
    out = spark.read.schema("table string, row string").parquet(stored)
    gone = set(names) - {r[0] for r in out.select("table").distinct().collect()}
    if gone:
        raise ValueError(f"{path} lacks the tables {sorted(gone)}")
    return out.filter("row != ''")


class Failed(RuntimeError):
    """Archives that can't be read; what was read is kept, and the next run goes on with these."""


def _progress(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    fs, path = located(folder)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("recursiveFileLookup", True).parquet(folder)


def index(spark: SparkSession, folder: str, required: DataFrame, progress: str, *, wave: int = 64, pattern: str = NAMES) -> tuple[DataFrame, dict]:
    """(member, archive, kind, length) of required members (member), each in the first archive by name that has it, and counts.

    Archives are scanned in order, ``wave`` at a time; each wave is written to ``progress`` before the next. A run
    goes on where another ended, and stops as soon as all is found. An archive that can't be read doesn't stop its wave: what
    the others have is kept, and Failed names it at the end.
    """
    ddl = "archive string, member string, kind string, length long"
    names = [uri for uri, _ in listed(folder, pattern)]
    required = required.select("member").distinct()
    failed: list[str] = []

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                held: list[tuple] = []
                try:
                    for _, name, kind, length, _ in members(uri):
                        held.append((uri, name, kind, length))
                        if len(held) == 8192:
                            yield pd.DataFrame(held, columns=["archive", "member", "kind", "length"])
                            held = []
                    held.append((uri, None, "scanned", 0))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, zlib.error):
                    held.append((uri, None, "failed", 0))
                yield pd.DataFrame(held, columns=["archive", "member", "kind", "length"])

    now = 0
    while True:
        have = _progress(spark, progress, ddl)
        scanned = {r[0] for r in have.filter("kind = 'scanned'").select("archive").distinct().collect()}
        todo = [n for n in names if n not in scanned and n not in failed][:wave]
        good = have.join(have.filter("kind = 'scanned'").select("archive").distinct(), "archive", "left_semi").filter("member is not null")
        left = required.join(good, "member", "left_anti")
        if not todo or left.isEmpty():
            break
        rows = spark.createDataFrame([(n,) for n in todo], "uri string").repartition(len(todo), "uri").mapInPandas(scan, ddl)
        rows.write.parquet(path := scratch(spark, "wave"))  # scanned once
        rows = spark.read.schema(ddl).parquet(path)
        kept = rows.join(required, "member", "left_semi").select(*(c.split()[0] for c in ddl.split(", "))).unionByName(rows.filter("kind = 'scanned' and member is null"))
        kept.coalesce(8).write.parquet(f"{progress}/wave-{uuid.uuid4().hex}")
        bad = [r[0] for r in rows.filter("kind = 'failed' and member is null").select("archive").collect()]
        failed += bad
        now += len(todo) - len(bad)
    found = good.groupBy("member").agg(F.min_by(F.struct("archive", "kind", "length"), "archive").alias("f")).select("member", "f.*").join(required, "member", "left_semi")
    n, total = found.count(), required.count()
    counts = {"archive_count_total": len(names), "archive_count_scanned": len(scanned), "archive_count_this_run": now, "required_count": total, "found_count": n, "missing_count": total - n, "complete": n == total or len(scanned) == len(names)}
    if failed and n < total:
        raise Failed(f"can't read {failed}")
    return found, counts


def extract(spark: SparkSession, folder: str, target: str, required: DataFrame, progress: str, *, wave: int = 64, pattern: str = NAMES) -> dict:
    """Extract required members (member) to ``target``, and counts. A member that is a link, or whose name leads out of the target,
    raises before anything is written. Archives are unpacked a wave at a time, a task each, as streams; a file gets its name
    when it is whole, and what a wave has unpacked is written to ``progress``, so that another run goes on after it.
    """
    found, counts = index(spark, folder, required, f"{progress}/index", wave=wave, pattern=pattern)

    def unsafe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bad = []
            for name, kind in zip(f["member"], f["kind"], strict=True):
                try:
                    safe_member(name, kind == "link")
                except ValueError as e:
                    bad.append(str(e))
            if bad:
                yield pd.DataFrame({"why": bad})

    first = found.select("member", "kind").mapInPandas(unsafe, "why string").orderBy("why").first()
    if first is not None:
        raise ValueError(first[0])
    done = f"{progress}/extracted"

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri, wanted in zip(f["archive"], f["members"], strict=True):
                left, n = set(wanted), 0
                fs, root = located(target)
                for _, name, kind, _, body in members(uri):
                    if name not in left:
                        continue
                    left.discard(name)
                    path = posixpath.join(root, name)
                    fs.create_dir(path.rpartition("/")[0] if kind == "file" else path, recursive=True)
                    if kind == "file":
                        beside = f"{path}.{uuid.uuid4().hex}"
                        with fs.open_output_stream(beside, compression=None) as out, body() as part:
                            while piece := part.read(1 << 20):
                                out.write(piece)
                        fs.move(beside, path)
                    n += 1
                    if not left:
                        break
                yield pd.DataFrame({"archive": [uri], "n": [n]})

    now = 0
    while True:
        before = _progress(spark, done, "archive string, n long")
        lists = found.join(before.select("archive"), "archive", "left_anti").groupBy("archive").agg(F.collect_list("member").alias("members"))  # an archive's own members
        lists = lists.orderBy("archive").limit(wave)
        k = lists.count()
        if not k:
            return {**counts, "extracted_count": before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "extracted_this_run": now}
        got = lists.repartition(k, "archive").mapInPandas(unpack, "archive string, n long")
        got.write.parquet(path := f"{done}/wave-{uuid.uuid4().hex}")
        now += spark.read.parquet(path).agg(F.sum("n")).first()[0]
