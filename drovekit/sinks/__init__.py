"""Writers: guarded appends, upserts, exports in source order, small documents and reports."""

from __future__ import annotations

import io
import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_document(path: str, data: object) -> None:
    """A small JSON document with sorted keys, whole or not at all: written beside and renamed, on a local disk synced before. The path
    may be of any store that pyarrow opens."""
    fs, at = _located(path)
    folder = at.rpartition("/")[0] or "."
    fs.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside, compression=None) as f:
        f.write(json.dumps(data, sort_keys=True, indent=2).encode())
    if isinstance(fs, pafs.LocalFileSystem):
        fd = os.open(beside, os.O_RDONLY)
        os.fsync(fd)
        os.close(fd)
        os.replace(beside, at)
    else:
        fs.move(beside, at)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str, required: Iterable[str]) -> None:
    """Append rows; a row without one of the required columns' values raises before anything is written."""
    required = list(required)
    lacking = set(required) - set(df.columns)
    if lacking:
        raise ValueError(f"rows lack {sorted(lacking)}")
    if not df.filter(" or ".join(f"`{c}` is null" for c in required)).isEmpty():
        raise ValueError(f"a row has no value for one of {required}")
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """old without the keys of new, and new: of a key's new rows the last by ``at`` stays, or without it the last as new gives them.
    A null key is a key of its own."""
    order = F.col(at) if at else F.monotonically_increasing_id()
    last = new.withColumn("_at", order).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*new.columns), "_at").alias("_row")).select("_row.*")
    keys = last.select(F.col(key).alias("_key"))
    return old.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(last)


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write Parquet beside and rename: what is at the path can be what df reads. The old table goes aside first and is deleted
    last, so that a run which breaks off leaves it there or beside, under a name that ends in ``-was``; the next call restores it."""
    path = path.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, was = at(path).getFileSystem(conf), f"{path}-was"

    def move(a: str, b: str) -> None:
        if not fs.rename(at(a), at(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    if fs.exists(at(was)) and not fs.exists(at(path)):
        move(was, path)
    fs.delete(at(was), True)
    df.write.parquet(beside := f"{path}-{uuid.uuid4().hex}")
    if fs.exists(at(path)):
        move(path, was)
    move(beside, path)
    fs.delete(at(was), True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tokens(df: DataFrame, path: str, form: str = "text") -> None:
    """Tokens in the order of the rows: as text, one to a line, or as one JSON list, which a task writes as the rows come."""
    if form not in ("text", "json"):
        raise ValueError(f"no token list of the form {form}")
    if form == "text":
        df.select("sample_token").write.mode("overwrite").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _located(path)
        fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
        n, beside = 0, f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside, compression=None) as f:
            f.write(b"[")
            for b in batches:
                for token in b.column(0).to_pylist():
                    f.write((", " if n else "").encode() + json.dumps(token).encode())
                    n += 1
            f.write(b"]")
        fs.move(beside, at)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    # the order is the rows' own: a sorted table's ranges one after another, which one task may take as a stream
    ordered = df.select(F.col("sample_token").cast("string").alias("t"), F.monotonically_increasing_id().alias("at"))
    if not ordered.repartition(1).sortWithinPartitions("at").select("t").mapInArrow(write, "n long").collect():
        next(write(iter(())))  # a table without rows may run no task


def write_features(df: DataFrame, path: str) -> None:
    """Feature rows as Parquet, a folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_arrays(df: DataFrame, folder: str) -> int:
    """Each row of df (sample_token, arrays and numbers) as a compressed array file ``sample_token.npz``, whole or not at all; how many.
    Nulls have no entry. Tasks write their own rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _located(folder)
        fs.create_dir(root, recursive=True)
        n = 0
        for b in batches:
            for row in b.to_pylist():
                name = safe_member(str(row.pop("sample_token")))
                held = io.BytesIO()
                np.savez_compressed(held, **{k: np.asarray(v, np.float32 if isinstance(v, (list, float)) else None) for k, v in row.items() if v is not None})
                beside = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside, compression=None) as f:
                    f.write(held.getvalue())
                fs.move(beside, f"{root}/{name}.npz")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return sum(r["n"] for r in df.mapInArrow(write, "n long").collect())  # one row for each task


def info_subset(infos: DataFrame, tokens: DataFrame, key: str = "token") -> tuple[DataFrame, dict[str, int]]:
    """The info rows of tokens (sample_token) in their source order, and counts; a token that no row has raises."""
    wanted = tokens.select(F.col("sample_token").alias(key)).distinct()
    gone = wanted.join(infos, key, "left_anti").first()
    if gone is not None:
        raise ValueError(f"token {gone[0]} isn't in the source")
    kept = infos.withColumn("_at", F.monotonically_increasing_id()).join(wanted, key, "left_semi").orderBy("_at").drop("_at")
    return kept, {"source": infos.count(), "selected": kept.count()}


def number(x: float | None, digits: int = 4) -> str:
    return "n/a" if x is None else f"{x:.{digits}f}"


def percent(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None else f"{100 * x:.{digits}f}%"


def markdown(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A report of a small result: a title and a table. More than ``rows`` rows raise, rather than go missing."""
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    for r in found:
        out.append("| " + " | ".join(number(x) if isinstance(x, float) or x is None else str(x) for x in r) + " |")
    return "\n".join(out) + "\n"


def safe_member(name: str, link: bool = False) -> str:
    """An archive member's name, if unpacking it can't leave the target; links, absolute names and parent parts raise."""
    parts = name.replace("\\", "/").split("/")
    if link or name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise ValueError(f"unsafe archive member {name!r}")
    return name


def map_submission(lines: DataFrame) -> DataFrame:
    """(token, vectors, scores, labels) from predictions (token, vector, score, label): null and one-point vectors go."""
    kept = lines.filter(F.col("vector").isNotNull() & (F.size("vector") >= 2))
    all_ = F.sort_array(F.collect_list(F.struct(F.negative("score").alias("order"), "label", "vector", "score")))
    return kept.groupBy("token").agg(all_.alias("x")).select("token", F.col("x.vector").alias("vectors"), F.col("x.score").alias("scores"), F.col("x.label").alias("labels"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; only a local session gets a temporary one if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="drovekit-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
