"""Readers of binary files and logs: feature arrays, point clouds, archives, training and evaluation logs."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.placement import placed
from . import archives

FEATURES = "sample_token string, traj_raw array<array<float>>, traj_hidden array<float>, scene_hidden array<float>, interaction_hidden array<float>, domain_id long, teacher_loss float, teacher_uncertainty float"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per array file, its token the file's name. Hidden vectors must be flat and all values finite, else it raises;
    arrays and numbers that a file lacks are null."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    a = {k: np.asarray(z[k], np.float32) for k in z.files if z[k].dtype.kind in "fiub"}
                for k, v in a.items():
                    if not np.isfinite(v).all():
                        raise ValueError(f"{path}: {k} has values that aren't finite")
                    if k.endswith("_hidden") and v.ndim != 1:
                        raise ValueError(f"{path}: {k} must be one-dimensional")
                flat = lambda k, a=a: a[k].tolist() if k in a else None
                number = lambda k, a=a: float(a[k]) if k in a else None
                domain = number("domain_id")
                rows.append((path.rsplit("/", 1)[1].rsplit(".", 1)[0], flat("traj_raw"), flat("traj_hidden"), flat("scene_hidden"), flat("interaction_hidden"), None if domain is None else int(domain), number("teacher_loss"), number("teacher_uncertainty")))
            yield pd.DataFrame(rows, columns=["sample_token", "traj_raw", "traj_hidden", "scene_hidden", "interaction_hidden", "domain_id", "teacher_loss", "teacher_uncertainty"]).astype({"domain_id": "Int64", "teacher_loss": "float32", "teacher_uncertainty": "float32"})

    return binary(spark, folder, "*.npz").select("path", "content").mapInPandas(load, FEATURES)


def with_features(manifest: DataFrame, features: DataFrame) -> DataFrame:
    """Manifest rows with their arrays; numbers that the arrays' files lack come from the manifest. A sample without a file raises."""
    gone = manifest.join(features, "sample_token", "left_anti").select("sample_token").first()
    if gone is not None:
        raise FileNotFoundError(f"no features of sample {gone[0]}")
    own = ("domain_id", "teacher_loss", "teacher_uncertainty")
    f = features.select(*(F.col(c).alias(f"_{c}") if c in own else F.col(c) for c in features.columns))
    joined = manifest.join(f, "sample_token")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in joined.columns if not c.startswith("_")))


def read_points(spark: SparkSession, path: str, load_dim: int, use_dim: list[int]) -> DataFrame:
    """(file, points: array<array<float>>): little-endian floats, load_dim to a point, of which use_dim are kept."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"file": frame["path"], "points": [np.frombuffer(c, "<f4").reshape(-1, load_dim)[:, use_dim].tolist() for c in frame["content"]]})

    return binary(spark, path, "*.bin").select("path", "content").mapInPandas(load, "file string, points array<array<float>>")


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, member, length) of the files in all archives of a folder, from their headers."""
    return archives.read(spark, folder).filter("kind = 'file'").select("archive", "member", "length")


def locate(index: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, archive) of required (member), the first archive in order; and the members that none has."""
    found = index.join(required.select("member").distinct(), "member", "left_semi").groupBy("member").agg(F.min("archive").alias("archive"))
    return found, required.select("member").distinct().join(found, "member", "left_anti")


def archived_tables(spark: SparkSession, path: str, prefix: str, names: list[str]) -> DataFrame:
    """(table, row: JSON text) of the tables ``prefix/name.json`` in archives; a table that isn't there raises."""
    return archives.tables(spark, path, prefix, names)


def read_train_log(spark: SparkSession, path: str, key: str = "loss") -> DataFrame:
    """(file, line, value): the loss of each line of training logs that is an object of mode 'train' with a number for the key."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    value = F.expr(f"try_cast(get_json_object(value, '$.{key}') AS double)")
    return lines.filter(F.col("value").startswith("{") & (F.get_json_object("value", "$.mode") == "train")).select("file", "line", value.alias("value")).dropna()


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, l2, obj_col, obj_box_col) of the last line of each log that has both a distance and a collision rate."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    found = lines.filter(F.col("value").startswith("{") & F.col("value").contains("obj_box_col") & F.col("value").rlike("['\"][lL]2['\"]"))
    last = found.groupBy("file").agg(F.max_by("value", "line").alias("value")).withColumn("m", F.from_json(F.translate("value", "'", '"'), "map<string,string>"))
    number = lambda k: F.expr(f"try_cast(element_at(m, '{k}') AS double)")
    return last.select("file", F.coalesce(number("l2"), number("L2")).alias("l2"), F.coalesce(number("obj_col"), F.lit(0.0)).alias("obj_col"), F.coalesce(number("obj_box_col"), F.lit(0.0)).alias("obj_box_col"))


def read_infos(rows: DataFrame, interval: int = 1) -> DataFrame:
    """Info rows in the order of their time, every ``interval``-th of all; the columns that evaluation needs must be there.

    Places come from written time ranges, so that no single task sees all rows."""
    lacking = {"token", "timestamp", "scene_token"} - set(rows.columns)
    if lacking:
        raise ValueError(f"info rows lack {sorted(lacking)}")
    ranked = placed(rows, ["timestamp", "token"])
    return ranked.filter(F.col("_place") % interval == 0).select(*rows.columns).orderBy("timestamp", "token")


def usage(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(name, files, bytes) of folders by name, from listings alone; one that isn't there has none."""
    rows = []
    for name, path in folders.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        files = binary(spark, path).select("length") if there else spark.createDataFrame([], "length long")
        rows.append(files.agg(F.lit(name).alias("name"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
    return reduce(DataFrame.unionByName, rows)


def reserve(used: DataFrame, free_bytes: int, projected_gb: dict[str, float], reserve_gb: float = 60.0) -> dict:
    """Whether what is projected leaves the reserve of what is free; sizes in GiB."""
    gib = float(1 << 30)
    now = {r["name"]: r["bytes"] / gib for r in used.collect()}  # one row a folder
    left = free_bytes / gib - sum(projected_gb.values())
    return {"current_usage": now, "projected_extra": projected_gb, "projected_total_gb": sum(now.values()) + sum(projected_gb.values()), "free_after_projection_gb": left, "ok": left >= reserve_gb}


def read_images(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """frames (sample, camera, filename) with content, a picture's bytes as they are; a file that isn't there raises when it is read."""
    found = binary(spark, folder).select("path", "content")
    root = folder.split(":", 1)[1].lstrip("/") if folder.startswith("file:") else folder.lstrip("/")
    found = found.withColumn("filename", F.substring_index("path", f"/{root.strip('/')}/", -1)).drop("path")
    rows = frames.join(found, "filename", "left")
    return rows.withColumn("content", F.coalesce("content", F.raise_error(F.concat(F.lit("no picture "), F.col("filename"))).cast("binary")))
