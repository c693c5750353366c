"""Shared pieces of the training-data operators: working tables, size-checked joins, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many fixed-width rows (about 16 MB).
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch, where the session doesn't say: Spark's own bound is for narrow rows, these are whole texts.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Sessions that have Spark's own bound on a batch's bytes get a smaller one, for whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session (as in tests), where one
    machine runs everything, gets a temporary folder when that is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="drovekit-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that was never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends, and no executor holds it."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut``, when nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not path.startswith(("file:", "hdfs:", "s3", "gs:", "abfs")):
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a side for broadcast if its counted rows are within BROADCAST_ROWS; else leave it to a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Bytes of a broadcast side whose rows are of any length.
BROADCAST_BYTES = 16 << 20


def measured(df: DataFrame) -> DataFrame:
    """As ``small``, for a side with texts or arrays: both its rows and their bytes are counted."""
    width = {"string": F.octet_length, "binary": F.octet_length}
    each = [F.coalesce(width[t](c) if t in width else 8 * F.size(c), F.lit(0)) for c, t in df.dtypes if t in width or t.startswith("array<")]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(each, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def tidied(run: Callable) -> Callable:
    """run, and freed memory given back before and after: a worker process stays for later tasks, and its memory with it."""

    def tidy() -> None:
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def all_of(batches: Iterator) -> Iterator:
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return all_of


def keyed(cols: Iterable[str], a: str = "a", b: str = "b") -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), the component its smallest node.

    Alternating large-star and small-star steps: each is one grouped minimum (combined on the map
    side) and one join, so that no neighbourhood is ever gathered, and the number of rounds grows
    with the logarithm of a path's length. The minima are written before the join: both of its sides are
    plain shuffles then, which AQE splits where a hub has most rows. Every round ends in a table
    in the shared folder, and the one before it goes.
    Nodes without an edge are not returned; an empty graph gives an empty table.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v): u's neighbours v. Each chosen v is linked to the least node in u's neighbourhood."""
        low = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
        made.append(low)
        joined = pairs.join(low, "u")
        if large:
            joined = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        else:
            joined = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(low.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        return joined.filter(F.col("hi") != F.col("lo")).distinct()

    now = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi != lo").distinct(), "edges")
    seen, made = None, []
    while True:
        made.append(now)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        made.append(after := cut(star(both, True), "edges"))
        after = cut(star(after.select(F.col("hi").alias("u"), F.col("lo").alias("v")), False), "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        now = after
        while made:
            drop(made.pop())
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = state
