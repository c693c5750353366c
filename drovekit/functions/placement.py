"""Exact places in a sorted order, over all rows or within groups, and running sums, without a task that sees all rows of a group.

The rows are ranged and sorted once and written with their partition and their place in it. Everything else is
computed from that one table: ranges are cut from a sample, and a second run of the same plan may cut them elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks import scratch


#: Rows of a running sum that a window holds together.
BLOCK = 512


def _stored(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(within: Sequence[str]):
    """Arrow batches of one sorted partition with _at, the place in the partition, and _in, that in the row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, last = 0, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for c in within:
                ends = pc.run_end_encode(b.column(c)).run_ends.to_numpy()
                fresh[ends[:-1]] = True
            first = tuple(b.column(c)[0].as_py() for c in within)
            fresh[0] = last is not None and first != last
            last = tuple(b.column(c)[n - 1].as_py() for c in within)
            places = np.arange(at, at + n)
            starts = np.maximum.accumulate(np.where(fresh, places, start))
            at, start = at + n, int(starts[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places), pa.array(places - starts)], names=[*b.schema.names, "_at", "_in"])

    return run


def placed(rows: DataFrame, order: Sequence[str | Column], *, within: Sequence[str] = (), name: str = "_place") -> DataFrame:
    """rows with their place from 0 on in the given order, over all rows or, with ``within``, in each group of equal columns.

    A group may hold any share of the rows: it lies in as many ranges as it needs. Rows that tie in all of ``order`` get
    different places in any order. Nulls of ``within`` are a group; null places sort as Spark sorts them, or as the order says.
    The driver gets one row for each partition. An empty table stays empty. Columns named _at, _in, _part are replaced.
    """
    rows = rows.drop("_at", "_in", "_part")
    by = [*within, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_in", T.LongType())])
    ranged = ranged.mapInArrow(_numbered(within), schema).withColumn("_part", F.spark_partition_id())
    ranged = _stored(ranged, "placed")
    key = F.struct(*(F.col(c) for c in within)) if within else F.lit(0)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.max_by("_in", "_at").alias("tail"))
    carries, before = [], None
    for p in sorted(parts.collect(), key=lambda r: r["_part"]):  # one row a partition
        carry = before[1] if before is not None and before[0] == p["first"] else 0
        carries.append((p["_part"], carry))
        before = (p["last"], p["tail"] + 1 + (carry if p["tail"] == p["n"] - 1 else 0))
    offsets = rows.sparkSession.createDataFrame(carries, "_part int, _carry long")
    place = F.col("_in") + F.when(F.col("_in") == F.col("_at"), F.col("_carry")).otherwise(F.lit(0))
    return ranged.join(F.broadcast(offsets), "_part").select(*rows.columns, place.alias(name))


def running(rows: DataFrame, key: str, at: str, sums: list[str], modulus: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows with s_<column>, its sum over the key's rows up to ``at`` (0, 1, ... without gaps or repeats), modulo ``modulus``.

    Windows hold a block of a key. What comes before a block is the running sum of the blocks' totals, by the same rule, so
    that a key may hold any share of the rows.
    """
    held = lambda c: c if modulus is None else c % F.lit(modulus)
    number = f"{at}_block"
    rows = rows.withColumn(number, F.floor(F.col(at) / block))
    if not (rows.agg(F.max(number)).first()[0] or 0):
        w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(held(F.sum(c).over(w)).alias(f"s_{c}") for c in sums)).drop(number)
    w = Window.partitionBy(key, number).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *(F.sum(c).over(w).alias(f"s_{c}") for c in sums))
    long_ones = rows.filter(F.col(number) > 0).select(key).distinct()
    totals = _stored(rows.join(long_ones, key, "left_semi").groupBy(key, number).agg(*(held(F.sum(c)).alias(c) for c in sums)), "blocks")
    before = running(totals, key, number, sums, modulus, block).select(key, number, *((F.col(f"s_{c}") - F.col(c)).alias(f"_{c}") for c in sums))
    kept = [c for c in rows.columns if c != number]
    return inside.join(before, [key, number], "left").select(*kept, *(held(F.col(f"s_{c}") + F.coalesce(f"_{c}", F.lit(0)) + F.lit(modulus or 0)).alias(f"s_{c}") for c in sums))


def decayed(rows: DataFrame, key: str, at: str, value: str, *, keep: float, gain: float, block: int = BLOCK) -> DataFrame:
    """rows with before, the running mean m = keep * m + gain * value of the key's rows before each (``at`` is 0, 1, ... without gaps),
    0 before the first.

    Within a block it is one sum of powers. A block starts from what the blocks before it ended with, itself decayed by a block's
    length for each: all but the last few are below the last bit of a double then, and are left out.
    """
    if not 0 < keep < 1 or keep**-block > 1e200:
        raise ValueError("keep lies between 0 and 1, and a block's decay must be a number")
    far = next(n for n in range(1, 1 << 20) if keep ** (n * block) < 1e-18)
    number = f"{at}_block"
    rows = rows.withColumn(number, F.floor(F.col(at) / block))
    inside = F.col(at) - F.col(number) * block
    weighed = F.col(value) * F.pow(F.lit(keep), -inside - 1)
    w = Window.partitionBy(key, number).orderBy(at)
    sums = F.coalesce(F.sum(weighed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ends = rows.groupBy(key, number).agg((F.sum(weighed) * gain).alias("_end"), F.count("*").alias("_n")).withColumn("_end", F.col("_end") * F.pow(F.lit(keep), F.col("_n")))
    ends = _stored(ends, "decays")
    # what a block passes on to the next ones: to the n-th after it, decayed by the blocks between
    ahead = F.inline(F.transform(F.sequence(F.lit(1), F.lit(far)), lambda n: F.struct((F.col(number) + n).alias("_to"), (F.col("_end") * F.pow(F.lit(keep), (n - 1) * block)).alias("_from"))))
    carried = ends.select(key, number, "_end").select(key, ahead).groupBy(key, F.col("_to").alias(number)).agg(F.sum("_from").alias("_carry"))
    out = rows.select("*", sums.alias("_sums")).join(carried, [key, number], "left")
    before = (F.col("_sums") * gain + F.coalesce("_carry", F.lit(0.0))) * F.pow(F.lit(keep), inside)
    return out.select(*(c for c in rows.columns if c != number), before.alias("before"))
