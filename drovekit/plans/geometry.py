"""Queries of map geometry, over the oriented boxes of the bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps, rescore
from . import sql
from .extra import rounded, stored


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, id, rings): the boxes of a customer's orders, enlarged and brought into a patch around the origin."""
    l, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") / 1000 - 50).alias("y"), (3 + F.col("l_tax") * 60).alias("hl"), (2 + F.col("l_discount") * 20).alias("hw"), (F.pmod("l_partkey", F.lit(8)) * F.pi() / 8).alias("yaw"))
    corner = lambda a, b: F.array(F.col("x") + a * F.col("hl") * F.cos("yaw") - b * F.col("hw") * F.sin("yaw"), F.col("y") + a * F.col("hl") * F.sin("yaw") + b * F.col("hw") * F.cos("yaw"))
    return rows.select("frame", "id", F.array(F.array(*(corner(float(a), float(b)) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))))).alias("rings"))


def _length(line: str) -> Column:
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda k: F.sqrt((F.get(line, k)[0] - F.get(line, k - 1)[0]) ** 2 + (F.get(line, k)[1] - F.get(line, k - 1)[1]) ** 2))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def area_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each frame's boxes: parts, holes, area."""
    got = maps.outlined(areas(spark, sf_dir), ["frame"])
    return got.select("frame", "part", (F.size("rings") - 1).alias("holes"), rounded(F.col("area")).alias("area"))


def drivable_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries in a region of 60 by 30, simplified: points and length of each line."""
    got = maps.drivable_boundaries(areas(spark, sf_dir), (60.0, 30.0)).withColumn("line", maps.simplified(F.col("line"), 0.2))
    return got.select("frame", "place", F.size("line").alias("points"), rounded(_length("line")).alias("length"))


def merge_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-parallel boxes that meet as one, with their contour in a region of 60 by 30."""
    merged = stored(maps.merged_crossings(stored(areas(spark, sf_dir), "areas")), "merged")
    lines = maps.crossing_contours(merged, (60.0, 30.0)).select("frame", "id", "part", F.size("line").alias("points"), rounded(_length("line")).alias("length"))
    return merged.select("frame", "id", "part", rounded(F.col("area")).alias("area")).join(lines, ["frame", "id", "part"], "left")


def plan_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three modes of each order's plan against its lines as agents, with two motions each."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.col("l_linenumber") == 1
    first = l.groupBy(F.col("l_orderkey").alias("sample")).agg(F.max(F.when(one, F.col("l_discount"))).alias("d"), F.max(F.when(one, F.col("l_tax"))).alias("t")).na.fill(0.0)
    steps = F.sequence(F.lit(1), F.lit(6))
    bend = lambda k: F.transform(steps, lambda i: F.array((F.col("d") * 10 + k) * i * i / 40, i * (1 + F.col("t") * 20)))
    plans = first.select("sample", F.array(F.lit(0.5), 0.4 + F.col("d"), 0.6 - F.col("t")).alias("scores"), F.array(*(bend(float(k)) for k in (0, 2, -2))).alias("paths"))
    move = lambda u, v: F.transform(steps, lambda i: F.array(F.lit(float(u)) * F.col("l_tax") * 4, F.lit(float(v)) * F.col("l_discount") * 4))
    agents = l.select(
        F.col("l_orderkey").alias("sample"), (F.col("l_discount") * 10).alias("confidence"), ((F.col("l_quantity") - 25) / 4).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), (2 + F.col("l_tax") * 40).alias("length"), (1 + F.col("l_discount") * 5).alias("width"),
        (F.pmod("l_partkey", F.lit(8)) * F.pi() / 8).alias("yaw"), F.array(F.col("l_tax"), F.col("l_discount")).alias("motion_scores"), F.array(move(1, 0), move(0, -1)).alias("motions"),
    )
    out = rescore.rescored(plans, agents)
    return out.select("sample", "mode", *(rounded(F.get("scores", F.lit(k))).alias(f"score_{k}") for k in range(3)), F.size(F.filter("collides", lambda c: c)).alias("colliding"))


def _map_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all predicted and true lines of a frame and class, 200 points to a line; written, as several relations read it."""
    lines = sql.relation(spark, sf_dir, "map_arrays")
    side = lambda c: lines.select("frame", "label", "line", F.transform(c, lambda p: F.array(p["x"], p["y"])).alias("points"))
    return stored(maps.chamfer_pairs(side("p"), side("g"), ["frame", "label"]), "pairs")


def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every line to every line of its class, over the whole table."""
    lines = sql.relation(spark, sf_dir, "line_arrays").select("label", "line", F.transform("g", lambda p: F.array(p["x"], p["y"])).alias("points"))
    return maps.chamfer_within(lines, lines, ["label"]).select("pred", "gt", rounded(F.col("distance")).alias("distance"))


def _over_pairs(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.over(name, map_pairs=_map_pairs(spark, sf_dir))(spark, sf_dir)


QUERIES = {name: _over_pairs(name) for name in ("pairwise_distance", "map_matches", "map_ap", "map_mean_ap")} | {f.__name__: f for f in (chamfer, plan_rescore, area_outline, drivable_boundary, merge_parallel)}
ORACLES = {name: sql.oracle(name) for name in ("chamfer", "pairwise_distance", "map_matches", "map_ap", "map_mean_ap")}
