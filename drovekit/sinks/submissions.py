"""Submissions of detections, tracks and motions: boxes in the world's frame, attributes by rule, one document of results by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import poses

#: A class's attribute where no rule gives another, classes that move as vehicles and as cycles, and those not tracked.
DEFAULT = {
    "car": "vehicle.parked",
    "pedestrian": "pedestrian.moving",
    "trailer": "vehicle.parked",
    "truck": "vehicle.parked",
    "bus": "vehicle.moving",
    "motorcycle": "cycle.without_rider",
    "construction_vehicle": "vehicle.parked",
    "bicycle": "cycle.without_rider",
    "barrier": "",
    "traffic_cone": "",
}
VEHICLES = ("car", "construction_vehicle", "bus", "truck", "trailer")
CYCLES = ("bicycle", "motorcycle")
UNTRACKED = ("barrier", "traffic_cone", "construction_vehicle")
#: Speed in metres a second above which a box moves.
MOVING = 0.2


def attribute(name: Column, velocity: Column) -> Column:
    """A box's attribute by its class and speed; empty for a class without one."""
    fast = F.sqrt(velocity[0] * velocity[0] + velocity[1] * velocity[1]) > MOVING
    usual = F.create_map(*(F.lit(x) for kv in DEFAULT.items() for x in kv))
    return F.when(fast & name.isin(*VEHICLES), "vehicle.moving").when(fast & name.isin(*CYCLES), "cycle.with_rider").when(~fast & (name == "pedestrian"), "pedestrian.standing").when(~fast & (name == "bus"), "vehicle.stopped").otherwise(F.coalesce(F.try_element_at(usual, name), F.lit("")))


def in_world(boxes: DataFrame, lidar: Column, ego: Column) -> DataFrame:
    """boxes (center, yaw or rotation, velocity) with center, rotation and velocity in the world's frame, by the lidar's pose on the ego
    vehicle and that one's in the world; ``distance`` is from the ego vehicle, in the plane."""
    rotation = F.col("rotation") if "rotation" in boxes.columns else poses.heading(F.col("yaw"))
    rows = boxes.withColumns({"_on": poses.moved(lidar, F.col("center")), "_turn": poses.times(lidar["q"], rotation), "_speed": poses.rotated(lidar["q"], F.concat(F.slice("velocity", 1, 2), F.array(F.lit(0.0)))), "_ego": ego})
    return rows.withColumns({
        "distance": F.sqrt(F.col("_on")[0] * F.col("_on")[0] + F.col("_on")[1] * F.col("_on")[1]), "center": poses.moved(F.col("_ego"), F.col("_on")), "rotation": poses.times(F.col("_ego.q"), F.col("_turn")), "velocity": poses.rotated(F.col("_ego.q"), F.col("_speed")),
    }).drop("_on", "_turn", "_speed", "_ego")


def _by_token(rows: DataFrame, entry: Column, tokens: DataFrame | None) -> DataFrame:
    """(token, results: the entries, best score first, a frame's detections); tokens without a box have an empty list."""
    out = rows.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("order"), "place", entry.alias("entry")))).alias("all")).select("token", F.transform("all", lambda x: x["entry"]).alias("results"))
    if tokens is None:
        return out
    kind = out.schema["results"].dataType
    return tokens.select("token").distinct().join(out, "token", "left").withColumn("results", F.coalesce("results", F.array().cast(kind)))


def _rows(boxes: DataFrame, reach: dict[str, float] | None) -> DataFrame:
    rows = boxes.withColumn("place", F.monotonically_increasing_id()) if "place" not in boxes.columns else boxes
    if reach is not None:
        limit = F.try_element_at(F.create_map(*(F.lit(x) for k, v in reach.items() for x in (k, float(v)))), F.col("name"))
        rows = rows.filter(limit.isNull() | (F.col("distance") <= limit))
    return rows


def detections(boxes: DataFrame, tokens: DataFrame | None = None, *, reach: dict[str, float] | None = None) -> DataFrame:
    """(token, results) of boxes (token, name, score, center, size, rotation, velocity) in the world's frame; with ``reach``, boxes (with
    distance) beyond their class's are left out. Entries with one score are in the order of ``place``, or of the rows."""
    v = F.slice("velocity", 1, 2)
    entry = F.struct(F.col("token").alias("sample_token"), F.col("center").alias("translation"), "size", "rotation", v.alias("velocity"), F.col("name").alias("detection_name"), F.col("score").alias("detection_score"), attribute(F.col("name"), F.col("velocity")).alias("attribute_name"))
    return _by_token(_rows(boxes, reach), entry, tokens)


def tracks(boxes: DataFrame, tokens: DataFrame | None = None, *, threshold: float | None = None, reach: dict[str, float] | None = None) -> DataFrame:
    """As ``detections``, of boxes with an instance, from a score on and without the classes that aren't tracked."""
    rows = _rows(boxes, reach).filter(~F.col("name").isin(*UNTRACKED))
    rows = rows if threshold is None else rows.filter(F.col("score") >= threshold)
    v = F.slice("velocity", 1, 2)
    entry = F.struct(F.col("token").alias("sample_token"), F.col("center").alias("translation"), "size", "rotation", v.alias("velocity"), F.col("name").alias("tracking_name"), F.col("score").alias("tracking_score"), F.col("instance").cast("string").alias("tracking_id"))
    return _by_token(rows, entry, tokens)


def motions(boxes: DataFrame, tokens: DataFrame | None = None, *, threshold: float | None = None, reach: dict[str, float] | None = None) -> DataFrame:
    """As ``detections``, with each box's predicted paths (mode x step x [x, y]) and their scores."""
    rows = _rows(boxes, reach)
    rows = rows if threshold is None else rows.filter(F.col("score") >= threshold)
    v = F.slice("velocity", 1, 2)
    entry = F.struct(F.col("token").alias("sample_token"), F.col("center").alias("translation"), "size", "rotation", v.alias("velocity"), F.col("name").alias("detection_name"), F.col("score").alias("detection_score"), attribute(F.col("name"), F.col("velocity")).alias("attribute_name"), F.col("paths").alias("trajs"), F.col("path_scores").alias("trajs_score"))
    return _by_token(rows, entry, tokens)


def write(results: DataFrame, path: str) -> None:
    """Results as JSON lines, a token to a line: what is read line by line needs no task that holds all."""
    results.write.mode("overwrite").json(path)
