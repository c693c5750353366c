"""Vehicle messages: streams of poses and steering angles by scene, and the ego status that samples get from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "utime long, accel array<double>, rotation_rate array<double>, vel array<double>, pos array<double>, orientation array<double>, value double"
#: Numbers of an ego status: acceleration, rotation rate, velocity, steering angle.
STATUS = 10


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(scene, stream, the messages' fields) of files ``scene_stream.json``, each a list of messages; streams are pose and steeranglefeedback."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("_file", F.col("_metadata.file_name"))
    name = lambda k: F.regexp_extract("_file", r"^(.+)_(pose|steeranglefeedback)\.json$", k)
    return rows.select(name(1).alias("scene"), name(2).alias("stream"), *(c.split()[0] for c in SCHEMA.split(", "))).filter("scene != ''")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: Column) -> DataFrame:
    """left with _nearest, the value of the row of right with the same ``by`` whose ``at`` is the nearest: the later one where two are
    equally near, the last of rows with one time before, the first of them after; null without any. Rows with a null time have none.

    Both sides are one sorted stream a group (a recording); nothing is paired.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*left.columns))
    b = right.select(F.col(by).alias("_by"), F.col(at).cast("long").alias("_at"), F.struct(F.col(at).cast("long").alias("at"), value.alias("value")).alias("_value"), F.monotonically_increasing_id().alias("_n"))
    kind = b.schema["_value"].dataType
    rows = a.select(F.col(by).alias("_by"), F.col(at).cast("long").alias("_at"), F.lit(None).cast(kind).alias("_value"), F.lit(0).cast("long").alias("_n"), "_row", "_side")
    rows = rows.unionByName(b.filter("_at is not null").withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).withColumn("_side", F.lit(0)))
    # a message of a sample's own time comes after it, and so is the next one
    order = Window.partitionBy("_by").orderBy("_at", F.desc("_side"), "_n")
    before = F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_value", ignorenulls=True).over(Window.partitionBy("_by").orderBy(F.desc("_at"), "_side", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumns({"_before": before, "_after": after}).filter("_side = 1")
    took = F.when(F.col("_at").isNull(), None).when(F.col("_after").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_after")).when(F.col("_at") - F.col("_before.at") < F.col("_after.at") - F.col("_at"), F.col("_before")).otherwise(F.col("_after"))
    return found.select("_row.*", took["value"].alias("_nearest"))


def ego_status(samples: DataFrame, messages: DataFrame) -> DataFrame:
    """samples (scene, timestamp, ...) with ego_status: ten numbers of the nearest pose and steering messages of its scene; zeros where a
    scene lacks one of the streams or the message lacks a field."""
    pose = messages.filter("stream = 'pose'")
    steer = messages.filter("stream = 'steeranglefeedback'").withColumnRenamed("utime", "timestamp")
    pose = pose.withColumnRenamed("utime", "timestamp")
    rows = nearest(samples, pose, "scene", "timestamp", F.concat("accel", "rotation_rate", "vel")).withColumnRenamed("_nearest", "_pose")
    rows = nearest(rows, steer, "scene", "timestamp", F.col("value")).withColumnRenamed("_nearest", "_steer")
    status = F.when((F.size("_pose") == STATUS - 1) & F.col("_steer").isNotNull(), F.concat("_pose", F.array("_steer"))).otherwise(F.array_repeat(F.lit(0.0), STATUS))
    return rows.withColumn("ego_status", status.cast("array<float>")).drop("_pose", "_steer")
