"""Made-up manifests and features for trials and tests: each value is an expression of its row's number and a seed, so that any
number of rows is made where it is read, alike in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a scene, and microseconds between samples.
SCENE, STEP = 20, 500_000


def _unit(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to 1, by a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number, from two of the former."""
    return F.sqrt(-2 * F.log(_unit(seed, *keys, F.lit("r")))) * F.cos(2 * F.pi() * _unit(seed, *keys, F.lit("a")))


def manifest(spark: SparkSession, train: int = 120, val: int = 30, domains: int = 3, seed: int = 1) -> DataFrame:
    """Train samples, then validation ones: domains by turns, scenes of SCENE samples, losses that grow with traffic and domain."""
    k = F.col("id")
    domain = (k % domains).cast("int")
    rows = spark.range(train + val).withColumns({"split": F.when(k < train, "train").otherwise("val"), "domain_id": domain})
    agents = F.floor(_unit(seed, "id", F.lit("n")) * 24 + 4 * domain).cast("int")
    speed = F.round(_unit(seed, "id", F.lit("v")) * 12 + domain, 6)
    rows = rows.withColumns({"agent_count": agents, "ego_speed": speed, "scene": F.floor(k / SCENE)})
    loss = F.round(0.3 + 0.02 * F.col("agent_count") + 0.1 * domain + 0.2 * _unit(seed, "id", F.lit("l")), 6)
    return rows.select(
        F.format_string("%s_%06d", "split", "id").alias("sample_token"), F.format_string("scene_%05d", "scene").alias("scene_token"), (k * STEP).alias("timestamp"), "split", "domain_id", F.format_string("domain_%d", domain).alias("domain_name"),
        F.element_at(F.array(*map(F.lit, ("north", "south", "east"))), (F.col("scene") % 3 + 1).cast("int")).alias("location"), "ego_speed", "agent_count", loss.alias("teacher_loss"), F.round(_unit(seed, "id", F.lit("u")), 6).alias("teacher_uncertainty"),
        F.lit("{}").alias("metadata"),
    )


def features(rows: DataFrame, *, steps: int = 8, width: int = 6, scene: int = 256, interaction: int = 256, seed: int = 1) -> DataFrame:
    """sample_token, traj_raw (steps x width), scene_hidden and interaction_hidden of a manifest's rows, centred by domain."""
    vector = lambda name, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _normal(seed, F.col("sample_token"), F.lit(name), i) + 0.1 * F.col("domain_id"))
    path = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == 1, t * F.col("ego_speed") / 2).otherwise(0.1 * _normal(seed, F.col("sample_token"), t, i))))
    return rows.select("sample_token", path.alias("traj_raw"), vector("scene", scene).alias("scene_hidden"), vector("interaction", interaction).alias("interaction_hidden"), "domain_id", "teacher_loss", "teacher_uncertainty")
