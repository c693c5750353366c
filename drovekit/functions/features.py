"""Columns of trajectories, hidden vectors and features; specs choose kinds and normalisations.

Rows have the manifest's columns, metadata as JSON text, and the arrays traj_raw (array<array<double>>),
traj_hidden, scene_hidden and interaction_hidden, any of them null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .placement import placed


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """The mean; 0 for an empty or null array."""
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(0.0)


def rms(v: Column) -> Column:
    """Root mean square; 0 for an empty or null vector."""
    return F.when(F.size(v) > 0, F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v))).otherwise(0.0)


def points(traj: Column) -> Column:
    """The first two columns of a trajectory, or its one and 0."""
    return F.transform(traj, lambda r: F.array(F.get(r, F.lit(0)), F.coalesce(F.get(r, F.lit(1)), F.lit(0.0))))


def paired(flat: Column) -> Column:
    """A flat trajectory as points: pairs if its length is even, else each value and 0."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda k: F.array(F.get(flat, 2 * k), F.get(flat, 2 * k + 1)))
    alone = F.transform(flat, lambda x: F.array(x, F.lit(0.0)))
    return F.when(F.size(flat) == 0, F.slice(alone, 1, 0)).when(F.size(flat) % 2 == 0, pairs).otherwise(alone)


def _next(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _before(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def moves(p: Column, order: int = 1) -> Column:
    """The differences of points, of an order; empty if there are too few."""
    for _ in range(order):
        p = F.zip_with(_next(p), _before(p), lambda b, a: F.array(b[0] - a[0], b[1] - a[1]))
    return p


def mean_length(v: Column) -> Column:
    return mean(F.transform(v, lambda m: F.sqrt(m[0] * m[0] + m[1] * m[1])))


def wrapped(angle: Column) -> Column:
    """An angle's difference in [-pi, pi)."""
    pi = F.pi()
    return angle - 2 * pi * F.floor((angle + pi) / (2 * pi))


def mean_turn(p: Column) -> Column:
    """The mean turn of the heading, without its sign."""
    heading = F.transform(moves(p), lambda m: F.atan2(m[1], m[0]))
    return mean(F.zip_with(_next(heading), _before(heading), lambda b, a: F.abs(wrapped(b - a))))


def speed_column(traj: Column) -> Column:
    """The mean of the third column without signs, or of all values where there are fewer columns."""
    third = F.transform(traj, lambda r: F.abs(r[2]))
    return F.when(F.size(F.get(traj, F.lit(0))) >= 3, mean(third)).otherwise(mean(F.transform(F.flatten(traj), F.abs)))


def sized(v: Column, n: int) -> Column:
    """v cut or filled with 0 to n values; what isn't finite is 0."""
    clean = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return F.slice(F.concat(F.coalesce(clean, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def one_hot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == k).cast("int"))


def hot(v: Column) -> Column:
    """The place of the greatest value, the first of several; 0 for an empty vector."""
    return F.greatest(F.coalesce(F.array_position(v, F.array_max(v)), F.lit(1)) - 1, F.lit(0)).cast("int")


def ego_speed(status: Column, step_speeds: Column) -> Column:
    """The speed of the third status value without its sign, if it is there and finite, else the mean step speed."""
    s = F.get(status, F.lit(2))
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), mean(step_speeds)).otherwise(F.abs(s))


def joined(*blocks: Column) -> Column:
    """Feature blocks as one vector, in order; a block that is null is left out."""
    return F.concat(*(F.coalesce(b, F.array().cast("array<double>")) for b in blocks))


def projected(v: Column, seed: int, name: str, inputs: int, outputs: int) -> Column:
    """tanh of a fixed Gaussian projection of a vector, which is filled with 0 to ``inputs`` values."""
    local = int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "little") % 2**32
    matrix = np.random.default_rng(local).normal(0.0, 1.0 / np.sqrt(max(inputs, 1)), (inputs, outputs)).astype(np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(np.tanh(np.stack(b.to_numpy()).astype(np.float32) @ matrix))) if len(b) else pd.Series([], dtype=object)

    # a udf's type comes from its annotations, which name Iterator[Series] here
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(sized(v, inputs))


def _meta(path: str, default: object) -> Column:
    return F.coalesce(F.expr(f"try_cast(get_json_object(metadata, '$.{path}') AS double)"), F.lit(float(default)))


#: Feature kinds: a spec makes a column.
KINDS: dict[str, Callable[[dict], Column]] = {
    "manifest_field": lambda s: F.col(s["field"]).cast("double"),
    "metadata_field": lambda s: _meta(s["field"], s.get("default", 0.0)),
    "teacher_loss": lambda s: F.col("teacher_loss").cast("double"),
    "teacher_uncertainty": lambda s: F.col("teacher_uncertainty").cast("double"),
    "agent_count_norm": lambda s: F.col("agent_count") / F.lit(float(s.get("scale", 32.0))),
    "ego_speed_norm": lambda s: F.col("ego_speed") / F.lit(float(s.get("scale", 30.0))),
    "scene_norm": lambda s: rms(F.col("scene_hidden")),
    "interaction_norm": lambda s: rms(F.col("interaction_hidden")),
    "traj_hidden_norm": lambda s: rms(F.col("traj_hidden")),
    "traj_speed_mean": lambda s: mean_length(moves(points(F.col("traj_raw")))),
    "traj_accel_abs_mean": lambda s: mean_length(moves(points(F.col("traj_raw")), 2)),
    "traj_jerk_abs_mean": lambda s: mean_length(moves(points(F.col("traj_raw")), 3)),
    "traj_curvature_abs_mean": lambda s: mean_turn(points(F.col("traj_raw"))),
    "loss_component": lambda s: _meta(f"loss_components.{s['key']}", s.get("default", 0.0)),
}


def feature(spec: dict) -> Column:
    kind = str(spec.get("kind", spec.get("source", "manifest_field")))
    if kind not in KINDS:
        raise ValueError(f"unknown feature kind {kind}")
    return KINDS[kind](spec)


#: The kinds that are made from a trajectory's staged differences and headings.
STAGED = ("traj_speed_mean", "traj_accel_abs_mean", "traj_jerk_abs_mean", "traj_curvature_abs_mean")


def _staged() -> dict[str, Column]:
    turn = mean(F.zip_with(_next(F.col("_heading")), _before(F.col("_heading")), lambda b, a: F.abs(wrapped(b - a))))
    return {"traj_speed_mean": mean_length(F.col("_moves_1")), "traj_accel_abs_mean": mean_length(F.col("_moves_2")), "traj_jerk_abs_mean": mean_length(F.col("_moves_3")), "traj_curvature_abs_mean": turn}


def with_features(rows: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """rows with a column for each feature, normalised as its spec says: identity, standard, minmax or rank,
    then scaled and shifted. Statistics of all features are one aggregate; ranks are over all rows in order of value and token."""
    kind = {k: str(s.get("kind", s.get("source", "manifest_field"))) for k, s in specs.items()}
    raw = rows
    if set(kind.values()) & set(STAGED):
        # points and their differences as columns, each once: an expression of them would make all before it twice a level
        raw = raw.withColumn("_moves_0", points(F.col("traj_raw")))
        for n in (1, 2, 3):
            raw = raw.withColumn(f"_moves_{n}", moves(F.col(f"_moves_{n - 1}")))
        raw = raw.withColumn("_heading", F.transform("_moves_1", lambda m: F.atan2(m[1], m[0])))
    raw = raw.withColumns({f"_raw_{k}": _staged()[kind[k]] if kind[k] in STAGED else feature(s) for k, s in specs.items()}).drop("_moves_0", "_moves_1", "_moves_2", "_moves_3", "_heading")
    mode = {k: s.get("normalization", "identity") for k, s in specs.items()}
    for m in set(mode.values()) - {"identity", "standard", "minmax", "rank"}:
        raise ValueError(f"unknown normalization {m}")
    stats = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_of_{k}") for k in specs for c in [f"_raw_{k}"]]
    out = raw.crossJoin(F.broadcast(raw.agg(F.count("*").alias("_n"), *stats)))  # one row
    for k, m in mode.items():
        if m == "rank":
            order = placed(raw.select("sample_token", f"_raw_{k}"), [f"_raw_{k}", "sample_token"], name=f"_rank_{k}").select("sample_token", f"_rank_{k}")
            out = out.join(order, "sample_token")
    x = lambda k: F.col(f"_raw_{k}")
    norm = {"identity": x, "standard": lambda k: (x(k) - F.col(f"_of_{k}.mean")) / (F.col(f"_of_{k}.std") + 1e-6), "minmax": lambda k: (x(k) - F.col(f"_of_{k}.lo")) / F.greatest(F.col(f"_of_{k}.hi") - F.col(f"_of_{k}.lo"), F.lit(1e-6)), "rank": lambda k: F.col(f"_rank_{k}") / F.greatest(F.col("_n") - 1, F.lit(1))}
    done = {k: norm[m](k) * float(specs[k].get("output_scale", 1.0)) + float(specs[k].get("output_offset", 0.0)) for k, m in mode.items()}
    return out.select(*rows.columns, *(c.alias(k) for k, c in done.items()))


def heuristic(weights: dict[str, float], *, bias: float = 0.0, clip: tuple[float, float] | None = None, scale: float = 1.0, offset: float = 0.0, known: tuple[str, ...] = ()) -> Column:
    """bias and weighted features, clipped, scaled and shifted; a feature that isn't known is 0."""
    score = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(k) for k, w in weights.items() if k in known), F.lit(float(bias)))
    if clip is not None:
        score = F.greatest(F.lit(float(clip[0])), F.least(F.lit(float(clip[1])), score))
    return score * float(scale) + float(offset)
