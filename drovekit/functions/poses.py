"""Poses as columns: unit quaternions [w, x, y, z] and translations [x, y, z], composed and inverted without matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value), where value is made once: what a lambda is given isn't an expression any more."""
    return F.transform(F.array(value), use)[0]


def times(a: Column, b: Column) -> Column:
    """The rotation b, then a."""
    def made(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.array(
            a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
            a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
            a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
            a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
        )

    return once(F.struct(a.alias("a"), b.alias("b")), made)


def conjugate(q: Column) -> Column:
    return once(q, lambda q: F.array(q[0], -q[1], -q[2], -q[3]))


def rotated(q: Column, v: Column) -> Column:
    """A vector [x, y, z] turned by a unit quaternion."""
    def made(p: Column) -> Column:
        q, v = p["q"], p["v"]
        cross = [2 * (q[2] * v[2] - q[3] * v[1]), 2 * (q[3] * v[0] - q[1] * v[2]), 2 * (q[1] * v[1] - q[2] * v[0])]
        return F.array(
            v[0] + q[0] * cross[0] + q[2] * cross[2] - q[3] * cross[1],
            v[1] + q[0] * cross[1] + q[3] * cross[0] - q[1] * cross[2],
            v[2] + q[0] * cross[2] + q[1] * cross[1] - q[2] * cross[0],
        )

    return once(F.struct(q.alias("q"), v.alias("v")), made)


def pose(q: Column, t: Column) -> Column:
    return F.struct(q.alias("q"), t.alias("t"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def composed(*poses: Column) -> Column:
    """Poses one after another: the last is applied first."""
    def two(a: Column, b: Column) -> Column:
        return once(F.struct(a.alias("a"), b.alias("b")), lambda p: pose(times(p["a"]["q"], p["b"]["q"]), plus(rotated(p["a"]["q"], p["b"]["t"]), p["a"]["t"])))

    return reduce(two, poses)


def inverse(p: Column) -> Column:
    return once(p, lambda p: pose(conjugate(p["q"]), F.transform(rotated(conjugate(p["q"]), p["t"]), lambda x: -x)))


def moved(p: Column, point: Column) -> Column:
    return once(F.struct(p.alias("p"), point.alias("v")), lambda s: plus(rotated(s["p"]["q"], s["v"]), s["p"]["t"]))


def sensor_to_lidar(sensor: Column, ego_then: Column, ego_now: Column, lidar: Column) -> Column:
    """A sensor's pose in the lidar's frame: sensor to ego at the sensor's time, to the world, to ego at the lidar's time, to the lidar."""
    return composed(inverse(lidar), inverse(ego_now), ego_then, sensor)


def heading(yaw: Column) -> Column:
    """The quaternion of a turn around the upright axis."""
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))
