"""Evaluation by mode flags: what is asked for, as one table of metrics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extra, geometry, sql


def _melted(df: DataFrame, mode: str, of: list[str]) -> DataFrame:
    """(mode, part, metric, value) of all columns but the keys."""
    keys = F.concat_ws("@", *(F.col(c).cast("string") for c in of))
    rest = [c for c in df.columns if c not in of]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in rest)))
    return df.select(F.lit(mode).alias("mode"), keys.alias("part"), cells.alias("m")).select("mode", "part", "m.metric", "m.value")


#: Modes by name: the query of their metrics and its keys.
MODES = {
    "planning": (lambda spark, sf_dir: sql.query("planning_eval")(spark, sf_dir), ["step"]),
    "map": (geometry.QUERIES["map_ap"], ["label", "thr"]),
    "motion": (extra.motion_eval, ["class"]),
}


def evaluate(spark: SparkSession, sf_dir: str, modes: Iterable[str] | dict[str, bool]) -> DataFrame:
    """(mode, part, metric, value) of the modes asked for (names, or flags by name). Boxes and tracks (det, tracking) are scored by
    their own toolkit: asking for them, or for a mode that isn't known, raises."""
    asked = [m for m, on in modes.items() if on] if isinstance(modes, dict) else list(dict.fromkeys(modes))
    unknown = sorted(set(asked) - set(MODES))
    if unknown or not asked:
        raise ValueError(f"no evaluation of {unknown}" if unknown else "no mode is asked for")
    return reduce(DataFrame.unionByName, (_melted(MODES[m][0](spark, sf_dir), m, MODES[m][1]) for m in asked))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, {"planning": True, "map": True, "motion": False})


QUERIES = {"evaluation": evaluation}
ORACLES = {
    "evaluation": f"""SELECT 'planning' AS mode, CAST(step AS VARCHAR) AS part, unnest(['l2', 'obj_col', 'obj_box_col']) AS metric, unnest([l2, obj_col, obj_box_col]) AS value FROM ({sql.oracle("planning_eval")}) p
        UNION ALL SELECT 'map', label || '@' || CAST(thr AS VARCHAR), 'ap', ap FROM ({sql.oracle("map_ap")}) m""",
}
