"""Motion evaluation: greedy matches within a sample and class, errors of the best mode, expected prediction accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placement import placed, running
from ..sinks import scratch
from .matching import greedy, nearest


def _errors(modes: Column, truth: Column) -> Column:
    """Distances of each mode's steps to the truth's steps, as far as that goes."""
    cut = lambda m: F.slice(m, F.lit(1), F.size(truth))
    return F.transform(modes, lambda m: F.zip_with(cut(m), truth, lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def metrics(modes: Column, truth: Column, miss: float = 2.0) -> dict[str, Column]:
    """min_ade, min_fde and miss of a match: the best mode's mean and last distance, and whether each mode has one above
    the limit; zeros where the truth has no step."""
    d = _errors(modes, truth)
    some = F.size(truth) > 0
    last = F.array_min(F.transform(d, lambda x: F.element_at(x, -1)))
    return {"min_ade": F.when(some, F.array_min(F.transform(d, _mean))).otherwise(0.0), "min_fde": F.when(some, last).otherwise(0.0), "miss": F.when(some, (F.array_min(F.transform(d, F.array_max)) > miss).cast("int")).otherwise(0)}


def matched(pred: DataFrame, truth: DataFrame, limit: float = 2.0) -> DataFrame:
    """Predictions (sample, class, pred_id, conf, x, y, modes) with truth_id, distance and the match's errors, null without a match
    with a ground truth (sample, class, truth_id, x, y, path). Matches never cross samples, so that confidence within one decides."""
    keys = ["sample", "class"]
    pairs = greedy(pred, truth, keys, limit)
    rows = pred.join(pairs, [*keys, "pred_id"]).join(truth.select(*keys, "truth_id", "path"), [*keys, "truth_id"], "left")
    found = F.col("truth_id").isNotNull()
    return rows.select(*keys, "pred_id", "truth_id", "conf", "distance", *(F.when(found, c).alias(k) for k, c in metrics(F.col("modes"), F.col("path")).items()))


def accuracy(matches: DataFrame, truth: DataFrame, reach: float = 2.0) -> DataFrame:
    """class, n_truth, tp, fp, min_ade, min_fde, miss_rate, epa = (matches whose last error is below reach - fp / 2) / n_truth;
    zeros for a class without predictions or matches, and no row for one without ground truth."""
    got = matches.groupBy("class").agg(F.count("truth_id").alias("tp"), F.count_if(F.col("truth_id").isNull()).alias("fp"), F.count_if(F.col("min_fde") < reach).alias("hits"), *(F.avg(c).alias(c) for c in ("min_ade", "min_fde")), F.avg("miss").alias("miss_rate"))
    n = truth.groupBy("class").agg(F.count("*").alias("n_truth"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = n.join(got, "class", "left").select("class", "n_truth", *map(zero, ("tp", "fp", "hits")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min_ade", "min_fde", "miss_rate")))
    return rows.withColumn("epa", F.when(F.col("tp") > 0, (F.col("hits") - 0.5 * F.col("fp")) / F.col("n_truth")).otherwise(0.0)).drop("hits")


def end_error(modes: Column, truth: Column, steps: int = 12) -> Column:
    """The least distance of the modes to the truth at its last step, or at ``steps`` if it has more; null where it has none."""
    n = F.least(F.size(truth), F.lit(steps))
    end = F.get(truth, n - 1)
    d = F.transform(modes, lambda m: F.sqrt((F.get(m, n - 1)[0] - end[0]) * (F.get(m, n - 1)[0] - end[0]) + (F.get(m, n - 1)[1] - end[1]) * (F.get(m, n - 1)[1] - end[1])))
    return F.when(n > 0, F.array_min(d))


def by_trajectory(pred: DataFrame, truth: DataFrame, limit: float = 2.0, reach: float = 2.0) -> DataFrame:
    """(sample, class, pred_id, truth_id, distance): matches as of ``matched``, but a prediction takes its nearest free truth only if
    its best mode also ends within ``reach`` of that one's end; else the truth stays free."""
    keys = ["sample", "class"]
    p, t = pred.select(*keys, "pred_id", "conf", F.col("x").alias("px"), F.col("y").alias("py"), "modes"), truth.select(*keys, "truth_id", "x", "y", "path")
    distance = F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))
    pairs = p.join(t, keys).withColumn("distance", distance).filter(F.col("distance") < limit)
    return nearest(pairs.select(*keys, "pred_id", "conf", "truth_id", "distance", F.coalesce(end_error(F.col("modes"), F.col("path")) < reach, F.lit(False)).alias("ok")), keys)


def trajectory_accuracy(matches: DataFrame, by_path: DataFrame, truth: DataFrame) -> DataFrame:
    """(class, traj_matched, epa_traj): (matches by trajectory - fp / 2) / n_truth, where fp are the predictions without a match by place;
    0 for a class without a match by place, and no row for one without ground truth."""
    n = truth.groupBy("class").agg(F.count("*").alias("n_truth"))
    fp = matches.groupBy("class").agg(F.count_if(F.col("truth_id").isNull()).alias("fp"), F.count("truth_id").alias("tp"))
    hits = by_path.groupBy("class").agg(F.count("*").alias("traj_matched"))
    rows = n.join(fp, "class", "left").join(hits, "class", "left").na.fill(0, ["fp", "tp", "traj_matched"])
    return rows.select("class", "traj_matched", F.when(F.col("tp") > 0, (F.col("traj_matched") - 0.5 * F.col("fp")) / F.col("n_truth")).otherwise(0.0).alias("epa_traj"))


def _between(x: Column, a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """The line through (a, fa) and (b, fb) at x; fa where there is no b."""
    return F.when(b.isNull() | (x == a), fa).otherwise(fa + (fb - fa) / (b - a) * (x - a))


def curves(matches: DataFrame, truth: DataFrame, points: int = 101) -> DataFrame:
    """(class, point, recall, precision, confidence, min_ade, min_fde, miss_rate) at evenly spaced recalls from 0 to 1.

    Predictions go by confidence, the later sample and prediction first on a tie. Precision and confidence are
    interpolated over recall, from the first prediction's before it and 0 beyond the last; the errors' means over the matches so far are
    interpolated over the matches' confidence, at the point's. A class without a match, or without ground truth, has no rows.
    Places and sums are made over ranges and blocks, so that one class may have most rows; what is interpolated between
    comes from joins on the number of matches and on which of a class's points a confidence lies between.
    """
    spark = matches.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := scratch(spark, name))
        return spark.read.schema(df.schema).parquet(path)

    tp = F.col("truth_id").isNotNull().cast("long")
    errors = ["min_ade", "min_fde", "miss"]
    rows = matches.select("class", "sample", "pred_id", F.col("conf").cast("double").alias("conf"), tp.alias("tp"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in errors))
    rows = placed(rows, [F.desc("conf"), F.desc("sample"), F.desc("pred_id")], within=["class"], name="at")
    rows = kept(running(rows.drop("sample", "pred_id"), "class", "at", ["tp", *errors]).select("class", "at", "conf", "tp", F.col("s_tp").alias("t"), *(F.col(f"s_{c}").alias(c) for c in errors)), "curve")
    n = truth.groupBy("class").agg(F.count("*").alias("npos"))
    ends = rows.groupBy("class").agg(F.max("t").alias("most")).filter("most > 0").join(n, "class")
    row = F.struct("at", "conf", (F.col("t") / (F.col("at") + 1)).alias("precision"))
    steps = kept(rows.groupBy("class", "t").agg(F.min(row).alias("first"), F.max(row).alias("last")), "steps")  # rows of one recall

    r = F.col("point") / F.lit(float(points - 1))
    guess = F.floor(r * F.col("npos"))
    below = lambda t: t / F.col("npos") <= F.col("recall")
    asked = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("recall", r).withColumn("guess", guess)
    asked = asked.withColumn("t", F.when(below(F.col("guess") + 1), F.col("guess") + 1).when(below(F.col("guess")), F.col("guess")).otherwise(F.col("guess") - 1))
    lower = steps.select("class", "t", F.col("last").alias("lo"))
    upper = steps.select("class", (F.col("t") - 1).alias("t"), F.col("first").alias("hi"))
    got = asked.join(lower, ["class", "t"], "left").join(upper, ["class", "t"], "left")
    at = lambda c: _between(F.col("recall"), F.col("t") / F.col("npos"), F.when(F.col("hi").isNotNull(), (F.col("t") + 1) / F.col("npos")), F.col(f"lo.{c}"), F.col(f"hi.{c}"))
    # beyond the last recall 0; before the first prediction that is a match, where there is none below, that one's
    value = lambda c: F.when(F.col("recall") > F.col("most") / F.col("npos"), 0.0).when(F.col("lo").isNull(), F.col(f"hi.{c}")).otherwise(at(c))
    got = kept(got.select("class", "point", "recall", value("precision").alias("precision"), value("conf").alias("confidence")), "points")

    # each match lies between two of its class's points; of those between two, the ends are enough
    xs = got.groupBy("class").agg(F.sort_array(F.collect_set("confidence")).alias("xs"))  # at most as many as points
    mean = F.struct("conf", F.negative("at").alias("order"), *((F.col(c) / F.col("t")).alias(c) for c in errors))
    placed_ = rows.filter("tp = 1").join(F.broadcast(xs), "class").withColumn("slot", F.size(F.filter("xs", lambda p: p < F.col("conf"))))
    slots = placed_.groupBy("class", "slot").agg(F.min(mean).alias("lowest"), F.max(mean).alias("highest")).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("slot", "lowest", "highest"))).alias("slots"))
    found = got.join(xs, "class").join(slots, "class").withColumn("i", F.array_position("xs", F.col("confidence")).cast("int") - 1)
    found = found.withColumns({"lo": F.try_element_at(F.filter("slots", lambda s: s["slot"] <= F.col("i")), F.lit(-1))["highest"], "hi": F.try_element_at(F.filter("slots", lambda s: s["slot"] > F.col("i")), F.lit(1))["lowest"]})
    error = lambda c: F.when(F.col("lo").isNull(), F.col(f"hi.{c}")).otherwise(_between(F.col("confidence"), F.col("lo.conf"), F.col("hi.conf"), F.col(f"lo.{c}"), F.col(f"hi.{c}")))
    return found.select("class", "point", "recall", "precision", "confidence", error("min_ade").alias("min_ade"), error("min_fde").alias("min_fde"), error("miss").alias("miss_rate"))
