"""Iterative learners whose steps are aggregates: weighted k-means and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.placement import placed
from ..sinks import scratch


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(b.num_rows, -1)


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the lowest number on a tie) and its squared distance; blocks of rows against all centres."""
    at, best = np.zeros(len(x), np.int32), np.zeros(len(x))
    for lo in range(0, len(x), step := max(1, block // max(1, len(centres)))):
        part, d = x[lo : lo + step], 0.0
        for k in range(centres.shape[1]):
            d = d + np.square(part[:, k, None] - centres[None, :, k])
        at[lo : lo + step] = d.argmin(axis=1)
        best[lo : lo + step] = d.min(axis=1)
    return at, best


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points (x: array<double>) with cluster, the nearest centre, and distance (squared); the lowest number on a tie, null without
    centres. The plan doesn't grow with the centres: tasks get them as one array. Points with a null x go."""
    if not len(centres):
        return points.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(centres, float))  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = _nearest(_vectors(b), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(d)], names=[*b.schema.names, "cluster", "distance"])

    points = points.drop("cluster", "distance").dropna(subset=["x"])
    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]))


def _sums(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """(k, 1 + dims) weights and weighted sums of the points nearest to each centre; tasks add up their own first."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros((len(c), 1 + c.shape[1]))
        for b in batches:
            x, w = _vectors(b), b.column("weight").to_numpy(zero_copy_only=False)
            at, _ = _nearest(x, c)
            for k, v in enumerate((w, *(x * w[:, None]).T)):
                total[:, k] += np.bincount(at, v, minlength=len(c))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), len(some))), pa.array(total[some].ravel())], names=["cluster", "k", "v"])

    out = np.zeros((len(centres), 1 + centres.shape[1]))
    for r in points.select("x", F.col("weight").cast("double").alias("weight")).dropna().mapInArrow(run, "cluster long, k long, v double").groupBy("cluster", "k").agg(F.sum("v").alias("v")).collect():  # a row for each centre and dimension
        out[r["cluster"], r["k"]] = r["v"]
    return out


def kmeans(points: DataFrame, k: int, *, rounds: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    """Centres of points (id, x: array<double>, weight) by Lloyd's steps.

    Starts are the farthest point from all chosen so far, from the smallest id on; an empty cluster
    restarts at the farthest point. Each step is one aggregate; only k centres reach the driver.
    """
    first = points.orderBy("id").select("x").first()
    if first is None:
        return np.empty((0, 0))
    centres = np.array([first[0]], float)
    far = lambda c: assigned(points, c).orderBy(F.desc("distance"), "id").select("x").first()[0]
    while len(centres) < k:
        centres = np.vstack((centres, far(centres)))
    return lloyd(points, centres, rounds=rounds, tolerance=tolerance)


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float) -> np.ndarray:
    """Coefficients of standardised features and, last, the intercept, which isn't penalised; one aggregate for the
    statistics and one for the Gram matrix."""
    stats = rows.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    z = [(F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit((stats[f"s_{f}"] or 0.0) + 1e-6) for f in features] + [F.lit(1.0)]
    n = len(z)
    sums = rows.agg(*(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(z[i] * F.col(target)).alias(f"y{i}") for i in range(n))).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    return np.linalg.solve(gram + penalty * np.diag([1.0] * (n - 1) + [0.0]), [sums[f"y{i}"] for i in range(n)])


def seeded(points: DataFrame, k: int, seed: int, *, rounds: int = 5, share: float = 2.0) -> np.ndarray:
    """k starts of points (id, x, weight), fewer if fewer places have a weight.

    In each round every point is drawn by a hash of its id with a chance in proportion to its weight and its squared
    distance to the nearest drawn so far, ``share`` * k of them on average; the rounds go on until there are k or no point is
    away from all drawn. These few are weighted by the points nearest to them, and the starts are drawn from them one by one on
    the driver, again in proportion to weight and squared distance.
    """
    spark = points.sparkSession
    now = points.select("id", "x", F.col("weight").cast("double").alias("weight")).dropna().filter("weight > 0").withColumn("best", F.lit(None).cast("double"))
    unit = lambda j: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    first = now.agg(F.max_by("x", F.struct(F.log(unit(-1)) / F.col("weight"), "id")).alias("x")).first()["x"]
    if first is None:
        return np.empty((0, 0))
    drawn, new, j = [list(first)], [list(first)], 0
    while True:
        near = assigned(now, np.array(new)).withColumn("best", F.least(F.coalesce("best", F.col("distance")), "distance")).select("id", "x", "weight", "best")
        near.write.parquet(path := scratch(spark, "seeds"))
        now = spark.read.schema(near.schema).parquet(path)
        total = now.agg(F.sum(F.col("weight") * F.col("best"))).first()[0] or 0.0
        if total <= 0 or (j >= rounds and len(drawn) >= k):
            break
        picked = now.filter(unit(j) < share * k * F.col("weight") * F.col("best") / total).groupBy("x").agg(F.min("id").alias("id"))  # share * k on average
        new = [list(r["x"]) for r in picked.orderBy("id").collect()]
        if not new:  # by chance none: the likeliest one
            new = [list(now.agg(F.max_by("x", F.struct(F.log(unit(j)) / (F.col("weight") * F.col("best")), "id")).alias("x")).first()["x"])]
        drawn += new
        j += 1
    places = np.unique(np.array(drawn, float), axis=0)
    weights = _sums(now.select("x", "weight"), places)[:, 0]
    rng, out = np.random.default_rng(seed), []
    chance = weights.copy()
    while len(out) < min(k, len(places)) and chance.sum() > 0:
        out.append(int(rng.choice(len(places), p=chance / chance.sum())))
        d = np.square(places - places[out[-1]]).sum(axis=1)
        nearest = d if len(out) == 1 else np.minimum(nearest, d)
        chance = weights * nearest
    return places[out]


def lloyd(points: DataFrame, centres: np.ndarray, *, rounds: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """Weighted Lloyd steps from given centres; an empty cluster restarts at the farthest point. A step is one pass."""
    if not centres.size:
        return centres
    for _ in range(rounds):
        sums = _sums(points, centres)
        some = sums[:, 0] > 0
        new = centres.copy()
        new[some] = sums[some, 1:] / sums[some, :1]
        if not some.all():
            far = assigned(points, centres).orderBy(F.desc("distance"), "id").select("x").limit(int((~some).sum())).collect()  # at most k
            for e, r in zip(np.flatnonzero(~some), far, strict=False):
                new[e] = r["x"]
        moved, centres = np.abs(new - centres).max(), new
        if moved <= tolerance:
            break
    return centres


def clustered(rows: DataFrame, weights: dict[str, float], k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """rows (sample_token, normalised features) with cluster, by weighted features, and the centres."""
    points = rows.withColumn("x", F.array(*(F.col(c) * float(w) for c, w in weights.items()))).withColumn("id", F.col("sample_token")).withColumn("weight", F.lit(1.0))
    centres = lloyd(points, seeded(points, k, seed))
    if not centres.size:
        return rows.withColumn("cluster", F.lit(0)), centres
    return assigned(points, centres).drop("x", "id", "weight", "distance"), centres


def box_anchors(boxes: DataFrame, k: int, *, reach: float = 55.0, seed: int = 0) -> np.ndarray:
    """(k, 11) detection anchors: centres of boxes (id, x, y, z) within reach, then sizes 1, heading (1, 0) and no speed."""
    near = boxes.filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < reach).select("id", F.array("x", "y", "z").alias("x"), F.lit(1.0).alias("weight"))
    centres = lloyd(near, seeded(near, k, seed))
    return np.hstack((centres, np.tile([1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0], (len(centres), 1)))) if len(centres) else np.empty((0, 11))


def line_anchors(points: DataFrame, k: int, *, count: int = 20, reach: float = 4.0, seed: int = 0) -> np.ndarray:
    """(k, count, 2) map anchors: centres of the mean points of lines (id, x, y), each spread over offsets in y."""
    means = points.groupBy("id").agg(F.array(F.avg("x"), F.avg("y")).alias("x")).withColumn("weight", F.lit(1.0))
    centres = lloyd(means, seeded(means, k, seed))
    offsets = np.stack((np.zeros(count), np.linspace(-reach, reach, count)), axis=1)
    return centres.reshape(-1, 1, 2) + offsets[None]


def path_anchors(paths: DataFrame, steps: int, k: int, *, by: str | None = None, seed: int = 0) -> dict[object, np.ndarray]:
    """(k, steps, 2) anchors of complete paths (id, path: array of x, y positions, complete, and a column ``by``): for
    each of its values, or of all paths where it has fewer than k."""
    flat = paths.filter("complete").select("id", *([by] if by else []), F.flatten("path").alias("x"), F.lit(1.0).alias("weight")).filter(F.size("x") == 2 * steps)
    kinds = [r[0] for r in flat.select(by).distinct().orderBy(by).collect()] if by else [None]
    out = {}
    for kind in kinds:
        mine = flat.filter(F.col(by) == kind) if by else flat
        mine = mine if not by or mine.limit(k).count() == k else flat
        out[kind] = lloyd(mine, seeded(mine, k, seed)).reshape(-1, steps, 2)
    return out


def _unpacked(flat: np.ndarray, inputs: int, hidden: int, domains: int) -> list[np.ndarray]:
    shapes = [(inputs, hidden), (hidden,), (hidden,), (1,), (domains,), (domains, hidden)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(shapes, ends, strict=True)]


def _forward(flat: np.ndarray, x: np.ndarray, domain: np.ndarray, hidden: int, domains: int) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2, bias, residual = _unpacked(flat, x.shape[1], hidden, domains)
    h = np.tanh(x @ w1 + b1)
    known = (domain >= 0) & (domain < domains)
    at = np.where(known, domain, 0)
    return h @ w2 + b2[0] + known * (bias[at] + (h * residual[at]).sum(axis=1)), h


def pulled(flat: np.ndarray, x: np.ndarray, domain: np.ndarray, hidden: int, domains: int, e: np.ndarray, guess_and_h: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The gradient in flat of the sum of e times each row's score."""
    _, h = guess_and_h or _forward(flat, x, domain, hidden, domains)
    _, _, w2, _, _, residual = _unpacked(flat, x.shape[1], hidden, domains)
    known = (domain >= 0) & (domain < domains)
    own = np.zeros((len(x), domains))
    own[np.flatnonzero(known), domain[known]] = 1
    gh = e[:, None] * (w2 + own @ residual) * (1 - h * h)
    return np.concatenate(((x.T @ gh).ravel(), gh.sum(0), h.T @ e, [e.sum()], own.T @ e, (own.T @ (h * e[:, None])).ravel()))


def penalised(inputs: int, hidden: int, domains: int) -> np.ndarray:
    """1 for the parameters that an L2 penalty holds (weights and residual heads), 0 for biases."""
    return np.concatenate((np.ones(inputs * hidden), np.zeros(hidden), np.ones(hidden), np.zeros(1 + domains), np.ones(domains * hidden)))


class Mlp:
    """One hidden layer of tanh, a bias and a residual head of each domain; inputs and scores are standardised."""

    def __init__(self, flat: np.ndarray, hidden: int, domains: int, x_mean: np.ndarray, x_std: np.ndarray, y_mean: float, y_std: float):
        self.flat, self.hidden, self.domains, self.x_mean, self.x_std, self.y_mean, self.y_std = flat, hidden, domains, x_mean, x_std, y_mean, y_std

    def scores(self, rows: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
        """(sample_token, score) of rows (sample_token, x, domain), as floats, with the offsets (sample_token, v) of tokens."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(frames):
            m = shared.value
            for f in frames:
                x = (np.stack(f["x"].to_numpy()) - m.x_mean) / m.x_std if len(f) else np.empty((0, len(m.x_mean)))
                f["score"] = (_forward(m.flat, x, f["domain"].to_numpy(), m.hidden, m.domains)[0] * m.y_std + m.y_mean).astype(np.float32)
                yield f[["sample_token", "score"]]

        kind = rows.schema["sample_token"].dataType.simpleString()
        out = rows.select("sample_token", "x", "domain").mapInPandas(run, f"sample_token {kind}, score float")
        if offsets is None:
            return out
        return out.join(offsets, "sample_token", "left").select("sample_token", (F.col("score") + F.coalesce("v", F.lit(0.0))).cast("float").alias("score"))


def train_mlp(rows: DataFrame, *, hidden: int = 16, domains: int = 1, epochs: int = 50, lr: float = 0.05, l2: float = 1e-4, seed: int = 0, start: Mlp | None = None) -> tuple[Mlp, list[float]]:
    """Full-batch gradient descent on rows (sample_token, x: array<double>, y, domain); the mean squared error of each epoch.

    Each epoch is one pass: tasks sum their rows' gradients, and these are summed by parameter, so
    that what the driver gets has the size of the model. Rows with a null are left out.
    """
    rows = rows.dropna(subset=["x", "y"]).select("x", F.col("y").cast("double"), F.coalesce("domain", F.lit(-1)).alias("domain"))
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to train on")
    n = first[0]
    if start is None:
        s = rows.agg(*(f(F.get("x", F.lit(k))).alias(f"{a}{k}") for k in range(n) for a, f in (("m", F.avg), ("s", F.stddev_pop))), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        rng = np.random.default_rng(seed)
        flat = np.concatenate((rng.normal(0, 1 / np.sqrt(n), n * hidden), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1 + domains), rng.normal(0, 1 / np.sqrt(hidden), domains * hidden)))
        start = Mlp(flat, hidden, domains, np.array([s[f"m{k}"] for k in range(n)]), np.array([s[f"s{k}"] for k in range(n)]) + 1e-6, s["m"], s["s"] + 1e-6)
    m, losses, spark = start, [], rows.sparkSession
    held = penalised(n, m.hidden, m.domains)
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(m)

        def gradients(frames, shared=shared):
            m, total = shared.value, np.zeros(len(shared.value.flat) + 2)
            for f in frames:
                if not len(f):
                    continue
                x, d = (np.stack(f["x"].to_numpy()) - m.x_mean) / m.x_std, f["domain"].to_numpy()
                guess, h = _forward(m.flat, x, d, m.hidden, m.domains)
                err = guess - (f["y"].to_numpy() - m.y_mean) / m.y_std
                total += np.concatenate((pulled(m.flat, x, d, m.hidden, m.domains, 2 * err, (guess, h)), [(err * err).sum(), len(x)]))
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        sums = {r["k"]: r["v"] for r in rows.mapInPandas(gradients, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        all_ = np.array([sums[k] for k in range(len(sums))])
        losses.append(all_[-2] / all_[-1])
        m = Mlp(m.flat - lr * (all_[:-2] / all_[-1] + l2 * held * m.flat), m.hidden, m.domains, m.x_mean, m.x_std, m.y_mean, m.y_std)
        shared.unpersist()
    return m, losses


def policy(rows: DataFrame, features: list[str], weights: dict[str, float], *, rounds: int = 10, share: float = 0.2, lr: float = 0.05, keep: float = 0.8, seed: int = 0) -> tuple[dict[str, float], list[float]]:
    """Weights of a linear selector over rows (sample_token, features, loss), moved in each round by the advantage of the best
    samples over as many random ones (less its running mean) along the difference of their mean features; and the rewards.
    Each arm is cut by its rows' places, which ranges give, so that no task sorts a share of all rows."""
    w, ema, rewards = dict(weights), 0.0, []
    n = rows.count()
    k = max(1, int(np.ceil(n * share)))
    rows = rows.select("sample_token", *features, "loss")
    for r in range(rounds):
        score = sum((F.col(c) * float(w.get(c, 0.0)) for c in features), F.lit(0.0))
        means = [F.avg(c).alias(c) for c in [*features, "loss"]]
        orders = F.negative(score), F.xxhash64("sample_token", F.lit(seed), F.lit(r))
        best, other = (placed(rows.withColumn("_order", by), ["_order", "sample_token"]).filter(F.col("_place") < k).agg(*means).first() for by in orders)
        reward = other["loss"] - best["loss"]
        ema = keep * ema + (1 - keep) * reward
        for c in features:
            w[c] = w.get(c, 0.0) + lr * (reward - ema) * (best[c] - other[c])
        rewards.append(reward)
    return w, rewards
