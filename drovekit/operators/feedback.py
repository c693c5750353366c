"""Feedback training of a selector: episodes move the mean score of a selection against that of a random one.

An episode compares a selector's samples with as many random ones; its reward, scaled and clipped, is the gap that the
two mean scores should have. Steps go over episodes one after another. A gap is a weighted sum of scores (1/n for a
selector's sample, -1/m for a random one), and the slope of its squared error is the error times the weighted sum of the
scores' slopes, so that a step is one reduction (of all refits without one episode together): tasks add up both over their rows, and the driver gets as many
numbers as the model has parameters. Where all episodes' rows are counted to be within ``local_bytes``, the same steps run
on a broadcast of them instead, and the refits without one episode run side by side, one task each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import scratch
from .learning import Mlp, _forward, _unpacked, penalised, pulled

#: Bytes of all episodes' rows up to which a task may hold them.
LOCAL_BYTES = 64 << 20


def picks_of(log: DataFrame) -> DataFrame:
    """(episode_id, arm, sample_token) of an episode log's arrays selector_tokens and random_tokens."""
    arms = [log.select("episode_id", F.lit(arm).alias("arm"), F.explode(f"{arm}_tokens").alias("sample_token")) for arm in ("selector", "random")]
    return arms[0].unionByName(arms[1])


def reward_scale(rewards: np.ndarray, given: float | None = None) -> float:
    """The given scale, else the median of the rewards' sizes above 1e-12, at least 1e-6; 1 without any."""
    if given is not None:
        if given <= 0:
            raise ValueError("a reward scale must be positive")
        return float(given)
    sizes = np.abs(np.asarray(rewards, float))
    sizes = sizes[sizes > 1e-12]
    return float(max(np.median(sizes), 1e-6)) if len(sizes) else 1.0


def target_gaps(rewards: np.ndarray, scale: float, clip: float) -> np.ndarray:
    return np.clip(np.asarray(rewards, float) / scale, -clip, clip)


@dataclass
class Feedback:
    """Episodes in the order of the log (one row each on the driver: they are the steps), and their samples' rows
    (number, selector, weight, sample_token, x, domain), written by episode."""

    ids: list[str]
    rewards: np.ndarray
    rows: DataFrame
    n_rows: int
    inputs: int

    def small(self, local_bytes: int) -> bool:
        return self.n_rows * (self.inputs + 3) * 8 <= local_bytes

    def arrays(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, domain, weight) of each episode. Only where ``small`` holds."""
        t = self.rows.select("number", "weight", "domain", "x").toArrow().sort_by("number")
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), self.inputs)
        at = np.searchsorted(t["number"].to_numpy(), np.arange(len(self.ids) + 1))
        domain, weight = t["domain"].to_numpy().astype(np.int64), t["weight"].to_numpy()
        return [(x[a:b], domain[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def prepared(episodes: DataFrame, picks: DataFrame, samples: DataFrame, *, min_abs_reward: float = 0.0) -> Feedback:
    """Usable feedback: episodes (episode_id, at, reward), picks (episode_id, arm: selector or random, sample_token) and
    samples (sample_token, x: array<double>, domain).

    Of an episode_id's rows the first by ``at`` counts. Episodes go whose reward is null or smaller than
    ``min_abs_reward``, or that have no known sample in one of the arms; samples that aren't in ``samples`` go. A token that an
    arm lists twice counts twice.
    """
    first = episodes.groupBy("episode_id").agg(F.min_by("reward", "at").cast("double").alias("reward"), F.min("at").alias("at")).filter(F.abs("reward") >= min_abs_reward)
    known = picks.join(first.select("episode_id"), "episode_id", "left_semi").join(samples.dropna(subset=["x"]).select("sample_token", "x", F.coalesce("domain", F.lit(-1)).cast("long").alias("domain")), "sample_token")
    known.write.parquet(path := scratch(episodes.sparkSession, "feedback"))
    known = episodes.sparkSession.read.schema(known.schema).parquet(path)
    arms = known.groupBy("episode_id").agg(F.count(F.when(F.col("arm") == "selector", 1)).alias("n"), F.count(F.when(F.col("arm") == "random", 1)).alias("m"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"))
    found = arms.filter("n > 0 and m > 0").join(first, "episode_id").orderBy("at", "episode_id").collect()  # one row an episode
    if found and min(r["lo"] for r in found) != max(r["hi"] for r in found):
        raise ValueError("samples have vectors of several lengths")
    spark = episodes.sparkSession
    kind = picks.schema["episode_id"].dataType.simpleString()
    numbers = spark.createDataFrame([(r["episode_id"], k, r["n"], r["m"]) for k, r in enumerate(found)], f"episode_id {kind}, number int, n long, m long")
    mine = F.col("arm") == "selector"
    rows = known.join(F.broadcast(numbers), "episode_id").select("number", mine.alias("selector"), F.when(mine, 1 / F.col("n")).otherwise(-1 / F.col("m")).alias("weight"), "sample_token", F.col("x").cast("array<double>").alias("x"), "domain")
    rows.repartition("number", F.pmod(F.xxhash64("sample_token"), F.lit(64))).write.partitionBy("number").parquet(path := scratch(spark, "episodes"))
    stored = spark.read.schema(rows.schema).parquet(path)
    return Feedback([r["episode_id"] for r in found], np.array([r["reward"] for r in found], float), stored, sum(r["n"] + r["m"] for r in found), found[0]["lo"] if found else 0)


def _sums(model: Mlp, flat: np.ndarray, x: np.ndarray, domain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted sum of scores (standardised), and that of their slopes."""
    z = (x - model.x_mean) / np.maximum(model.x_std, 1e-6)
    got = _forward(flat, z, domain, model.hidden, model.domains)
    return np.concatenate(([weight @ got[0]], pulled(flat, z, domain, model.hidden, model.domains, weight, got)))


def _spread_sums(model: Mlp, rows: DataFrame, slopes: bool = True) -> DataFrame:
    """(number, k, v): each episode's sums, added up in tasks first."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, totals = shared.value, {}
        for b in batches:
            numbers = b.column("number").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(m.x_mean))
            domain, weight = b.column("domain").to_numpy(), b.column("weight").to_numpy()
            for e in np.unique(numbers):
                at = numbers == e
                if slopes:
                    new = _sums(m, m.flat, x[at], domain[at], weight[at])
                else:
                    new = np.array([weight[at] @ _forward(m.flat, (x[at] - m.x_mean) / np.maximum(m.x_std, 1e-6), domain[at], m.hidden, m.domains)[0]])
                totals[e] = totals[e] + new if e in totals else new
        for e, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), e, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["number", "k", "v"])

    return rows.select("number", "weight", "domain", "x").mapInArrow(run, "number int, k int, v double").groupBy("number", "k").agg(F.sum("v").alias("v"))


def _packed(feedback: Feedback) -> DataFrame:
    """The episodes' rows as blocks (number, n, x, domain, weight), whose arrays are bytes, written by episode: a step reads them many times."""
    spark = feedback.rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column("number").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            domain, weight = b.column("domain").to_numpy().astype(np.int64), b.column("weight").to_numpy()
            found = np.unique(numbers)
            blocks = [(np.ascontiguousarray(x[at]).tobytes(), domain[at].tobytes(), weight[at].tobytes(), int(at.sum())) for at in (numbers == e for e in found)]
            xs, ds, ws, n = zip(*blocks, strict=True) if blocks else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (xs, ds, ws))], names=["number", "n", "x", "domain", "weight"])

    blocks = feedback.rows.select("number", "weight", "domain", "x").mapInArrow(run, "number int, n int, x binary, domain binary, weight binary")
    blocks.write.partitionBy("number").parquet(path := scratch(spark, "blocks"))
    return spark.read.schema(blocks.schema).parquet(path)


def _asked_sums(model: Mlp, blocks: DataFrame, asked: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """The sums of each asked (episode, parameters), all of them in one pass over the asked episodes' blocks."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((model, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, asked_), totals = shared.value, {}
        wanted: dict[int, list[int]] = {}
        for k, (e, _) in enumerate(asked_):
            wanted.setdefault(e, []).append(k)
        for b in batches:
            for number, n, x, domain, weight in zip(*(b.column(c).to_pylist() for c in ("number", "n", "x", "domain", "weight")), strict=True):
                rows = np.frombuffer(x).reshape(n, -1), np.frombuffer(domain, np.int64), np.frombuffer(weight)
                for k in wanted.get(number, ()):
                    new = _sums(m, asked_[k][1], *rows)
                    totals[k] = totals[k] + new if k in totals else new
        for k, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["asked", "k", "v"])

    rows = blocks.filter(F.col("number").isin(sorted({e for e, _ in asked}))).select("number", "n", "x", "domain", "weight")
    out = [np.zeros(len(flat) + 1) for _, flat in asked]
    for r in rows.mapInArrow(run, "asked int, k int, v double").groupBy("asked", "k").agg(F.sum("v").alias("v")).collect():  # as many as asked parameters
        out[r["asked"]][r["k"]] = r["v"]
    shared.unpersist()
    return out


def _spread_refits(model: Mlp, feedback: Feedback, seed: int, scale: float | None, clip: float, epochs: int, lr: float, l2: float) -> tuple[list[Mlp], np.ndarray]:
    """The models trained without one episode each, and that one's gap under them. All refits go step by step together: a step is one job."""
    n, inputs = len(feedback.ids), len(model.x_mean)
    blocks, held = _packed(feedback), penalised(inputs, model.hidden, model.domains)
    episodes = [np.delete(np.arange(n), k) for k in range(n)]
    targets = [target_gaps(feedback.rewards[e], reward_scale(feedback.rewards[e], scale), clip) for e in episodes]
    rngs, orders, flats = [np.random.default_rng(seed + k) for k in range(n)], [np.arange(n - 1) for _ in range(n)], [model.flat.copy() for _ in range(n)]
    for _ in range(epochs):
        for rng, order in zip(rngs, orders, strict=True):
            rng.shuffle(order)
        for step in range(n - 1):
            at = [int(order[step]) for order in orders]
            got = _asked_sums(model, blocks, [(int(episodes[k][at[k]]), flats[k]) for k in range(n)])
            flats = [flat - lr * (2 * (got[k][0] - targets[k][at[k]]) * got[k][1:] + l2 * held * flat) for k, flat in enumerate(flats)]
    return [_with(model, flat) for flat in flats], np.array([g[0] for g in _asked_sums(model, blocks, list(enumerate(flats)))])


def metrics(gaps: np.ndarray, targets: np.ndarray, rewards: np.ndarray) -> dict[str, float]:
    """Mean squared error, share of gaps with the reward's sign (0 counts as right, rewards of 0 don't count), mean gaps."""
    if not len(gaps):
        return dict.fromkeys(("feedback_mse", "preference_accuracy", "mean_score_gap", "mean_target_gap"), 0.0)
    some = np.abs(rewards) > 1e-12
    right = (gaps == 0) | (np.sign(gaps) == np.sign(rewards))
    return {"feedback_mse": float(np.mean((gaps - targets) ** 2)), "preference_accuracy": float(right[some].mean()) if some.any() else 0.0, "mean_score_gap": float(gaps.mean()), "mean_target_gap": float(targets.mean())}


def descend(model: Mlp, look: Callable[[np.ndarray, int], np.ndarray], gaps: Callable[[np.ndarray], np.ndarray], episodes: list[int], rewards: np.ndarray, targets: np.ndarray, *, epochs: int, lr: float, l2: float, seed: int) -> tuple[np.ndarray, list[dict]]:
    """Parameters after ``epochs`` passes over the episodes, each in a new order, one step an episode; and the history.

    ``look`` gives an episode's gap and its slope, ``gaps`` those of all; rewards and targets are of ``episodes``.
    """
    inputs = len(model.x_mean)
    held, flat = penalised(inputs, model.hidden, model.domains), model.flat.copy()
    rng, order, history = np.random.default_rng(seed), np.arange(len(episodes)), []
    for epoch in range(epochs):
        rng.shuffle(order)
        losses = []
        for k in order:
            got = look(flat, episodes[k])
            error = got[0] - targets[k]
            w1, _, w2, _, _, residual = _unpacked(flat, inputs, model.hidden, model.domains)
            losses.append(error * error + l2 * sum(float(np.mean(w * w)) for w in (w1, w2, residual) if w.size))
            flat = flat - lr * (2 * error * got[1:] + l2 * held * flat)
        if epoch in (0, epochs - 1) or (epoch + 1) % max(1, epochs // 10) == 0:
            m = metrics(gaps(flat), targets, rewards)
            history.append({"epoch": epoch + 1, "mean_loss": float(np.mean(losses)), **{c: m[c] for c in ("feedback_mse", "preference_accuracy", "mean_score_gap")}})
    return flat, history


def _with(model: Mlp, flat: np.ndarray) -> Mlp:
    return Mlp(flat, model.hidden, model.domains, model.x_mean, model.x_std, model.y_mean, model.y_std)


def _checked(epochs: int, lr: float, clip: float, *more: float) -> None:
    if epochs < 0 or lr <= 0 or clip <= 0 or min(more, default=0) < 0:
        raise ValueError("epochs and penalties must not be negative, lr and clip must be positive")


def gaps_of(model: Mlp, feedback: Feedback) -> np.ndarray:
    """Each episode's gap of standardised mean scores; one pass over all rows."""
    got = {r["number"]: r["v"] for r in _spread_sums(model, feedback.rows, slopes=False).collect()}
    return np.array([got[k] for k in range(len(feedback.ids))])


def finetune(model: Mlp, feedback: Feedback, *, epochs: int = 200, lr: float = 0.01, l2: float = 1e-4, scale: float | None = None, clip: float = 2.0, seed: int = 17, without: int | None = None, local_bytes: int = LOCAL_BYTES) -> tuple[Mlp, list[dict]]:
    """The model after training on all episodes, but for the one numbered ``without``, and the history of its epochs.

    Without an episode it raises. The reward scale is that of the episodes it is trained on.
    """
    _checked(epochs, lr, clip)
    episodes = [k for k in range(len(feedback.ids)) if k != without]
    if not episodes:
        raise ValueError("there is no usable feedback episode")
    how = {"epochs": epochs, "lr": lr, "l2": l2, "seed": seed}
    if feedback.small(local_bytes):
        return _refits(model, feedback, [(-1 if without is None else without, seed)], scale, clip, epochs, lr, l2)[0][1:3]
    rewards = feedback.rewards[episodes]
    spark = feedback.rows.sparkSession

    def look(flat: np.ndarray, e: int) -> np.ndarray:
        got = _spread_sums(_with(model, flat), feedback.rows.filter(F.col("number") == e)).collect()  # as many as parameters
        out = np.zeros(len(flat) + 1)
        out[[r["k"] for r in got]] = [r["v"] for r in got]
        return out

    def gaps(flat: np.ndarray) -> np.ndarray:
        return gaps_of(_with(model, flat), feedback)[episodes]

    flat, history = descend(model, look, gaps, episodes, rewards, target_gaps(rewards, reward_scale(rewards, scale), clip), **how)
    spark.catalog.clearCache()
    return _with(model, flat), history


def _refits(model: Mlp, feedback: Feedback, folds: list[tuple[int, int]], scale: float | None, clip: float, epochs: int, lr: float, l2: float) -> list[tuple[int, Mlp, list[dict], float]]:
    """(fold, model, history, gap of the fold's own episode) of each fold (the episode left out, seed), a task each, on a broadcast of
    all rows, whose bytes were checked."""
    spark = feedback.rows.sparkSession
    shared = spark.sparkContext.broadcast((model, feedback.arrays(), feedback.rewards))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, arrays, rewards = shared.value
        for f in frames:
            for fold, seed in f[["fold", "seed"]].itertuples(index=False, name=None):
                mine = [k for k in range(len(arrays)) if k != fold]
                r = rewards[mine]
                z = {k: ((arrays[k][0] - m.x_mean) / np.maximum(m.x_std, 1e-6), *arrays[k][1:]) for k in range(len(arrays))}
                gap = lambda flat, k, z=z: float(z[k][2] @ _forward(flat, z[k][0], z[k][1], m.hidden, m.domains)[0])

                def look(flat, k, z=z):
                    got = _forward(flat, z[k][0], z[k][1], m.hidden, m.domains)
                    return np.concatenate(([z[k][2] @ got[0]], pulled(flat, z[k][0], z[k][1], m.hidden, m.domains, z[k][2], got)))

                flat, history = descend(m, look, lambda p, mine=mine, gap=gap: np.array([gap(p, k) for k in mine]), mine, r, target_gaps(r, reward_scale(r, scale), clip), epochs=epochs, lr=lr, l2=l2, seed=int(seed))
                rows = [list(h.values()) for h in history]
                yield pd.DataFrame({"fold": [fold], "flat": [flat.tolist()], "history": [[float(v) for h in rows for v in h]], "gap": [gap(flat, fold) if fold >= 0 else None]})

    names = ("epoch", "mean_loss", "feedback_mse", "preference_accuracy", "mean_score_gap")
    jobs = spark.createDataFrame(folds, "fold int, seed long").repartition(len(folds), "fold")
    out = []
    for r in jobs.mapInPandas(run, "fold int, flat array<double>, history array<double>, gap double").collect():  # a model each
        history = [dict(zip(names, [int(h[0]), *h[1:]], strict=True)) for h in np.array(r["history"]).reshape(-1, len(names)).tolist()]
        out.append((r["fold"], _with(model, np.array(r["flat"])), history, r["gap"]))
    shared.unpersist()
    return sorted(out, key=lambda r: r[0])


def negative_offsets(feedback: Feedback, targets: np.ndarray, y_std: float, *, penalty: float = 0.0, bonus: float = 0.0, reward_max: float = -1e-12) -> DataFrame:
    """(sample_token, v): for each episode with a reward of at most ``reward_max``, its selector's samples lose the penalty and its
    random ones gain the bonus, times the target gap's size and the scores' deviation. Sums of at most 1e-12 are left out."""
    _checked(0, 1, 1, penalty, bonus)
    size = np.where(feedback.rewards <= reward_max, np.abs(targets), 0.0) * max(y_std, 1e-6)
    spark = feedback.rows.sparkSession
    weights = spark.createDataFrame([(k, float(s)) for k, s in enumerate(size)], "number int, size double").filter("size > 0")  # one row an episode
    v = F.col("size") * F.when(F.col("selector"), F.lit(-penalty)).otherwise(F.lit(bonus))
    return feedback.rows.select("number", "selector", "sample_token").join(F.broadcast(weights), "number").groupBy("sample_token").agg(F.sum(v).alias("v")).filter("abs(v) > 1e-12")


def offset_gaps(feedback: Feedback, offsets: DataFrame) -> np.ndarray:
    """Each episode's difference of mean offsets, in units of scores."""
    got = feedback.rows.select("number", "weight", "sample_token").join(offsets, "sample_token").groupBy("number").agg(F.sum(F.col("weight") * F.col("v")).alias("v")).collect()  # one row an episode
    out = np.zeros(len(feedback.ids))
    out[[r["number"] for r in got]] = [r["v"] for r in got]
    return out


def _fold_offsets(feedback: Feedback, sizes: np.ndarray, penalty: float, bonus: float) -> np.ndarray:
    """Each episode's difference of mean offsets where the offsets come from the other episodes: sizes[fold, episode]."""
    spark = feedback.rows.sparkSession
    weights = spark.createDataFrame([(f, e, float(sizes[f, e])) for f in range(len(sizes)) for e in range(len(sizes)) if sizes[f, e] > 0 and f != e], "number int, other int, size double")
    rows = feedback.rows.select("number", "weight", "sample_token")
    others = feedback.rows.select(F.col("number").alias("other"), "sample_token", F.when(F.col("selector"), F.lit(-penalty)).otherwise(F.lit(bonus)).alias("v")).groupBy("other", "sample_token").agg(F.sum("v").alias("v"))
    got = rows.join(others, "sample_token").join(F.broadcast(weights), ["number", "other"]).groupBy("number").agg(F.sum(F.col("weight") * F.col("v") * F.col("size")).alias("v")).collect()
    out = np.zeros(len(feedback.ids))
    out[[r["number"] for r in got]] = [r["v"] for r in got]
    return out


def leave_one_out(model: Mlp, feedback: Feedback, *, epochs: int = 200, lr: float = 0.01, l2: float = 1e-4, scale: float | None = None, clip: float = 2.0, seed: int = 17, penalty: float = 0.0, bonus: float = 0.0, reward_max: float = -1e-12, local_bytes: int = LOCAL_BYTES) -> tuple[DataFrame, list[Mlp]]:
    """(fold, episode_id, reward, reward_sign, predicted_gap, signed_margin, preference_correct) of each episode by a model that was
    trained without it, and these models. The gap is in units of scores, offsets of the other negative episodes included."""
    n = len(feedback.ids)
    if n < 3:
        raise ValueError("leave-one-out needs three episodes")
    _checked(epochs, lr, clip, penalty, bonus)
    if feedback.small(local_bytes):
        fits = _refits(model, feedback, [(k, seed + k) for k in range(n)], scale, clip, epochs, lr, l2)
        models, gaps = [f[1] for f in fits], np.array([f[3] for f in fits])
    else:
        models, gaps = _spread_refits(model, feedback, seed, scale, clip, epochs, lr, l2)
    gaps = gaps * model.y_std
    if penalty > 0 or bonus > 0:
        sizes = np.zeros((n, n))
        for k in range(n):
            rest = np.delete(feedback.rewards, k)
            sizes[k] = np.where(feedback.rewards <= reward_max, np.abs(target_gaps(feedback.rewards, reward_scale(rest, scale), clip)), 0.0) * max(model.y_std, 1e-6)
        gaps = gaps + _fold_offsets(feedback, sizes, penalty, bonus)
    rows = [(k, str(feedback.ids[k]), float(r), int(np.sign(r)), float(g), float(g * np.sign(r)), bool(r != 0 and np.sign(g) == np.sign(r))) for k, (r, g) in enumerate(zip(feedback.rewards, gaps, strict=True))]
    return feedback.rows.sparkSession.createDataFrame(rows, "fold int, episode_id string, reward double, reward_sign int, predicted_gap double, signed_margin double, preference_correct boolean"), models


def loo_summary(folds: DataFrame) -> DataFrame:
    """One row: counts of folds, accuracy over all, positive and negative rewards, the signed margins' mean, median and bounds;
    rewards of 0 count as folds only, and what has no fold is null."""
    some, right = F.col("reward_sign") != 0, F.col("preference_correct").cast("int")
    of = lambda when: F.avg(F.when(when, right))
    margin = F.when(some, F.col("signed_margin"))
    return folds.agg(
        F.count("*").alias("fold_count"),
        F.count(F.when(some, 1)).alias("nonzero_reward_fold_count"),
        of(some).alias("preference_accuracy"),
        F.count(F.when(F.col("reward_sign") > 0, 1)).alias("positive_reward_fold_count"),
        of(F.col("reward_sign") > 0).alias("positive_preference_accuracy"),
        F.count(F.when(F.col("reward_sign") < 0, 1)).alias("negative_reward_fold_count"),
        of(F.col("reward_sign") < 0).alias("negative_preference_accuracy"),
        F.avg(margin).alias("mean_signed_margin"),
        F.median(margin).alias("median_signed_margin"),
        F.min(margin).alias("min_signed_margin"),
        F.max(margin).alias("max_signed_margin"),
        F.count(F.when(some & ~F.col("preference_correct"), 1)).alias("num_wrong_sign"),
    )
