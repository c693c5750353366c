"""The gate of candidate selections: margins over past episodes under several fold models, overlaps, stability, bootstrap, verdicts.

Every fold model scores every token once, as one array; a set of tokens (a candidate, or an arm of an episode) is
then a mean of arrays, added up in tasks first. Only sets, folds and their margins are left after that. Bootstrap draws are
hashes of the seed, the candidate's rank, the resample and the place in it, so that any task makes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.placement import placed
from .learning import Mlp, _forward

GATES = ("negative_overlap", "random_margin", "positive_margin", "fold_stability", "bootstrap_random_margin")


def fold_scores(samples: DataFrame, models: list[Mlp]) -> DataFrame:
    """(sample_token, scores: array<double>) of samples (sample_token, x, domain) by each model, in order."""
    shared = samples.sparkSession.sparkContext.broadcast(models)  # fold models, each of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, domain = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("domain").to_numpy(zero_copy_only=False)
            out = np.stack([_forward(m.flat, (x - m.x_mean) / np.maximum(m.x_std, 1e-6), domain, m.hidden, m.domains)[0] * m.y_std + m.y_mean for m in shared.value], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("sample_token"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], names=["sample_token", "scores"])

    schema = T.StructType([samples.schema["sample_token"], T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return samples.dropna(subset=["x"]).select("sample_token", F.col("x").cast("array<double>").alias("x"), F.coalesce("domain", F.lit(-1)).cast("long").alias("domain")).mapInArrow(run, schema)


def deduplicated(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates (selection_hash, rank, seed, replay_penalty, path) once for each hash, the smallest rank first, with the others as
    aliases in order of rank (an array of structs); null ranks come last. ``most`` keeps that many of the smallest ranks."""
    last = F.coalesce("rank", F.lit(10**9))
    fields = F.struct("rank", "path", "seed", "replay_penalty")
    rows = candidates.select("selection_hash", F.struct(last.alias("order"), "path", "seed", "replay_penalty", fields.alias("own")).alias("c"))
    rows = rows.groupBy("selection_hash").agg(F.sort_array(F.collect_list("c")).alias("c"))  # a hash's repeats, not its tokens
    out = rows.select("selection_hash", F.col("c")[0]["own"].alias("own"), F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda c: c["own"]).alias("aliases"))
    out = out.select("selection_hash", "own.*", "aliases")
    return out if most is None else out.orderBy(F.asc_nulls_last("rank"), "selection_hash").limit(most)


def set_means(picks: DataFrame, scores: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, fold, mean) of sets of tokens (keys, sample_token) under each of ``width`` folds' scores; a set without scored tokens isn't
    there. The folds are columns until the sets are means."""
    rows = picks.join(scores, "sample_token").groupBy(*keys).agg(*(F.avg(F.get("scores", F.lit(k))).alias(f"_{k}") for k in range(width)))
    return rows.select(*keys, F.posexplode(F.array(*(F.col(f"_{k}") for k in range(width)))).alias("fold", "mean")).filter("mean is not null")


def draw(seed: int, rank: Column, sample: Column, place: Column, n: Column) -> Column:
    """A place from 0 to n - 1, by the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), rank.cast("string"), sample.cast("string"), place.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def quantile(sorted_: Column, q: float) -> Column:
    """The linear quantile of a sorted array."""
    at = F.lit(q) * (F.size(sorted_) - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(sorted_, lo), F.get(sorted_, F.least(lo + 1, F.size(sorted_) - 1))
    return a + (at - lo) * (b - a)


def bootstrapped(margins: Column, rank: Column, *, samples: int, seed: int, threshold: float, low: float) -> Column:
    """A struct mean, std, q_low, median, q_high, pass_rate of the means of ``samples`` resamples of an array of margins."""
    n = F.size(margins)
    one = lambda b: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, j: s + F.get(margins, draw(seed, rank, b, j, n))) / n
    means = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), one)

    def summed(m: Column) -> Column:
        mean = F.aggregate(m, F.lit(0.0), lambda s, x: s + x) / F.size(m)
        # a lambda's argument is a value: what is named so isn't computed again
        return F.transform(F.array(F.struct(F.sort_array(m).alias("m"), mean.alias("mean"))), lambda s: F.struct(
            s["mean"].alias("mean"), F.sqrt(F.aggregate(s["m"], F.lit(0.0), lambda t, x: t + (x - s["mean"]) * (x - s["mean"])) / F.size(s["m"])).alias("std"), quantile(s["m"], low).alias("q_low"), quantile(s["m"], 0.5).alias("median"),
            quantile(s["m"], 1 - low).alias("q_high"), (F.aggregate(s["m"], F.lit(0.0), lambda t, x: t + F.when(x >= threshold, 1.0).otherwise(0.0)) / F.size(s["m"])).alias("pass_rate")))[0]

    return F.transform(F.array(means), summed)[0]


def gated(
    candidates: DataFrame, tokens: DataFrame, episodes: DataFrame, picks: DataFrame, scores: DataFrame, *,
    most: int | None = None, max_negative_overlap: int = 0, min_random_margin: float = 0.0, min_positive_margin: float | None = None, max_fold_std: float | None = None,
    bootstrap_samples: int = 0, bootstrap_seed: int = 20260706, bootstrap_quantile: float = 0.05, min_bootstrap_pass_rate: float | None = None,
) -> DataFrame:
    """Candidates with their scores, margins, overlaps, gates, verdict (pass or reject), reasons and gate_rank from 1 on.

    ``candidates`` are as for ``deduplicated``, ``tokens`` (selection_hash, sample_token) what they select, ``episodes``
    (episode_id, reward) and ``picks`` (episode_id, arm: selector or random, sample_token) the past, ``scores``
    (sample_token, scores) each fold's score of each known token. Unknown tokens don't count in a mean; a set without
    known tokens has the mean 0. The random margin is over the mean of all episodes' random means, the positive and negative
    ones over the selector means of episodes with a reward above and below 0; without such episodes they are null, and a
    least positive margin isn't met. A token counts once in an overlap. Ranks go by verdict, the bootstrap's low
    quantile, the random margin, the negative overlap, the mean score, the candidate's rank and its hash.
    """
    if bootstrap_samples < 0 or (min_bootstrap_pass_rate is not None and not (0 <= min_bootstrap_pass_rate <= 1 and bootstrap_samples > 0)) or not 0 <= bootstrap_quantile <= 1:
        raise ValueError("a pass rate from 0 to 1 needs bootstrap samples, a quantile lies from 0 to 1")
    known = deduplicated(candidates, most)
    width = scores.select(F.max(F.size("scores"))).first()[0]
    if not width:
        raise ValueError("there is no fold model's score")
    folds = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    sign = F.signum("reward").cast("int")
    zero = F.lit(0.0)

    # the folds' references: one mean for each episode and arm, 0 where it has no known token
    arms = episodes.select("episode_id", sign.alias("sign"), F.explode(F.array(F.lit("selector"), F.lit("random"))).alias("arm")).withColumn("fold", folds)
    means = arms.join(set_means(picks, scores, ["episode_id", "arm"], width), ["episode_id", "arm", "fold"], "left").withColumn("mean", F.coalesce("mean", zero))
    when = lambda c: F.avg(F.when(c, F.col("mean")))
    own = F.col("arm") == "selector"
    references = means.groupBy("fold").agg(F.coalesce(when(~own), zero).alias("random"), when(own & (F.col("sign") > 0)).alias("positive"), when(own & (F.col("sign") < 0)).alias("negative"))
    # without episodes there is no row; as many rows as folds
    references = known.sparkSession.range(width).select(F.col("id").cast("int").alias("fold")).join(references, "fold", "left").withColumn("random", F.coalesce("random", zero))

    mine = tokens.join(known.select("selection_hash"), "selection_hash", "left_semi")
    scored = known.select("selection_hash").withColumn("fold", folds).join(set_means(mine, scores, ["selection_hash"], width), ["selection_hash", "fold"], "left").withColumn("mean", F.coalesce("mean", zero))
    scored = scored.join(F.broadcast(references), "fold")
    per_fold = F.struct("fold", "mean", (F.col("mean") - F.col("random")).alias("random"), (F.col("mean") - F.col("positive")).alias("positive"), (F.col("mean") - F.col("negative")).alias("negative"))
    margins = scored.groupBy("selection_hash").agg(F.sort_array(F.collect_list(per_fold)).alias("f"))  # a struct for each fold

    past = picks.filter("arm = 'selector'").join(episodes.select("episode_id", sign.alias("sign")), "episode_id")
    past = past.groupBy("sample_token").agg(F.max((F.col("sign") < 0).cast("int")).alias("bad"), F.max((F.col("sign") > 0).cast("int")).alias("good"))
    overlaps = mine.select("selection_hash", "sample_token").distinct().join(past, "sample_token").groupBy("selection_hash").agg(F.sum("bad").alias("negative_overlap"), F.sum("good").alias("positive_overlap"))
    counts = mine.groupBy("selection_hash").agg(F.count("*").alias("selected_count"))

    part = lambda c: F.transform("f", lambda x: x[c])
    mean = lambda a: F.aggregate(a, zero, lambda s, x: s + x) / F.size(a)
    rows = known.join(margins, "selection_hash")
    rows = rows.select(
        "*", part("mean").alias("fold_scores"), part("random").alias("random_margins"),
        mean(part("random")).alias("candidate_minus_random_mean"), mean(part("positive")).alias("candidate_minus_positive_mean"), mean(part("negative")).alias("candidate_minus_negative_mean"), mean(part("mean")).alias("fold_score_mean"),
    ).drop("f").join(overlaps, "selection_hash", "left").join(counts, "selection_hash", "left").na.fill(0, ["negative_overlap", "positive_overlap", "selected_count"])
    std = F.sqrt(mean(F.transform("fold_scores", lambda x: (x - F.col("fold_score_mean")) * (x - F.col("fold_score_mean")))))
    rows = rows.withColumns({"fold_score_std": std, "fold_score_min": F.array_min("fold_scores"), "fold_score_max": F.array_max("fold_scores"), "candidate_minus_random_min": F.array_min("random_margins")})
    boot = bootstrapped(F.col("random_margins"), F.coalesce("rank", F.lit(0)), samples=bootstrap_samples, seed=bootstrap_seed, threshold=min_random_margin, low=bootstrap_quantile) if bootstrap_samples else F.lit(None).cast("struct<mean:double,std:double,q_low:double,median:double,q_high:double,pass_rate:double>")
    rows = rows.withColumn("bootstrap", boot)
    met = {
        "negative_overlap": F.col("negative_overlap") <= max_negative_overlap,
        "random_margin": F.col("candidate_minus_random_mean") >= min_random_margin,
        "positive_margin": F.lit(True) if min_positive_margin is None else F.coalesce(F.col("candidate_minus_positive_mean") >= min_positive_margin, F.lit(False)),
        "fold_stability": F.lit(True) if max_fold_std is None else F.col("fold_score_std") <= max_fold_std,
        "bootstrap_random_margin": F.lit(True) if min_bootstrap_pass_rate is None else F.col("bootstrap.pass_rate") >= min_bootstrap_pass_rate,
    }
    rows = rows.withColumn("gates", F.struct(*(met[g].alias(g) for g in GATES)))
    reasons = F.array_compact(F.array(*(F.when(~F.col(f"gates.{g}"), F.lit(g)) for g in GATES)))
    rows = rows.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "pass").otherwise("reject"))
    order = [F.col("verdict"), F.desc_nulls_last("bootstrap.q_low"), F.desc("candidate_minus_random_mean"), F.col("negative_overlap"), F.desc("fold_score_mean"), F.asc_nulls_last("rank"), F.col("selection_hash")]
    return placed(rows, order, name="gate_rank").withColumn("gate_rank", F.col("gate_rank") + 1)


def summary(report: DataFrame) -> DataFrame:
    """One row of a gate's candidates: their number, how many passed, and the first one's hash, verdict, margin, overlap and bootstrap."""
    first = F.min_by(F.struct("selection_hash", "verdict", "candidate_minus_random_mean", "negative_overlap", "bootstrap"), "gate_rank").alias("best")
    out = report.agg(F.count("*").alias("candidate_count"), F.count(F.when(F.col("verdict") == "pass", 1)).alias("pass_count"), first)
    best = F.col("best")
    return out.select("candidate_count", "pass_count", best["selection_hash"].alias("best_hash"), best["verdict"].alias("best_verdict"), best["candidate_minus_random_mean"].alias("best_candidate_minus_random_mean"), best["negative_overlap"].alias("best_negative_overlap"), best["bootstrap"]["pass_rate"].alias("best_bootstrap_pass_rate"), best["bootstrap"]["q_low"].alias("best_bootstrap_q_low"))
