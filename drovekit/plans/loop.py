"""Queries of the feedback loop: training on episodes, refits without one, the candidate gate, over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, gate, learning
from ..sinks import scratch
from ..streaming import micro_rounds
from . import sql
from .extra import rounded, stored

#: Episodes, arms and candidates that the bound tables are dealt to; what they hold grows with the tables.
EPISODES, CANDIDATES, HASHES, FOLDS = 24, 12, 10, 5


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train samples (sample_token, scene_token, agent_count, x, domain, y)."""
    m = sql.query("manifest_scan")(spark, sf_dir).filter("split = 'train'")
    x = F.array(F.col("agent_count") / 32, F.col("ego_speed") / 30, "teacher_uncertainty", "teacher_loss")
    return m.select("sample_token", "scene_token", "agent_count", x.alias("x"), F.col("domain_id").alias("domain"), F.col("teacher_loss").alias("y"))


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Episodes (episode_id, at, reward) and their picks (episode_id, arm, sample_token): scenes by number, busy samples for the selector."""
    r = sql.query("reward_cost")(spark, sf_dir)
    # in whole billionths, so that the order of the sum doesn't matter
    mean = F.sum(F.round(F.col("reward") * 1e9).cast("long")) / F.count("*") / 1e9
    episodes = r.groupBy((F.col("episode") % EPISODES).alias("episode_id")).agg(mean.alias("reward")).withColumn("at", F.col("episode_id"))
    picks = samples(spark, sf_dir).select((F.col("scene_token") % EPISODES).alias("episode_id"), F.when(F.col("agent_count") >= 4, "selector").otherwise("random").alias("arm"), "sample_token")
    return episodes, picks


def _trained(spark: SparkSession, sf_dir: str) -> tuple[learning.Mlp, feedback.Feedback]:
    rows = stored(samples(spark, sf_dir), "samples")
    model, _ = learning.train_mlp(rows.select("sample_token", "x", "y", "domain"), hidden=8, domains=5, epochs=5)
    return model, feedback.prepared(*log(spark, sf_dir), rows)


def feedback_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's reward and target, and its gap before, after, and after with the negative samples' offsets."""
    model, f = _trained(spark, sf_dir)
    after, _ = feedback.finetune(model, f, epochs=20, lr=0.02)
    targets = feedback.target_gaps(f.rewards, feedback.reward_scale(f.rewards), 2.0)
    offsets = feedback.offset_gaps(f, feedback.negative_offsets(f, targets, model.y_std, penalty=0.1, bonus=0.05)) / max(model.y_std, 1e-6)
    before, now = feedback.gaps_of(model, f), feedback.gaps_of(after, f)
    rows = [(int(e), *map(float, r)) for e, *r in zip(f.ids, f.rewards, targets, before, now, now + offsets, strict=True)]  # one an episode
    out = spark.createDataFrame(rows, "episode_id long, reward double, target_gap double, gap_before double, gap_after double, gap_calibrated double")
    return out.select("episode_id", *(rounded(F.col(c)).alias(c) for c in out.columns[1:]))


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[learning.Mlp], feedback.Feedback]:
    model, f = _trained(spark, sf_dir)
    return *feedback.leave_one_out(model, f, epochs=5, lr=0.02, penalty=0.1, bonus=0.05), f


def leave_one_out_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _folds(spark, sf_dir)[0]
    return folds.select("fold", "episode_id", "reward_sign", *(rounded(F.col(c)).alias(c) for c in ("reward", "predicted_gap", "signed_margin")), "preference_correct")


def loo_refit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feedback.loo_summary(_folds(spark, sf_dir)[0])
    return out.select(*(rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, some under one hash, and the samples that each hash selects."""
    c = (F.col("scene_token") * 7 + F.col("sample_token")) % CANDIDATES
    dealt = samples(spark, sf_dir).select(c.cast("int").alias("c"), "sample_token")
    name = F.concat(F.lit("h"), (F.col("c") % HASHES).cast("string")).alias("selection_hash")
    found = dealt.select("c").distinct().select(name, (F.col("c") + 1).alias("rank"), (F.col("c") * 3).alias("seed"), (F.col("c") / 10).alias("replay_penalty"), F.concat(F.lit("/c/"), F.col("c").cast("string")).alias("path"))
    return found, dealt.select(name, "sample_token")


def _report(rows: DataFrame) -> DataFrame:
    part = [rounded(F.col(c)).alias(c) for c in ("fold_score_mean", "fold_score_std", "candidate_minus_random_mean", "candidate_minus_random_min", "candidate_minus_positive_mean", "candidate_minus_negative_mean")]
    boot = [rounded(F.col(f"bootstrap.{c}")).alias(f"boot_{c}") for c in ("mean", "std", "q_low", "median", "q_high", "pass_rate")]
    return rows.select("gate_rank", "selection_hash", "rank", F.size("aliases").cast("long").alias("aliases"), "selected_count", "negative_overlap", "positive_overlap", *part, *boot, "verdict", F.array_join("reasons", ",").alias("reasons"))


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate under folds that weigh loss and traffic differently."""
    rows = samples(spark, sf_dir)
    weigh = lambda f: rounded(F.col("y") * (1 + f / 10) + F.col("agent_count") * (f + 1) / 160)
    scores = rows.select("sample_token", F.array(*(weigh(float(f)) for f in range(FOLDS))).alias("scores"))
    out = gate.gated(*_candidates(spark, sf_dir), *log(spark, sf_dir), scores, max_negative_overlap=10**9, min_random_margin=0.05, min_positive_margin=-0.2, max_fold_std=0.5, bootstrap_samples=200, bootstrap_seed=9, min_bootstrap_pass_rate=0.9)
    return _report(out)


def feedback_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate under the models that were trained without one episode each."""
    _, models, f = _folds(spark, sf_dir)
    scores = gate.fold_scores(samples(spark, sf_dir), models)
    return _report(gate.gated(*_candidates(spark, sf_dir), *log(spark, sf_dir), scores, max_negative_overlap=10**9, bootstrap_samples=200, min_bootstrap_pass_rate=0.5))


def micro_round_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of selecting a twentieth of the pool, with the mean loss that is left as an arm's cost: what each round retired."""
    rows = stored(samples(spark, sf_dir).withColumn("domain_id", F.col("domain")), "samples")
    model, _ = learning.train_mlp(rows.select("sample_token", "x", "y", "domain"), hidden=8, domains=5, epochs=5)

    def cost(tokens: DataFrame) -> float:
        return -round(tokens.join(rows, "sample_token").agg(F.avg("y")).first()[0], 9)

    plan = micro_rounds.Plan(rounds=3, count=max(2, rows.count() // 20), epochs=5, penalty=0.05)
    with micro_rounds.MicroRounds(spark, scratch(spark, "rounds"), "log", rows.select("sample_token", "domain_id", "x", "domain"), model, plan) as run:
        run.run(lambda k, mine, other: (cost(mine), cost(other)))
        at = run.episodes().select(F.col("at").alias("round"), F.round("reward", 6).alias("reward"))
        return run.used().join(at, "round")


QUERIES = {f.__name__: f for f in (feedback_finetune, leave_one_out_refits, loo_refit_summary, gate_verdicts, feedback_gate, micro_round_log)}

_r = lambda x: f"floor(({x}) * 1e6 + 0.501) / 1e6"
ORACLES = {
    "gate_verdicts": f"""WITH s AS (SELECT sample_token, scene_token, agent_count, teacher_loss AS y FROM ({sql.oracle("manifest_scan")}) m WHERE split = 'train'),
        v AS (SELECT sample_token, f, {_r("y * (1 + f / 10.0::DOUBLE) + agent_count * (f + 1.0::DOUBLE) / 160")} AS v FROM s, range({FOLDS}) t(f)),
        e AS (SELECT episode % {EPISODES} AS e, sign(CAST(sum(CAST(round(reward * 1e9) AS BIGINT)) AS DOUBLE)) AS sign FROM ({sql.oracle("reward_cost")}) r GROUP BY 1),
        p AS (SELECT scene_token % {EPISODES} AS e, agent_count >= 4 AS own, sample_token FROM s),
        a AS (SELECT e.e, sign, own, f, coalesce(avg(v), 0) AS mean FROM e CROSS JOIN (SELECT unnest([true, false]) AS own) o CROSS JOIN range({FOLDS}) t(f) LEFT JOIN (SELECT e, own, f, avg(v) AS v FROM p JOIN v USING (sample_token) GROUP BY ALL) m USING (e, own, f) GROUP BY ALL),
        g AS (SELECT f, coalesce(avg(mean) FILTER (NOT own), 0) AS random, avg(mean) FILTER (own AND sign > 0) AS positive, avg(mean) FILTER (own AND sign < 0) AS negative FROM a GROUP BY f),
        d AS (SELECT CAST((scene_token * 7 + sample_token) % {CANDIDATES} AS INTEGER) AS c, sample_token FROM s), k AS (SELECT 'h' || CAST(c % {HASHES} AS VARCHAR) AS h, c, sample_token FROM d),
        n AS (SELECT h, CAST(min(c) + 1 AS INTEGER) AS rank, count(DISTINCT c) - 1 AS aliases, count(*) AS selected_count FROM k GROUP BY h),
        past AS (SELECT sample_token, max(CASE WHEN sign < 0 THEN 1 ELSE 0 END) AS bad, max(CASE WHEN sign > 0 THEN 1 ELSE 0 END) AS good FROM p JOIN e USING (e) WHERE own GROUP BY 1),
        o AS (SELECT h, sum(bad) AS bad, sum(good) AS good FROM (SELECT DISTINCT h, sample_token FROM k) x JOIN past USING (sample_token) GROUP BY h),
        m AS (SELECT h, f, avg(v) AS mean FROM k JOIN v USING (sample_token) GROUP BY ALL),
        l AS (SELECT h, list(mean - random ORDER BY f) AS random, avg(mean - positive) AS positive, avg(mean - negative) AS negative, avg(mean) AS mean, stddev_pop(mean) AS std FROM m JOIN g USING (f) GROUP BY h),
        b AS (SELECT h, unnest(list_transform(range(200), lambda b: list_sum(list_transform(range({FOLDS}), lambda j: random[1 + CAST('0x' || substr(md5('9:' || rank || ':' || b || ':' || j), 1, 8) AS BIGINT) % {FOLDS}])) / {FOLDS})) AS x FROM l JOIN n USING (h)),
        q AS (SELECT h, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.05) AS q_low, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.95) AS q_high, avg(CASE WHEN x >= 0.05 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM b GROUP BY h),
        w AS (SELECT n.*, coalesce(o.bad, 0) AS bad, coalesce(o.good, 0) AS good, list_avg(random) AS rm, list_min(random) AS rl, positive, negative, l.mean AS fm, l.std AS fs, q.mean AS bm, q.std AS bs, q_low, median, q_high, pass_rate,
              array_to_string(list_filter([CASE WHEN list_avg(random) < 0.05 THEN 'random_margin' END, CASE WHEN NOT coalesce(positive >= -0.2, false) THEN 'positive_margin' END, CASE WHEN l.std > 0.5 THEN 'fold_stability' END, CASE WHEN pass_rate < 0.9 THEN 'bootstrap_random_margin' END], lambda t: t IS NOT NULL), ',') AS reasons
              FROM n JOIN l USING (h) JOIN q USING (h) LEFT JOIN o USING (h))
        SELECT row_number() OVER (ORDER BY reasons <> '', q_low DESC, rm DESC, bad, fm DESC, rank, h) AS gate_rank, h AS selection_hash, rank, aliases, selected_count, CAST(bad AS BIGINT) AS negative_overlap, CAST(good AS BIGINT) AS positive_overlap,
        {_r("fm")} AS fold_score_mean, {_r("fs")} AS fold_score_std, {_r("rm")} AS candidate_minus_random_mean, {_r("rl")} AS candidate_minus_random_min, {_r("positive")} AS candidate_minus_positive_mean, {_r("negative")} AS candidate_minus_negative_mean,
        {_r("bm")} AS boot_mean, {_r("bs")} AS boot_std, {_r("q_low")} AS boot_q_low, {_r("median")} AS boot_median, {_r("q_high")} AS boot_q_high, {_r("pass_rate")} AS boot_pass_rate, CASE WHEN reasons = '' THEN 'pass' ELSE 'reject' END AS verdict, reasons FROM w""",
}
