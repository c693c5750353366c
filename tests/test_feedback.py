"""Feedback training, refits without one episode: against a plain numpy version of the same steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovekit.operators import feedback, learning

D, H, K = 4, 5, 3
RNG = np.random.default_rng(11)
X = RNG.normal(0, 1, (60, D))
DOMAIN = RNG.integers(-1, K, 60)
REWARDS = [1.5, -0.5, 0.0, 2.5, -3.0, 0.75]
ARMS = {f"e{k}": (RNG.choice(60, 8).tolist(), RNG.choice(60, 6).tolist()) for k in range(len(REWARDS))}


def start():
    rng = np.random.default_rng(3)
    size = D * H + H + H + 1 + K + K * H
    return learning.Mlp(rng.normal(0, 0.5, size), H, K, np.full(D, 0.1), np.full(D, 1.3), 0.4, 2.0)


@pytest.fixture(scope="module")
def parts(spark):
    samples = spark.createDataFrame([(f"t{i}", X[i].tolist(), int(d) if d >= 0 else None) for i, d in enumerate(DOMAIN)], "sample_token string, x array<double>, domain int")
    log = [(e, k, r, [f"t{i}" for i in ARMS[e][0]] + ["gone"], [f"t{i}" for i in ARMS[e][1]]) for k, (e, r) in enumerate(zip(ARMS, REWARDS, strict=True))]
    log += [("e0", 90, 99.0, ["t1"], ["t2"]), ("small", 91, 0.01, ["t1"], ["t2"]), ("bare", 92, 5.0, ["gone"], ["t2"]), ("null", 93, None, ["t1"], ["t2"])]
    log = spark.createDataFrame(log, "episode_id string, at int, reward double, selector_tokens array<string>, random_tokens array<string>")
    return log, samples


@pytest.fixture(scope="module")
def ready(parts):
    log, samples = parts
    # e0's first row counts; a row with a reward of 0 stays as the least size is 0
    f = feedback.prepared(log.filter("episode_id != 'small'"), feedback.picks_of(log.filter("at < 90 or episode_id != 'e0'")), samples)
    return f


def plain_scores(p, ids):
    w1, b1, w2, b2, bias, residual = p
    z = (X[ids] - 0.1) / 1.3
    h = np.tanh(z @ w1 + b1)
    out = []
    for row, d in zip(h, DOMAIN[ids], strict=True):
        out.append(row @ w2 + b2[0] + (bias[d] + row @ residual[d] if d >= 0 else 0.0))
    return np.array(out), h, z


def plain_step(p, arms, target, lr, l2):
    """One step, sample by sample."""
    w1, b1, w2, b2, bias, residual = p
    grads = [np.zeros_like(q) for q in p]
    gap, slopes = 0.0, [np.zeros_like(q) for q in p]
    for ids, sign in zip(arms, (1, -1), strict=True):
        s, h, z = plain_scores(p, ids)
        gap += sign * s.mean()
        for j, i in enumerate(ids):
            c, d = sign / len(ids), DOMAIN[i]
            back = (w2 + (residual[d] if d >= 0 else 0)) * (1 - h[j] ** 2) * c
            slopes[0] += np.outer(z[j], back)
            slopes[1] += back
            slopes[2] += c * h[j]
            slopes[3] += c
            if d >= 0:
                slopes[4][d] += c
                slopes[5][d] += c * h[j]
    grads = [2 * (gap - target) * s for s in slopes]
    for k in (0, 2, 5):
        grads[k] += l2 * p[k]
    return [q - lr * g for q, g in zip(p, grads, strict=True)], (gap - target) ** 2 + l2 * sum(np.mean(p[k] ** 2) for k in (0, 2, 5))


def plain_train(names, rewards, epochs, lr, l2, seed, clip=2.0):
    m = start()
    p = [q.copy() for q in learning._unpacked(m.flat, D, H, K)]
    sizes = np.abs([r for r in rewards if abs(r) > 1e-12])
    targets = np.clip(np.array(rewards) / np.median(sizes), -clip, clip)
    rng, order, losses = np.random.default_rng(seed), np.arange(len(names)), []
    for _ in range(epochs):
        rng.shuffle(order)
        now = []
        for k in order:
            p, loss = plain_step(p, ARMS[names[k]], targets[k], lr, l2)
            now.append(loss)
        losses.append(np.mean(now))
    return p, losses, targets


def gap(p, name):
    return plain_scores(p, ARMS[name][0])[0].mean() - plain_scores(p, ARMS[name][1])[0].mean()


def test_prepared(parts, ready):
    log, samples = parts
    assert ready.ids == [*ARMS, ] and list(ready.rewards) == REWARDS  # no known sample in an arm, or no reward: gone
    assert ready.n_rows == sum(len(a) + len(b) for a, b in ARMS.values())
    least = feedback.prepared(log, feedback.picks_of(log.filter("at < 90")), samples, min_abs_reward=0.6)
    assert least.ids == ["e0", "e3", "e4", "e5"]
    none = feedback.prepared(log.limit(0), feedback.picks_of(log.limit(0)), samples)
    assert none.ids == []
    with pytest.raises(ValueError, match="no usable"):
        feedback.finetune(start(), none, epochs=1)


@pytest.mark.parametrize("local_bytes", [feedback.LOCAL_BYTES, 0])
def test_finetune_is_plain(ready, local_bytes):
    epochs = 3
    m, history = feedback.finetune(start(), ready, epochs=epochs, lr=0.05, l2=1e-2, seed=5, local_bytes=local_bytes)
    p, losses, targets = plain_train(list(ARMS), REWARDS, epochs, 0.05, 1e-2, 5)
    np.testing.assert_allclose(m.flat, np.concatenate([q.ravel() for q in p]), atol=1e-10)
    assert [h["epoch"] for h in history] == [1, 2, 3]
    np.testing.assert_allclose([h["mean_loss"] for h in history], losses, atol=1e-10)
    gaps = np.array([gap(p, e) for e in ARMS])
    assert history[-1]["feedback_mse"] == pytest.approx(np.mean((gaps - targets) ** 2), abs=1e-10)
    some = np.array(REWARDS) != 0
    assert history[-1]["preference_accuracy"] == pytest.approx((np.sign(gaps) == np.sign(REWARDS))[some].mean())


def test_training_moves_gaps_towards_rewards(ready):
    m0 = start()
    m, history = feedback.finetune(m0, ready, epochs=120, lr=0.02)
    before, after = (feedback.metrics(feedback.gaps_of(x, ready), feedback.target_gaps(ready.rewards, feedback.reward_scale(ready.rewards), 2.0), ready.rewards) for x in (m0, m))
    assert after["feedback_mse"] < before["feedback_mse"] / 2 and after["preference_accuracy"] >= before["preference_accuracy"]
    assert len(history) == 11 and history[-1]["mean_loss"] < history[0]["mean_loss"]


def plain_offsets(names, rewards, targets, penalty, bonus):
    out = {}
    for e, r, t in zip(names, rewards, targets, strict=True):
        if r <= -1e-12:
            for arm, v in ((0, -penalty), (1, bonus)):
                for i in ARMS[e][arm]:
                    out[f"t{i}"] = out.get(f"t{i}", 0.0) + v * abs(t) * 2.0
    return {k: v for k, v in out.items() if abs(v) > 1e-12}


def test_negative_offsets(ready):
    targets = feedback.target_gaps(ready.rewards, feedback.reward_scale(ready.rewards), 2.0)
    got = {r.sample_token: r.v for r in feedback.negative_offsets(ready, targets, 2.0, penalty=0.3, bonus=0.1).collect()}
    want = plain_offsets(list(ARMS), REWARDS, targets, 0.3, 0.1)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    gaps = feedback.offset_gaps(ready, feedback.negative_offsets(ready, targets, 2.0, penalty=0.3, bonus=0.1))
    mean = lambda ids: np.mean([want.get(f"t{i}", 0.0) for i in ids])
    np.testing.assert_allclose(gaps, [mean(a) - mean(b) for a, b in ARMS.values()], atol=1e-12)


@pytest.mark.parametrize("local_bytes", [feedback.LOCAL_BYTES, 0])
def test_leave_one_out_equals_refits(ready, local_bytes):
    epochs = 2
    folds, models = feedback.leave_one_out(start(), ready, epochs=epochs, lr=0.05, l2=1e-3, seed=7, penalty=0.2, bonus=0.1, local_bytes=local_bytes)
    rows = {r.episode_id: r for r in folds.collect()}
    for k, e in enumerate(ARMS):
        names, rewards = [x for x in ARMS if x != e], [r for j, r in enumerate(REWARDS) if j != k]
        p, _, targets = plain_train(names, rewards, epochs, 0.05, 1e-3, 7 + k)
        off = plain_offsets(names, rewards, targets, 0.2, 0.1)
        mean = lambda ids, off=off: np.mean([off.get(f"t{i}", 0.0) for i in ids])
        want = gap(p, e) * 2.0 + mean(ARMS[e][0]) - mean(ARMS[e][1])
        assert rows[e].predicted_gap == pytest.approx(want, abs=1e-9) and rows[e].fold == k
        assert rows[e].signed_margin == pytest.approx(want * np.sign(REWARDS[k]), abs=1e-9)
        np.testing.assert_allclose(models[k].flat, np.concatenate([q.ravel() for q in p]), atol=1e-10)
    s = feedback.loo_summary(folds).first()
    margins = [r.signed_margin for r in rows.values() if r.reward_sign]
    assert (s.fold_count, s.nonzero_reward_fold_count, s.positive_reward_fold_count, s.negative_reward_fold_count) == (6, 5, 3, 2)
    assert s.mean_signed_margin == pytest.approx(np.mean(margins)) and s.median_signed_margin == pytest.approx(np.median(margins))
    assert s.num_wrong_sign == sum(m <= 0 for m in margins) and s.preference_accuracy == pytest.approx(np.mean([m > 0 for m in margins]))


def test_summary_of_no_folds(spark, ready):
    s = feedback.loo_summary(spark.createDataFrame([], "fold int, episode_id string, reward double, reward_sign int, predicted_gap double, signed_margin double, preference_correct boolean")).first()
    assert s.fold_count == 0 and s.preference_accuracy is None and s.mean_signed_margin is None


def test_a_step_is_one_reduction(ready):
    plan = feedback._spread_sums(start(), ready.rows.filter(F.col("number") == 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(number" in plan and plan.count("Exchange") == 1


def test_refits_over_spread_rows_step_together(spark, ready):
    sc, n, epochs = spark.sparkContext, len(ready.ids), 3
    sc.setJobGroup("refits", "refits")
    try:
        feedback.leave_one_out(start(), ready, epochs=epochs, lr=0.05, seed=7, local_bytes=0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("refits"))
    assert 0 < jobs <= 2 * (epochs * (n - 1) + 1) + 4  # at most two a step, not two a step and refit
