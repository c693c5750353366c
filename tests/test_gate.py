"""The candidate gate against a plain Python version of it."""

import hashlib

import numpy as np
import pytest

from drovekit.operators import gate, learning

RNG = np.random.default_rng(4)
TOKENS = [f"t{i}" for i in range(40)]
FOLDS = 5
SCORES = {t: RNG.normal(0, 1, FOLDS) for t in TOKENS[:36]}  # the last ones are unknown
EPISODES = {"e0": 1.0, "e1": -2.0, "e2": 0.0, "e3": 3.0, "e4": -1.0}
PAST = {(e, a): list(RNG.choice(TOKENS, 5)) for e in EPISODES for a in ("selector", "random")}
CANDIDATES = [("h0", 3, 7, 0.0, "p0"), ("h1", 1, 8, 0.5, "p1"), ("h0", 2, 9, 0.1, "p2"), ("h2", 5, 1, 0.0, "p3"), ("h3", None, 1, 0.0, "p4"), ("h4", 4, 2, 0.0, "p5"), ("h0", 9, 9, 0.1, "p6")]
PICKED = {"h0": ["t0", "t0", "t1", "t2"], "h1": list(RNG.choice(TOKENS, 6)), "h2": ["t38", "t39"], "h3": [t for (e, a), ts in PAST.items() if e == "e1" and a == "selector" for t in ts], "h4": sorted(SCORES, key=lambda t: -SCORES[t].mean())[:6], "other": ["t1"]}


@pytest.fixture(scope="module")
def parts(spark):
    rows = lambda d, ddl: spark.createDataFrame(d, ddl)
    return (
        rows(CANDIDATES, "selection_hash string, rank int, seed int, replay_penalty double, path string"),
        rows([(h, t) for h, ts in PICKED.items() for t in ts], "selection_hash string, sample_token string"),
        rows(list(EPISODES.items()), "episode_id string, reward double"),
        rows([(e, a, str(t)) for (e, a), ts in PAST.items() for t in ts], "episode_id string, arm string, sample_token string"),
        rows([(t, s.tolist()) for t, s in SCORES.items()], "sample_token string, scores array<double>"),
    )


def plain(**how):
    kept = {}
    for h, rank, *_ in sorted(CANDIDATES, key=lambda c: 10**9 if c[1] is None else c[1]):
        kept.setdefault(h, rank)
    mean = lambda ts, f: np.mean([SCORES[t][f] for t in ts if t in SCORES]) if any(t in SCORES for t in ts) else 0.0
    sel = {e: PAST[e, "selector"] for e in EPISODES}
    bad, good = ({t for e, r in EPISODES.items() if s * r > 0 for t in sel[e]} for s in (-1, 1))
    out = []
    for h, rank in kept.items():
        scores = np.array([mean(PICKED[h], f) for f in range(FOLDS)])
        over = lambda es, arm: scores - [np.mean([mean(PAST[e, arm], f) for e in es]) for f in range(FOLDS)]  # noqa: E731, B023
        random, positive, negative = over(EPISODES, "random"), over([e for e, r in EPISODES.items() if r > 0], "selector"), over([e for e, r in EPISODES.items() if r < 0], "selector")
        n, boot = how.get("bootstrap_samples", 0), None
        if n:
            pick = lambda b, j: int(hashlib.md5(f"{how['bootstrap_seed']}:{rank or 0}:{b}:{j}".encode()).hexdigest()[:8], 16) % FOLDS  # noqa: E731, B023
            m = np.array([np.mean([random[pick(b, j)] for j in range(FOLDS)]) for b in range(n)])
            boot = (m.mean(), m.std(), np.quantile(m, 0.1), np.quantile(m, 0.5), np.quantile(m, 0.9), np.mean(m >= how["min_random_margin"]))
        overlap = len(set(PICKED[h]) & bad)
        gates = (overlap <= how["max_negative_overlap"], random.mean() >= how["min_random_margin"], positive.mean() >= how["min_positive_margin"], scores.std() <= how["max_fold_std"], boot is None or boot[5] >= how["min_bootstrap_pass_rate"])
        out.append((h, rank, len(PICKED[h]), overlap, len(set(PICKED[h]) & good), scores, random, positive.mean(), negative.mean(), boot, gates))
    order = lambda c: (not all(c[10]), -(c[9][2] if c[9] else 0), -c[6].mean(), c[3], -c[5].mean(), 10**9 if c[1] is None else c[1])
    return sorted(out, key=order)


@pytest.mark.parametrize("samples", [0, 200])
@pytest.mark.parametrize("overlap", [0, 2])
def test_gate_is_plain(parts, samples, overlap):
    how = {"max_negative_overlap": overlap, "min_random_margin": 0.05, "min_positive_margin": -0.3, "max_fold_std": 0.6, "bootstrap_seed": 5, "bootstrap_samples": samples, "min_bootstrap_pass_rate": 0.6 if samples else None}
    got = gate.gated(*parts, bootstrap_quantile=0.1, **how)
    want, rows = plain(**how), got.orderBy("gate_rank").collect()
    assert [r.gate_rank for r in rows] == list(range(1, 6)) and [r.selection_hash for r in rows] == [w[0] for w in want]
    for r, w in zip(rows, want, strict=True):
        assert (r["rank"], r.selected_count, r.negative_overlap, r.positive_overlap) == w[1:5]
        np.testing.assert_allclose(r.fold_scores, w[5], atol=1e-12)
        np.testing.assert_allclose(r.random_margins, w[6], atol=1e-12)
        values = [r.fold_score_mean, r.fold_score_std, r.fold_score_min, r.fold_score_max, r.candidate_minus_random_mean, r.candidate_minus_random_min, r.candidate_minus_positive_mean, r.candidate_minus_negative_mean]
        np.testing.assert_allclose(values, [w[5].mean(), w[5].std(), w[5].min(), w[5].max(), w[6].mean(), w[6].min(), w[7], w[8]], atol=1e-12)
        assert (r.bootstrap is None) == (w[9] is None)
        if samples:
            np.testing.assert_allclose(tuple(r.bootstrap), w[9], atol=1e-12)
        assert tuple(r.gates) == w[10] and r.verdict == ("pass" if all(w[10]) else "reject")
        assert r.reasons == [g for g, ok in zip(gate.GATES, w[10], strict=True) if not ok]
    s = gate.summary(got).first()
    assert (s.candidate_count, s.pass_count, s.best_hash) == (5, sum(all(w[10]) for w in want), want[0][0])
    assert any(all(w[10]) for w in want) or overlap == 0 or samples


def test_aliases(parts):
    rows = {r.selection_hash: r for r in gate.deduplicated(parts[0]).collect()}
    assert rows["h0"]["rank"] == 2 and [(a["rank"], a.path) for a in rows["h0"].aliases] == [(3, "p0"), (9, "p6")]
    assert [r.selection_hash for r in gate.deduplicated(parts[0], 2).orderBy("rank").collect()] == ["h1", "h0"]


def test_without_a_past(parts):
    none = [p.limit(0) for p in parts[2:4]]
    rows = gate.gated(*parts[:2], *none, parts[4], min_positive_margin=0.0).collect()
    assert {r.candidate_minus_positive_mean for r in rows} == {None} and all("positive_margin" in r.reasons for r in rows)
    assert gate.gated(parts[0].limit(0), *parts[1:]).collect() == []
    with pytest.raises(ValueError, match="fold"):
        gate.gated(*parts[:4], parts[4].limit(0))
    with pytest.raises(ValueError, match="bootstrap"):
        gate.gated(*parts, min_bootstrap_pass_rate=0.5)


def test_fold_scores(spark):
    rng = np.random.default_rng(0)
    models = [learning.Mlp(rng.normal(0, 1, 3 * 2 + 2 + 2 + 1 + 2 + 2 * 2), 2, 2, np.zeros(3), np.ones(3), 1.0, 2.0) for _ in range(3)]
    x, domain = rng.normal(0, 1, (9, 3)), np.arange(9) % 3 - 1
    got = {r.sample_token: r.scores for r in gate.fold_scores(spark.createDataFrame([(i, x[i].tolist(), int(d)) for i, d in enumerate(domain)], "sample_token int, x array<double>, domain int"), models).collect()}
    for k, m in enumerate(models):
        np.testing.assert_allclose([got[i][k] for i in range(9)], learning._forward(m.flat, x, domain, 2, 2)[0] * 2 + 1)
