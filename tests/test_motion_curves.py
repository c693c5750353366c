"""Motion curves and trajectory matches against a plain numpy version."""

import numpy as np
import pytest

from drovekit.operators import motion

PRED = "sample int, class int, pred_id long, conf double, x double, y double, modes array<array<array<double>>>"
TRUTH = "sample int, class int, truth_id long, x double, y double, path array<array<double>>"


def made(seed, samples=12, most=9):
    rng = np.random.default_rng(seed)
    pred, truth = [], []
    for s in range(samples):
        for c in range(3):
            for k in range(rng.integers(0, most)):
                x, y = rng.uniform(0, 6, 2)
                steps = int(rng.choice([0, 1, 5, 12, 14]))
                truth.append((s, c, k, float(x), float(y), (np.cumsum(rng.normal(0, 0.5, (steps, 2)), axis=0)).tolist()))
            for k in range(rng.integers(0, most) if c < 2 else 0):
                x, y = rng.uniform(0, 6, 2)
                modes = np.cumsum(rng.normal(0, 0.5, (3, 14, 2)), axis=1)
                pred.append((s, c, k, float(rng.choice([rng.random(), 0.5, 0.25])), float(x), float(y), modes.tolist()))
    pred.append((0, 7, 0, 0.5, 0.0, 0.0, [[[0.0, 0.0]]]))  # a class without ground truth
    return pred, truth


def plain(pred, truth, c, limit=2.0):
    mine = sorted((p for p in pred if p[1] == c), key=lambda p: (p[3], p[0], p[2]), reverse=True)
    npos = sum(t[1] == c for t in truth)
    taken, tp, conf, data, hit = set(), [], [], [], 0
    for s, _, _, v, x, y, modes in mine:
        near = [(np.hypot(t[3] - x, t[4] - y), i) for i, t in enumerate(truth) if t[0] == s and t[1] == c and i not in taken]
        d, i = min(near, default=(np.inf, None))
        tp.append(d < limit)
        conf.append(v)
        if d < limit:
            taken.add(i)
            path, m = np.array(truth[i][5]).reshape(-1, 2), np.array(modes)
            e = np.linalg.norm(m[:, : len(path)] - path[None], axis=2) if len(path) else None
            data.append((v, *((0, 0, 0) if e is None else (e.mean(1).min(), e[:, -1].min(), e.max(1).min() > 2))))
            hit += data[-1][2] < 2
    by_path, taken = 0, set()
    for s, _, _, _, x, y, modes in mine:
        near = [(np.hypot(t[3] - x, t[4] - y), i) for i, t in enumerate(truth) if t[0] == s and t[1] == c and i not in taken]
        d, i = min(near, default=(np.inf, None))
        if d < limit and truth[i][5]:
            n = min(12, len(truth[i][5]))
            if np.linalg.norm(np.array(modes)[:, n - 1] - np.array(truth[i][5])[n - 1], axis=1).min() < 2:
                taken.add(i)
                by_path += 1
    if not data or not npos:
        return None, 0.0, 0.0
    fp = len(tp) - sum(tp)
    tps = np.cumsum(tp).astype(float)
    grid = np.linspace(0, 1, 101)
    prec, cf = (np.interp(grid, tps / npos, v, right=0) for v in (tps / np.arange(1, len(tp) + 1), np.array(conf)))
    out = [grid, prec, cf]
    for k in (1, 2, 3):
        mean = np.cumsum([d[k] for d in data]) / np.arange(1, len(data) + 1)
        out.append(np.interp(cf[::-1], np.array([d[0] for d in data])[::-1], mean[::-1])[::-1])
    return np.array(out).T, (hit - 0.5 * fp) / npos, (by_path - 0.5 * fp) / npos


@pytest.mark.parametrize("seed", range(4))
def test_curves_are_plain(spark, seed):
    pred, truth = made(seed)
    p, t = spark.createDataFrame(pred, PRED).repartition(3), spark.createDataFrame(truth, TRUTH)
    matches = motion.matched(p, t)
    got = {}
    for r in motion.curves(matches, t).collect():
        got.setdefault(r["class"], {})[r.point] = tuple(r)[2:]
    epa = {r["class"]: r.epa for r in motion.accuracy(matches, t).collect()}
    epa_ = {r["class"]: r.epa_traj for r in motion.trajectory_accuracy(matches, motion.by_trajectory(p, t), t).collect()}
    for c in range(3):
        want, e, e_ = plain(pred, truth, c)
        assert (c in got) == (want is not None)
        if want is not None:
            np.testing.assert_allclose(np.array([got[c][k] for k in range(101)]), want, atol=1e-9)
        assert epa[c] == pytest.approx(e) and epa_[c] == pytest.approx(e_)
    assert 7 not in got


def test_curves_of_little(spark):
    none = spark.createDataFrame([], PRED), spark.createDataFrame([], TRUTH)
    assert motion.curves(motion.matched(*none), none[1]).collect() == []
    path = [[0.0, 0.0]]
    p = spark.createDataFrame([(0, 0, 1, 0.9, 0.0, 0.0, [path])], PRED)
    t = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, path)], TRUTH)
    rows = motion.curves(motion.matched(p, t), t).collect()
    assert len(rows) == 101 and {tuple(r)[3:] for r in rows} == {(1.0, 0.9, 0.0, 0.0, 0.0)}
