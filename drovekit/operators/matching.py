"""One-to-one matching of predictions and ground truth within a sample and class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups are dealt to frames of about this many rows, at least so many, as a frame a group costs more than the match.
FRAME_ROWS, BUCKETS = 20_000, 64


def _bucket(keys: list[str], rows: int):
    return F.pmod(F.hash(*keys), F.lit(max(BUCKETS, rows // FRAME_ROWS))).alias("_bucket")


def _each(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for key, rows in frame.groupby(keys, sort=False):
        yield key if isinstance(key, tuple) else (key,), rows


def _framed(keys: list[str], columns: list[str], rows: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*keys, *columns]).astype(kinds)


def greedy(pred: DataFrame, truth: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """keys, pred_id, truth_id (null without a match), distance: predictions (keys, pred_id, conf, x, y) in
    order of confidence take the nearest ground truth (keys, truth_id, x, y) that is still free and
    nearer than ``limit``. Ties go to the later prediction and the earlier truth. A prediction with a null
    place has no match, a truth with one is none; an empty side gives no matches. Groups go to frames
    of bounded size by a hash of their keys; both sides are shuffled once."""
    schema = ", ".join(f"{k} {dict(pred.dtypes)[k]}" for k in keys) + ", pred_id long, truth_id long, distance double"

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["conf", "pred_id"], ascending=[False, False])
        t = t.dropna(subset=["truth_id", "x", "y"]).sort_values("truth_id")
        truths = {k: (g["truth_id"].to_numpy(), g["x"].to_numpy(float), g["y"].to_numpy(float)) for k, g in _each(t, keys)}
        free = {k: np.ones(len(v[0]), bool) for k, v in truths.items()}
        out = []
        for *key, i, x, y in p[[*keys, "pred_id", "x", "y"]].itertuples(index=False, name=None):
            key = tuple(key)
            found = None, None
            if key in truths:
                ids, tx, ty = truths[key]
                d = np.where(free[key], np.hypot(tx - x, ty - y), np.inf)
                k = int(d.argmin())
                if d[k] < limit:
                    free[key][k] = False
                    found = int(ids[k]), float(d[k])
            out.append((*key, i, *found))
        return _framed(keys, ["pred_id", "truth_id", "distance"], out, {"truth_id": "Int64", "distance": "float64"})

    # new names for all columns: both sides can come from one table
    pred, truth = (df.select(*(F.col(c).alias(c) for c in (*keys, *own))) for df, own in ((pred, ("pred_id", "conf", "x", "y")), (truth, ("truth_id", "x", "y"))))
    n = pred.count() + truth.count()
    pred, truth = pred.withColumn("_bucket", _bucket(keys, n)), truth.withColumn("_bucket", _bucket(keys, n))
    return pred.groupBy("_bucket").cogroup(truth.groupBy("_bucket")).applyInPandas(match, schema)


def nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pred_id, truth_id, distance of matches among pairs (keys, pred_id, conf, truth_id, distance, ok).

    Predictions in order of confidence (the later one on a tie) look at the nearest ground truth that is still free (the earlier
    one on a tie), and take it if that pair is ok; if it isn't, it stays free and the prediction has none. Pairs with a null don't count."""
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", pred_id long, truth_id long, distance double"

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["conf", "pred_id", "distance", "truth_id"], ascending=[False, False, True, True])
        taken, done, out = set(), set(), []
        for *key, pred, truth, distance, ok in frame[[*keys, "pred_id", "truth_id", "distance", "ok"]].itertuples(index=False, name=None):
            key = tuple(key)
            if (key, pred) in done or (key, truth) in taken:
                continue
            done.add((key, pred))
            if ok:
                taken.add((key, truth))
                out.append((*key, pred, truth, distance))
        return _framed(keys, ["pred_id", "truth_id", "distance"], out, {"pred_id": "int64", "truth_id": "int64", "distance": "float64"})

    pairs = pairs.dropna(subset=["pred_id", "conf", "truth_id", "distance", "ok"])
    return pairs.withColumn("_bucket", _bucket(keys, pairs.count())).groupBy("_bucket").applyInPandas(match, schema)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        slack, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, last = start, -1
        path_rows, path_cols = [start], []
        while True:
            gain = c[i] - row_price[i] - col_price
            better = ~done & (gain < slack)
            slack[better], back[better] = gain[better], last
            j = int(np.where(done, np.inf, slack).argmin())
            step = slack[j]
            row_price[path_rows] += step
            col_price[path_cols] -= step
            slack[~done] -= step
            done[j] = True
            if owner[j] < 0:
                break
            i, last = int(owner[j]), j
            path_rows.append(i)
            path_cols.append(j)
        while j >= 0:
            before = int(back[j])
            owner[j] = owner[before] if before >= 0 else start
            j = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def hungarian(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, cost of the least-cost assignment within each group of pairs (keys, a, b, cost); rows with a null
    are no pairs, and an empty table gives an empty result."""
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", a long, b long, cost double"

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        out, far = [], 1e9
        for key, g in _each(frame, keys):
            ia, a = pd.factorize(g["a"], sort=True)
            ib, b = pd.factorize(g["b"], sort=True)
            full = np.full((len(a), len(b)), far)
            np.minimum.at(full, (ia, ib), g["cost"].to_numpy(float))
            out.extend((*key, int(a[i]), int(b[j]), float(full[i, j])) for i, j in assignment(full) if full[i, j] < far)
        return _framed(keys, ["a", "b", "cost"], out, {"cost": "float64"})

    pairs = pairs.dropna(subset=["a", "b", "cost"])
    return pairs.withColumn("_bucket", _bucket(keys, pairs.count())).groupBy("_bucket").applyInPandas(match, schema)
