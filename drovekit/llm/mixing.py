"""Mixing documents to target weights by soft membership.

A multinomial logistic classifier, trained on the labelled table, gives each document a posterior
over the domains. Document rates r >= least are fitted so that the expected tokens of each domain,
sum(r * tokens * posterior), match their targets: least squares of the differences plus a small
weight on (r - 1)^2, which makes the rates unique, by projected gradient. The gradient of a rate is
its posterior times the differences, so all rates follow from one vector of multipliers: a step
moves it by the differences in the metric of the Gram matrix of the rates that are off the bound, and
the projection is a maximum. A step that doesn't gain is halved. An iteration is one aggregate of a
few sums; no rates are kept.

Everything is DataFrame expressions; sums and a bounded sample of labelled feature rows, on which
the classifier is fitted, reach the driver. A text is read once: its features and counts are a
narrow table that the fit and the result are made from.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small

#: Characters whose counts a word are features, each set of its own.
_COUNTED = ("|", "#$%&*@^~=<>_/\\+", "!?", ".,;:", "\n\t\r")
FEATURES = 14
#: Labelled rows of each domain that the classifier is fitted on, about; taken by a hash of doc_id.
FIT_ROWS = 10_000
RIDGE, LEAN = 1e-3, 1e-9


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator, which the optimiser doesn't copy into what reads them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def with_features(docs: DataFrame) -> DataFrame:
    """docs with _tokens (runs of other characters than ASCII white space) and _x0, ...: what marks the make of
    a text - marks and symbols a word, shares of capitals, digits and other characters, lengths - none over 1 by far."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = once(
        docs,
        _rest=F.regexp_replace(text, r"[A-Za-z\x20]+", ""),
        _upper=F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        _n=F.greatest(F.length(text), F.lit(1)).cast("double"),
        _tokens=F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double"),
    )
    rest, n, words = F.col("_rest"), F.col("_n"), F.greatest(F.col("_tokens"), F.lit(1.0))
    less = lambda chars: F.length(rest) - F.length(F.translate(rest, chars, ""))
    marks = [F.least(less(c) / words, F.lit(1.0)) for c in _COUNTED]
    upper = F.least(3 * F.col("_upper") / n, F.lit(1.0))
    other = F.length(F.translate(rest, "".join(_COUNTED) + "0123456789", "")) / n
    x = [upper, *marks, less("0123456789") / n, other, F.log1p(n) / 10, F.least(n / words, F.lit(40.0)) / 10]
    docs = once(docs, **{f"_x{k}": c for k, c in enumerate(x)}).drop("_rest", "_upper", "_n")
    # a trace of symbols tells much, more of them little
    return docs.select("*", *(F.sqrt(f"_x{k}").alias(f"_x{len(x) + j}") for j, k in enumerate((0, 1, 2, 3))))


@dataclass
class Mixer:
    """A fitted mix: posteriors, rates and copies for any table with features."""

    domains: list[str]
    weights: np.ndarray  # (domains, FEATURES + 1), the constant last
    least: float = 0.0
    multipliers: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    met: bool = True

    def posteriors(self, out: DataFrame) -> DataFrame:
        """A table with features as one with _p0, ... in their place: the posterior of each domain."""
        n = range(len(self.domains))
        z = {f"_z{d}": reduce(lambda a, k, w=w: a + F.lit(float(w[k])) * F.col(f"_x{k}"), range(FEATURES), F.lit(float(w[-1]))) for d, w in enumerate(self.weights)}
        out = once(out, **z).drop(*(f"_x{k}" for k in range(FEATURES)))
        top = F.greatest(*(F.col(f"_z{d}") for d in n)) if len(n) > 1 else F.col("_z0")
        out = once(out, **{f"_e{d}": F.exp(F.greatest(F.col(f"_z{d}") - top, F.lit(-60.0))) for d in n}).drop(*z)
        total = reduce(lambda a, b: a + b, (F.col(f"_e{d}") for d in n))
        return once(out, **{f"_p{d}": F.col(f"_e{d}") / total for d in n}).drop(*(f"_e{d}" for d in n))

    def start(self) -> float:
        return max(1.0, self.least)

    def raw_rate(self, p: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, (F.lit(-float(m)) * c for m, c in zip(self.multipliers, p, strict=True)), F.lit(self.start()))

    def rate(self, p: list[Column]) -> Column:
        """The rate of a posterior: a step from 1, back into the allowed range."""
        return F.greatest(self.raw_rate(p), F.lit(float(self.least)))

    def columns(self, rows: DataFrame) -> DataFrame:
        """A table with _p0, ... and doc_id, with _rate and _copies."""
        out = once(rows, _rate=self.rate([F.col(f"_p{d}") for d in range(len(self.domains))]))
        return out.withColumn("_copies", copies(F.col("_rate"), F.col("doc_id")))


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number whose expectation is the rate, from a fixed hash of doc_id."""
    u = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("mix")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def train(features: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the classifier from labelled (doc_id, domain) and a table of features.

    Of several domains of a doc_id the first in order counts, of several rows the one with the least
    features. About ``fit_rows`` rows of each domain are taken by a hash of doc_id and weighed up to
    all of them. A domain without rows has nearly no posterior; without any rows all are alike.
    """
    one = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("domain").alias("domain"))
    names = [f"_x{k}" for k in range(FEATURES)]
    rows = features.join(small(one), F.col("doc_id") == F.col("_id")).groupBy("_id", "domain").agg(F.min(F.struct(*names)).alias("x"))
    rows = cut(rows, "labelled")
    count = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    out = np.zeros((len(domains), FEATURES + 1))
    found = [d for d in domains if count.get(d)]
    if not found:
        return out
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit("fit")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    taken = reduce(lambda a, d: a | (F.col("domain") == d) & (u < fit_rows / count[d]), found, F.lit(False))
    got = rows.filter(taken).select("domain", "x.*").limit(2 * fit_rows * len(domains)).collect()
    drop(rows)
    x, y = np.array([r[1:] for r in got], float).reshape(-1, FEATURES), np.array([found.index(r[0]) for r in got], int)
    sizes = np.bincount(y, minlength=len(found))
    weight = np.array([count[d] for d in found]) / np.maximum(sizes, 1)
    out[:, -1] = -60.0
    out[[domains.index(d) for d in found]] = logistic(x, y, weight[y], len(found))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rounds: int = 50) -> np.ndarray:
    """Ridge multinomial logistic regression by Newton steps: (classes, features + 1), the constant last."""
    a = np.hstack((x, np.ones((len(x), 1))))
    want = np.eye(classes)[y]
    d = a.shape[1]
    b = np.zeros((classes, d))
    b[:, -1] = np.log(np.maximum(np.bincount(y, weight, classes), 1e-9) / weight.sum())

    def measured(b: np.ndarray) -> tuple[np.ndarray, float]:
        z = a @ b.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p, float(weight @ -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) + RIDGE / 2 * (b * b).sum())

    p, loss = measured(b)
    for _ in range(rounds):
        gradient = ((weight[:, None] * (p - want)).T @ a + RIDGE * b).ravel()
        h = np.empty((classes, d, classes, d))
        for i in range(classes):
            for j in range(classes):
                h[i, :, j, :] = (a * (weight * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
        step = np.linalg.solve(h.reshape(classes * d, -1) + RIDGE * np.eye(classes * d), gradient).reshape(classes, d)
        while True:
            q, after = measured(b - step)
            if after <= loss or np.abs(step).max() < 1e-10:
                break
            step /= 2
        b, p, gain, loss = b - step, q, loss - after, after
        if gain <= 1e-9 * abs(loss):
            break
    return b


def features_of(docs: DataFrame) -> DataFrame:
    """The written table of doc_id, _tokens and features of docs (doc_id, text)."""
    return cut(with_features(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text"), "features")


def fit(features: DataFrame, labelled: DataFrame, targets: dict[str, float], *, least: float = 0.0, rounds: int = 60, tolerance: float = 1e-6, fit_rows: int = FIT_ROWS) -> tuple[Mixer, DataFrame]:
    """Rates >= least for rows of ``features_of`` whose expected domain tokens have the target weights,
    and the table of posteriors (doc_id, _tokens, _p0, ...) that they belong to."""
    domains = sorted(targets)
    mixer = Mixer(domains, train(features, labelled, domains, fit_rows), least)
    vectors = cut(mixer.posteriors(features), "posteriors")
    match(mixer, vectors, targets, rounds=rounds, tolerance=tolerance)
    return mixer, vectors


def match(mixer: Mixer, vectors: DataFrame, targets: dict[str, float], *, rounds: int = 60, tolerance: float = 1e-6) -> None:
    """Fit the mixer's multipliers to a table (_tokens, _p0, ...).

    The total is that of the documents once each; with a positive ``least`` it grows until rates
    above it can meet the targets. Rows without tokens have a rate, but no part in the totals.
    Targets that are missed by more than the tolerance are reported as a warning and in ``met``.
    """
    domains, least = mixer.domains, mixer.least
    weight = np.array([targets[d] for d in domains], float)
    weight /= weight.sum()
    mixer.multipliers = [0.0] * len(domains)
    n = range(len(domains))
    p, t = [F.col(f"_p{k}") for k in n], F.col("_tokens")
    pairs = [(i, j) for i in n for j in n if i <= j]

    def sums(inside: Column, rate: Column, move: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens of the domains, the Gram matrix of the rates inside the range, and the dual value without targets."""
        rows = once(vectors, _in=F.when(inside, t).otherwise(0.0), _r=rate, _v=move)
        value = F.sum(t * ((F.col("_r") - mixer.start()) * (F.col("_r") - mixer.start()) / 2 + F.col("_r") * F.col("_v")))
        r = rows.agg(*(F.sum(F.col("_r") * t * p[k]).alias(f"t{k}") for k in n), *(F.sum(F.col("_in") * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs), value.alias("value")).first()
        gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in n] for i in n])
        return np.array([r[f"t{k}"] or 0.0 for k in n]), gram, r["value"] or 0.0

    now, whole, _ = sums(F.lit(True), F.lit(1.0), F.lit(0.0))
    if not now.sum():
        return
    total = now.sum()
    if least > 0:  # least + posteriors * a, a >= 0, has the target weights from this total on
        inverse = np.linalg.pinv(whole + 1e-12 * np.trace(whole) * np.eye(len(domains)))
        up, per = inverse @ (least * now), inverse @ weight
        total = max(total, *(u / v if v > 0 else 0.0 for u, v in zip(up, per, strict=True)))
    goal, lean = total * weight, LEAN * total
    mixer.targets = goal.tolist()
    last: tuple[np.ndarray, float] | None = None
    for k in range(rounds + 1):
        m = np.array(mixer.multipliers)
        raw = mixer.raw_rate(p)
        found, gram, value = sums(raw >= least, mixer.rate(p), reduce(lambda a, b: a + b, (F.lit(float(x)) * c for x, c in zip(m, p, strict=True))))
        value += -m @ goal - lean * m @ m / 2
        gap = found - goal - lean * m
        if last is not None and value < last[1] - 1e-12 * abs(last[1]) and k < rounds:
            mixer.multipliers = ((m + last[0]) / 2).tolist()
            continue
        mixer.totals = found.tolist()
        if np.abs(gap).max() <= tolerance * total or k == rounds:
            break
        last = m, value
        metric = gram if np.trace(gram) > 1e-9 * np.trace(whole) else whole
        mixer.multipliers = (m + np.linalg.solve(metric + (lean + 1e-12 * np.trace(whole)) * np.eye(len(domains)), gap)).tolist()
    off = (found - goal) / total
    mixer.met = bool(np.abs(off).max() <= tolerance)
    if not mixer.met:
        shares = ", ".join(f"{d} {g:+.4%}" for d, g in zip(domains, off, strict=True))
        warnings.warn(f"mixing misses its targets after {k} rounds, in shares of all tokens: {shares}", stacklevel=2)


def of_quality(labels: DataFrame) -> DataFrame:
    """The labelled table as domains: high or low quality."""
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, least: float = 0.0) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, p_<domain>, rate, copies.

    A null or empty text has no tokens; its rate is that of its posterior. Rows that repeat a doc_id
    get equal copies, those without one share one draw. Other columns aren't read; an empty table
    gives an empty result.
    """
    features = features_of(docs)
    m, vectors = fit(features, labelled, targets, least=least)
    drop(features)
    return m.columns(vectors).select("doc_id", F.col("_tokens").cast("long").alias("n_tokens"), *(F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(m.domains)), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def resampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, least: float = 0.0) -> DataFrame:
    """docs with each row as often as its copies say, its columns as they are.

    Nulls, repeated rows, other columns and empty tables as in ``mixed``; names of docs may be any.
    """
    features = features_of(docs)
    m, vectors = fit(features, labelled, targets, least=least)
    drop(features)
    drop(vectors)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    return m.columns(m.posteriors(with_features(rows).drop("text"))).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
