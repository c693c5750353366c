"""The micro-round loop: exactly-once rounds over crashes, retired tokens, one writer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovekit.operators import learning
from drovekit.streaming import micro_rounds
from drovekit.streaming.micro_rounds import Conflict, MicroRounds, Plan, StateLog

PLAN = Plan(rounds=3, count=10, epochs=3, penalty=0.1, bonus=0.05)
COSTS = {1: (1.0, 2.0), 2: (3.0, 1.0), 3: (0.5, 0.75)}


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i:03d}", int(i % 3), rng.normal(0, 1, 2).tolist(), int(i % 3)) for i in range(80)]
    return spark.createDataFrame(rows, "sample_token string, domain_id int, x array<double>, domain int")


def model():
    return learning.Mlp(np.random.default_rng(1).normal(0, 0.5, 2 * 3 + 3 + 3 + 1 + 3 + 9), 3, 3, np.zeros(2), np.ones(2), 0.0, 1.0)


def loop(spark, folder, samples, **how):
    return MicroRounds(spark, str(folder), "run", samples, model(), how.pop("plan", PLAN), **how)


def outcome(r):
    used = sorted(tuple(x) for x in r.used().collect())
    return r.state["completed"], r.state["status"], sorted(tuple(x) for x in r.episodes().collect()), used, r.model.flat.round(9).tolist()


@pytest.fixture(scope="module")
def whole(spark, samples, tmp_path_factory):
    with loop(spark, tmp_path_factory.mktemp("whole"), samples) as r:
        r.run(lambda k, a, b: COSTS[k])
        return outcome(r)


def test_rounds_retire_and_learn(spark, samples, whole):
    completed, status, episodes, used, flat = whole
    assert (completed, status) == (3, "complete")
    assert episodes == [("run_r01", 1, 1.0), ("run_r02", 2, -2.0), ("run_r03", 3, 0.25)]
    tokens = [t for t, _, _ in used]
    assert len(tokens) == len(set(tokens)) == 60  # both arms of a round are disjoint and leave the pool
    assert sorted((r, a) for _, r, a in used) == sorted((r, a) for r in (1, 2, 3) for a in ("selector", "random") for _ in range(10))
    assert not np.allclose(flat, model().flat)


def feeds(spark, folder, rounds):
    spark.createDataFrame([(k, *map(float, COSTS[k])) for k in rounds], "round int, selector_cost double, random_cost double").coalesce(1).write.mode("append").json(str(folder))


def stream(spark, folder):
    return spark.readStream.schema("round int, selector_cost double, random_cost double").option("maxFilesPerTrigger", 1).json(str(folder))


def test_a_stream_of_feedback_out_of_order(spark, samples, whole, tmp_path):
    feeds(spark, tmp_path / "in", [2])
    with loop(spark, tmp_path / "run", samples) as r:
        r.follow(stream(spark, tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
        assert r.state["status"] == "prepared_round_needs_feedback" and r.state["prepared"]["round"] == 1
        feeds(spark, tmp_path / "in", [3])
        feeds(spark, tmp_path / "in", [1, 2])
        r.follow(stream(spark, tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
        assert outcome(r) == whole


@pytest.mark.parametrize("lost", [2, 3, 6])
def test_a_crash_before_a_state_changes_nothing(spark, samples, whole, tmp_path, monkeypatch, lost):
    """The process ends after the tables of a round are written, before its state is, and its holder's claim stays."""
    feeds(spark, tmp_path / "in", [1, 2, 3])
    put = StateLog.put

    def fails(self, version, doc):
        if version >= lost:
            raise OSError("lost")
        put(self, version, doc)

    monkeypatch.setattr(StateLog, "put", fails)
    first = loop(spark, tmp_path / "run", samples)
    first.__enter__()
    with pytest.raises(Exception, match="lost"):
        first.follow(stream(spark, tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    monkeypatch.setattr(StateLog, "put", put)
    with pytest.raises(RuntimeError, match="another writer"):
        loop(spark, tmp_path / "run", samples).__enter__()
    with loop(spark, tmp_path / "run", samples, force=True) as r:
        r.follow(stream(spark, tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
        assert outcome(r) == whole
        with pytest.raises(Conflict):
            first.prepare() if first.state["prepared"] is None and first.state["completed"] < 3 else first._commit(status="late")


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    log = StateLog(spark, f"file://{tmp_path}/log")
    assert log.latest() == (-1, None)
    log.put(0, {"a": 1})
    with pytest.raises(Conflict):
        log.put(0, {"a": 2})
    assert log.latest() == (0, {"a": 1})

    class Other:  # as for a store that isn't local: a rename that doesn't replace
        getScheme = staticmethod(lambda: "other")  # noqa: N815

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

    fs = Fs(log.fs)
    real = log.fs.getUri()
    seen = iter([Other, real, Other, real])
    fs.getUri = lambda: next(seen)
    log.fs = fs
    log.put(1, {"a": 3})
    assert log.latest() == (1, {"a": 3})
    with pytest.raises(Conflict):
        log.put(1, {"a": 4})
    assert log.latest() == (1, {"a": 3})


def test_pool_runs_out_and_odd_plans(spark, samples, tmp_path):
    with loop(spark, tmp_path / "few", samples.limit(15), plan=Plan(rounds=5, count=6, epochs=1)) as r:
        s = r.run(lambda k, a, b: (1.0, 1.0))
        assert s["status"] == "exhausted" and s["completed"] == 1  # the second round has no sample left for the second arm
        assert r.used().count() == 12
    with loop(spark, tmp_path / "kept", samples, plan=Plan(rounds=2, count=1, epochs=1, disjoint=False, retire_random=False, replay_penalty=100.0), replay=samples.limit(40)) as r:
        r.run(lambda k, a, b: (a.count(), 2 * b.count()))
        taken = [t for t, _, a in (tuple(x) for x in r.used().collect())]
        assert len(taken) == 2 and not {r.sample_token for r in samples.limit(40).collect()} & set(taken)
    with pytest.raises(ValueError, match="positive"):
        Plan(rounds=0)
    with pytest.raises(ValueError, match="has the run"):
        MicroRounds(spark, str(tmp_path / "few"), "else", samples, model(), PLAN).__enter__()


def test_gumbel_is_a_gumbel(spark):
    g = spark.range(20_000).select(micro_rounds.gumbel(F.col("id"), 3).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert g[0] == pytest.approx(0.5772, abs=0.03) and g[1] == pytest.approx(np.pi / np.sqrt(6), abs=0.03)
