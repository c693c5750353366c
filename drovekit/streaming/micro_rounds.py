"""The micro-round loop: select, compare with a random selection, learn from the feedback, retire what was used, go on.

All that a run has done is in its state, a document of paths and numbers. States are numbered, and each number is written
once, whole, or not at all: a writer that isn't the latest any more can't write the next one. Tables are written
under new names before the state that names them, so a round that breaks off anywhere leaves nothing of it in the log, and
is done again from the same state with the same result.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feedback, selection
from ..operators.learning import Mlp


class Conflict(RuntimeError):
    """Another writer has gone on with the run."""


class StateLog:
    """Numbered JSON documents in a folder that every writer sees; a number is taken by one writer only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.conf, self.fs = conf, self._path(self.folder).getFileSystem(conf)
        self.fs.mkdirs(self._path(self.folder))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:010d}.json"

    def latest(self) -> tuple[int, dict | None]:
        """The last number and its document; -1 and None before the first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        versions = [int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit()]
        if not versions:
            return -1, None
        return max(versions), json.loads(self.spark.read.text(self._name(max(versions)), wholetext=True).first()[0])

    def put(self, version: int, doc: dict) -> None:
        """Take a number, or raise Conflict if it's taken: the document is written beside, then given its name if nothing has it."""
        beside = f"{self.folder}/.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(beside), False)
        out.write(bytearray(json.dumps(doc, sort_keys=True).encode()))
        out.close()
        try:
            self._named(beside, self._name(version))
        finally:
            self.fs.delete(self._path(beside), False)

    def _named(self, beside: str, name: str) -> None:
        if self.fs.getUri().getScheme() == "file":  # a hard link fails where the name is taken; a local rename would replace it
            try:
                os.link(*(urlparse(p).path if "://" in p or p.startswith("file:") else p for p in (beside, name)))
            except FileExistsError as e:
                raise Conflict(name) from e
            return
        never = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = never
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(beside), self._path(name), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise


@dataclass(frozen=True)
class Plan:
    """How a run selects and learns; round r uses the seeds plus r - 1."""

    rounds: int = 1
    count: int = 323
    temperature: float = 0.15
    sample_seed: int = 4100
    random_seed: int = 5100
    selector_seed: int = 6100
    epochs: int = 40
    lr: float = 0.01
    l2: float = 1e-4
    scale: float | None = None
    clip: float = 2.0
    min_abs_reward: float = 0.0
    penalty: float = 0.0
    bonus: float = 0.0
    reward_max: float = -1e-12
    disjoint: bool = True
    retire_random: bool = True
    replay_penalty: float = 0.0

    def __post_init__(self):
        if self.rounds < 1 or self.count < 1 or self.temperature <= 0:
            raise ValueError("rounds, count and temperature must be positive")


def gumbel(token: Column, seed: int) -> Column:
    """A Gumbel variate of a token, by a hash of it and the seed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), token.cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(F.least(F.greatest(u, F.lit(1e-8)), F.lit(1 - 1e-8))))


class MicroRounds:
    """A run over samples (sample_token, domain_id, x, domain) of the pool, from a first model.

    Use it as a context: it claims the run (another claim raises RuntimeError unless ``force`` says that its holder is
    gone) and releases it at the end, also after an error. A holder that lost the run can't write any more.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str, samples: DataFrame, model: Mlp, plan: Plan, *, replay: DataFrame | None = None, force: bool = False):
        self.spark, self.folder, self.run_id, self.samples, self.plan, self.replay, self.force = spark, folder.rstrip("/"), run_id, samples, plan, replay, force
        self.first, self.log, self.me = model, StateLog(spark, f"{self.folder}/state"), uuid.uuid4().hex
        self.version, self.state = -1, {}

    def __enter__(self) -> MicroRounds:
        version, state = self.log.latest()
        if state is None:
            state = {"run_id": self.run_id, "completed": 0, "status": "running", "model": self._store(self.first), "offsets": None, "used": [], "episodes": [], "prepared": None, "rounds": [], "plan": asdict(self.plan)}
        elif state["run_id"] != self.run_id:
            raise ValueError(f"the folder has the run {state['run_id']}")
        elif state["writer"] is not None and not self.force:
            raise RuntimeError(f"another writer holds the run {self.run_id}")
        self.version, self.state = version, state
        try:
            self._commit(writer=self.me)
        except Conflict as e:
            raise RuntimeError(f"another writer holds the run {self.run_id}") from e
        return self

    def __exit__(self, *_: object) -> None:
        try:
            self._commit(writer=None)
        except Conflict:
            pass  # another writer has taken over

    def _commit(self, **changes: object) -> None:
        new = {**self.state, **changes}
        self.log.put(self.version + 1, new)
        self.version, self.state = self.version + 1, new

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.parquet(path := f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return path

    def _store(self, m: Mlp) -> str:
        row = (m.flat.tolist(), m.hidden, m.domains, m.x_mean.tolist(), m.x_std.tolist(), float(m.y_mean), float(m.y_std))
        return self._write(self.spark.createDataFrame([row], "flat array<double>, hidden int, domains int, x_mean array<double>, x_std array<double>, y_mean double, y_std double"), "model")

    @property
    def model(self) -> Mlp:
        r = self.spark.read.parquet(self.state["model"]).first()
        return Mlp(np.array(r["flat"]), r["hidden"], r["domains"], np.array(r["x_mean"]), np.array(r["x_std"]), r["y_mean"], r["y_std"])

    def _tables(self, paths: list[str], ddl: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.schema(ddl).parquet(p) for p in paths)) if paths else self.spark.createDataFrame([], ddl)

    @property
    def token(self) -> str:
        return self.samples.schema["sample_token"].dataType.simpleString()

    def used(self) -> DataFrame:
        """(sample_token, round, arm) of what is retired."""
        return self._tables(self.state["used"], f"sample_token {self.token}, round int, arm string")

    def episodes(self) -> DataFrame:
        """(episode_id, at, reward) of the rounds that have feedback, and what they compared: see ``picks``."""
        return self._tables([e["episode"] for e in self.state["episodes"]], "episode_id string, at int, reward double")

    def picks(self) -> DataFrame:
        return self._tables([e["picks"] for e in self.state["episodes"]], f"episode_id string, arm string, sample_token {self.token}")

    def prepare(self) -> dict:
        """Select the next round's samples, if none waits for feedback and there is a round to come; the state."""
        s = self.state
        if s["prepared"] is not None or s["completed"] >= self.plan.rounds:
            return s
        k = s["completed"] + 1
        used = self.used().select("sample_token").distinct()
        pool = self.samples.join(used, "sample_token", "left_anti")
        offsets = self.spark.read.parquet(s["offsets"]) if s["offsets"] else None
        scores = self.model.scores(pool.select("sample_token", "x", F.coalesce("domain", F.lit(-1)).alias("domain")), offsets)
        noisy = F.col("score") + self.plan.temperature * gumbel(F.col("sample_token"), self.plan.sample_seed + k - 1)
        rows = pool.select("sample_token", "domain_id").join(scores, "sample_token")
        if self.replay is not None and self.plan.replay_penalty > 0:
            rows = rows.join(self.replay.select("sample_token", F.lit(self.plan.replay_penalty).alias("lost")).distinct(), "sample_token", "left")
            noisy = noisy - F.coalesce("lost", F.lit(0.0))
        path = self._write(rows.select("sample_token", "domain_id", noisy.alias("noisy"), F.lit("train").alias("split")), "scored")
        rows = self.spark.read.parquet(path)
        budget = self.plan.count if self.plan.count > 1 else 1e-12  # a budget of 1 is all
        arm = lambda score, seed, gone: selection.select(rows, "domain_stratified", score, budget, exclude=gone, seed=seed)
        one = lambda df, name: df.select("sample_token", F.lit(k).alias("round"), F.lit(name).alias("arm"))
        mine = self._write(one(arm(lambda m, seed: F.col("noisy"), 0, None), "selector"), "selector")
        taken = self.spark.read.parquet(mine)
        other = self._write(one(arm("random", self.plan.random_seed + k - 1, taken if self.plan.disjoint else None), "random"), "random")
        counts = [self.spark.read.parquet(p).count() for p in (mine, other)]
        if not all(counts):
            self._commit(status="exhausted")
        else:
            self._commit(status="prepared_round_needs_feedback", prepared={"round": k, "selector": mine, "random": other, "selector_count": counts[0], "random_count": counts[1]})
        return self.state

    def feed(self, costs: DataFrame | None = None, batch: int | str = 0) -> dict:
        """Take feedback (round, selector_cost, random_cost) and do all rounds that have some; the state.

        Feedback is kept by ``batch``, so that a batch may come again, and feedback of a later round waits. Of several rows
        of a round the least counts; rows with a null are left out. Each round's reward is the random cost less the selector's.
        """
        inbox = f"{self.folder}/inbox"
        if costs is not None:
            costs.select(F.col("round").cast("int").alias("round"), F.col("selector_cost").cast("double").alias("selector_cost"), F.col("random_cost").cast("double").alias("random_cost")).dropna().write.mode("overwrite").parquet(f"{inbox}/batch={batch}")
        while True:
            s = self.prepare()
            if s["prepared"] is None or not self.log.fs.exists(self.log._path(inbox)):
                return self.state
            k = s["prepared"]["round"]
            got = self.spark.read.schema("round int, selector_cost double, random_cost double, batch string").parquet(inbox).filter(F.col("round") == k).agg(F.min(F.struct("selector_cost", "random_cost")).alias("c")).first()["c"]
            if got is None:
                return self.state
            self._finish(k, got["random_cost"] - got["selector_cost"])

    def _finish(self, k: int, reward: float) -> None:
        """One round's episode, update and retirement, and then the state that has them."""
        s, p, name = self.state, self.plan, f"{self.run_id}_r{k:02d}"
        arms = [self.spark.read.parquet(s["prepared"][a]) for a in ("selector", "random")]
        picks = arms[0].unionByName(arms[1]).select(F.lit(name).alias("episode_id"), "arm", "sample_token")
        episode = {"round": k, "episode": self._write(self.spark.createDataFrame([(name, k, float(reward))], "episode_id string, at int, reward double"), "episode"), "picks": self._write(picks, "picks")}
        was, self.state = self.state, {**s, "episodes": [*s["episodes"], episode]}  # seen by episodes() and picks(), not yet written
        try:
            known = feedback.prepared(self.episodes(), self.picks(), self.samples, min_abs_reward=p.min_abs_reward)
            model, offsets = s["model"], s["offsets"]
            if known.ids:
                before = self.model
                after, _ = feedback.finetune(before, known, epochs=p.epochs, lr=p.lr, l2=p.l2, scale=p.scale, clip=p.clip, seed=p.selector_seed + k - 1)
                model = self._store(after)
                if p.penalty > 0 or p.bonus > 0:
                    targets = feedback.target_gaps(known.rewards, feedback.reward_scale(known.rewards, p.scale), p.clip)
                    offsets = self._write(feedback.negative_offsets(known, targets, before.y_std, penalty=p.penalty, bonus=p.bonus, reward_max=p.reward_max), "offsets")
        finally:
            self.state = was
        used = [*s["used"], s["prepared"]["selector"], *([s["prepared"]["random"]] if p.retire_random else [])]
        record = {**s["prepared"], "episode_id": name, "reward": float(reward), "status": "updated", "model": model}
        self._commit(completed=k, status="complete" if k >= p.rounds else "running", model=model, offsets=offsets, used=used, episodes=[*s["episodes"], episode], prepared=None, rounds=[*s["rounds"], record])

    def run(self, provider: Callable[[int, DataFrame, DataFrame], tuple[float, float]]) -> dict:
        """All rounds, with a provider of costs: (round, selector's tokens, random tokens) -> (selector's cost, random cost)."""
        while (s := self.prepare())["prepared"] is not None:
            at = s["prepared"]
            mine, other = provider(at["round"], *(self.spark.read.parquet(at[a]).select("sample_token") for a in ("selector", "random")))
            self._finish(at["round"], float(other) - float(mine))
        return self.state

    def follow(self, costs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start a query that feeds a stream of costs, each batch as it comes, and ends when there is no more for now."""
        return costs.writeStream.foreachBatch(lambda b, n: self.feed(b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
