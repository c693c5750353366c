"""Readers, writers, features, selections, learners, motion metrics and keyed state on small inputs."""

import io
import json
import math
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drovekit import sinks
from drovekit.functions import features
from drovekit.operators import learning, motion, selection
from drovekit.sources import files, tables
from drovekit.streaming import instances, rounds


def lines(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")
    return str(path)


def test_manifest_has_defaults_and_one_row_a_token(spark, tmp_path):
    a = lines(tmp_path / "m.jsonl", [{"sample_token": "a", "split": "train"}, "", {"sample_token": "b", "metadata": {"x": {"y": 3}}}])
    got = tables.read_manifest(spark, a).withColumn("label", tables.resolved(tables.read_manifest(spark, a), "metadata.x.y"))
    assert [(r.sample_token, json.loads(r.metadata), r.label) for r in got.orderBy("sample_token").collect()] == [("a", {}, "default"), ("b", {"x": {"y": 3}}, "3")]
    with pytest.raises(ValueError, match="isn't unique"):
        tables.read_manifest(spark, lines(tmp_path / "n.jsonl", [{"sample_token": "a"}] * 2))


def test_labels(spark, tmp_path):
    a = lines(tmp_path / "l.jsonl", [{"sample_token": "a", "domain_label": "x"}, {"sample_token": "b", "cluster_id": 4}, {"domain_label": "z"}, {"sample_token": "c"}, {"sample_token": "a", "domain_label": "y"}])
    assert dict(map(tuple, tables.read_labels(spark, a).collect())) == {"a": "y", "b": "4"}
    for k, doc in enumerate([{"a": "x", "b": "y"}, {"a": {"domain_label": "x"}, "b": {"domain_label": "y"}, "c": {}}, [{"sample_token": "a", "domain_label": "w"}, {"sample_token": "a", "domain_label": "x"}, {"sample_token": "b", "domain_label": "y"}]]):
        path = lines(tmp_path / f"d{k}.json", [json.dumps(doc, indent=1)])
        assert dict(map(tuple, tables.read_label_sidecar(spark, path).select("sample_token", "label").collect())) == {"a": "x", "b": "y"}
    rows = spark.createDataFrame([("a",), ("q",)], "sample_token string")
    assert {r.sample_token: r.label for r in tables.labelled(rows, tables.read_labels(spark, a)).collect()} == {"a": "y", "q": "default"}


def test_tokens_selections_targets_and_submissions(spark, tmp_path):
    assert [r[0] for r in tables.read_tokens(spark, lines(tmp_path / "t.txt", ["a", "", " b "])).collect()] == ["a", "b"]
    (tmp_path / "s").mkdir()
    for k in (2, 1):
        lines(tmp_path / "s" / f"{k}.json", [json.dumps({"baseline": f"b{k}", "selected_tokens": ["x"], "domain_counts": {"0": 1}}, indent=1)])
    assert [(r.file, r.baseline) for r in tables.read_selections(spark, str(tmp_path / "s")).collect()] == [("1.json", "b1"), ("2.json", "b2")]
    t = lines(tmp_path / "t.jsonl", [{"sample_token": "a", "heuristic_name": "h"}, {"sample_token": "b", "domain_label": "d"}, {"sample_token": "c"}])
    assert [r.domain_label for r in tables.read_targets(spark, t).orderBy("sample_token").collect()] == ["h", "d", "default"]
    sub = lines(tmp_path / "sub.json", [json.dumps({"results": {"k": {"vectors": [[[0, 1], [2, 3]], [[4, 5]]], "scores": [0.5, 0.25], "labels": [1, 2]}}})])
    got = tables.read_submission(spark, sub)
    assert [(r.token, r.place, len(r.vector), r.score, r.label) for r in got.orderBy("place").collect()] == [("k", 0, 2, 0.5, 1), ("k", 1, 1, 0.25, 2)]
    assert sinks.map_submission(got).first().vectors == [[[0.0, 1.0], [2.0, 3.0]]]
    with pytest.raises(ValueError, match="schema"):
        tables.read_config(lines(tmp_path / "c.json", [{"schema": "other"}]), "mine")


def test_raw_tables_and_links(spark, tmp_path):
    data = [{"token": f"d{k}", "sample_token": f"s{k // 2}", "filename": ("samples/" if k % 2 else "sweeps/") + str(k), "is_key_frame": False, "prev": f"d{k - 1}" if k else ""} for k in range(6)]
    for n, rows in {"scene": [], "log": [], "sample": [{"token": "s0", "scene_token": "x", "timestamp": 1, "data": {"cam": "d4"}}], "sample_data": data}.items():
        lines(tmp_path / f"{n}.json", [json.dumps(rows)])
    raw = tables.read_raw_tables(spark, str(tmp_path))
    assert {tuple(r) for r in tables.required_files(raw).collect()} == {("s0", "samples/1"), ("s0", "sweeps/4")}
    start = spark.createDataFrame([("d3",), ("d1",)], "token string")
    assert {(r.start, r.hop, r.token) for r in tables.sweeps(raw["sample_data"], start, 3).collect()} == {("d3", 1, "d2"), ("d3", 2, "d1"), ("d3", 3, "d0"), ("d1", 1, "d0")}


def test_features_points_and_archives(spark, tmp_path):
    f = tmp_path / "f"
    f.mkdir()
    np.savez_compressed(f / "a.npz", traj_raw=np.arange(6.0).reshape(3, 2), scene_hidden=np.ones(4), interaction_hidden=np.ones(4), teacher_loss=0.5)
    manifest = spark.createDataFrame([("a", 2, 0.25, 0.125)], "sample_token string, domain_id int, teacher_loss double, teacher_uncertainty double")
    r = files.with_features(manifest, files.read_features(spark, str(f))).first()
    assert (r.domain_id, r.teacher_loss, r.teacher_uncertainty, r.traj_raw[2], r.traj_hidden) == (2, 0.5, 0.125, [4.0, 5.0], None)
    with pytest.raises(FileNotFoundError):
        files.with_features(manifest.withColumn("sample_token", F.lit("z")), files.read_features(spark, str(f)))
    np.savez(f / "b.npz", scene_hidden=np.array([np.nan]))
    with pytest.raises(Exception, match="finite"):
        files.read_features(spark, str(f)).collect()
    (tmp_path / "p").mkdir()
    np.arange(10, dtype="<f4").tofile(tmp_path / "p" / "x.bin")
    assert files.read_points(spark, str(tmp_path / "p"), 5, [0, 2]).first().points == [[0.0, 2.0], [5.0, 7.0]]
    a = tmp_path / "a"
    a.mkdir()
    with zipfile.ZipFile(a / "1.zip", "w") as z:
        z.writestr("samples/x", b"12")
    with tarfile.open(a / "2.tgz", "w:gz") as t:
        for name, body in (("samples/x", b"1"), ("v/scene.json", b'[{"token": "s"}, {"token": "t"}]'), ("other/scene.json", b"[{}]")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    index = files.archive_index(spark, str(a))
    assert index.count() == 4
    found, gone = files.locate(index, spark.createDataFrame([("samples/x",), ("nope",)], "member string"))
    assert [(r.member, r.archive.rsplit("/", 1)[1]) for r in found.collect()] == [("samples/x", "1.zip")] and gone.first().member == "nope"
    assert sorted(r.row for r in files.archived_tables(spark, str(a), "v", ["scene"]).collect()) == ['{"token": "s"}', '{"token": "t"}']
    with pytest.raises(ValueError, match="lacks"):
        files.archived_tables(spark, str(a), "v", ["scene", "log"])
    for name in ("../x", "/x", "a/../../x"):
        with pytest.raises(ValueError, match="unsafe"):
            sinks.safe_member(name)


def test_logs_and_infos(spark, tmp_path):
    t = lines(tmp_path / "t.log.json", ["text", {"mode": "train", "loss": 2}, {"mode": "val", "loss": 9}, {"mode": "train", "loss": "x"}, {"mode": "train", "loss": 1.5}, "{broken"])
    assert [r.value for r in files.read_train_log(spark, t).orderBy("line").collect()] == [2.0, 1.5]
    e = lines(tmp_path / "e.log", ["{'obj_box_col': 0.1, 'L2': 9}", "{'obj_col': 0.003, 'obj_box_col': 0.026, 'L2': 4.33}", "{'L2': 1}", "end"])
    r = files.read_eval_log(spark, e).first()
    assert (r.l2, r.obj_col, r.obj_box_col) == (4.33, 0.003, 0.026)
    infos = spark.createDataFrame([(f"t{k}", 100 - k, "s") for k in range(50)], "token string, timestamp long, scene_token string")
    assert [r.timestamp for r in files.read_infos(infos, 4).collect()] == list(range(51, 101, 4))
    assert files.read_infos(infos.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="lack"):
        files.read_infos(infos.drop("timestamp"))
    kept, counts = sinks.info_subset(infos.coalesce(1), spark.createDataFrame([("t7",), ("t3",)], "sample_token string"))
    assert [r.token for r in kept.collect()] == ["t3", "t7"] and counts == {"source": 50, "selected": 2}
    with pytest.raises(ValueError, match="isn't in the source"):
        sinks.info_subset(infos, spark.createDataFrame([("zz",)], "sample_token string"))


def test_writers(spark, tmp_path):
    sinks.write_document(str(tmp_path / "d" / "x.json"), {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": [2], "b": 1} and len(list((tmp_path / "d").iterdir())) == 1
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "episode long, reward double")
    path = str(tmp_path / "e")
    sinks.append_jsonl(rows, path, ["episode", "reward"])
    for bad in (rows.drop("reward"), rows.withColumn("reward", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            sinks.append_jsonl(bad, path, ["episode", "reward"])
    out = sinks.upsert(tables.read_jsonl(spark, path, "episode long, reward double"), rows.filter("episode = 2").withColumn("reward", F.lit(9.0)), "episode")
    sinks.replace(spark, out, "file://" + str(tmp_path / "u"))
    again = spark.read.parquet(str(tmp_path / "u"))
    sinks.replace(spark, again.filter("episode = 2"), "file://" + str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).first().reward == 9.0
    assert sinks.markdown(rows, "T").splitlines()[4] == "| 1 | 0.5000 |" and sinks.percent(None) == "n/a" and sinks.percent(0.123456) == "12.35%"


def test_trajectory_features(spark):
    rng = np.random.default_rng(0)
    trajs = [rng.normal(size=(n, 3)).tolist() for n in (1, 2, 3, 4, 9)] + [[]]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(trajs)], "id int, traj_raw array<array<double>>")
    for r in d.select("id", *(features.feature({"kind": k}).alias(k) for k in ("traj_speed_mean", "traj_accel_abs_mean", "traj_jerk_abs_mean", "traj_curvature_abs_mean")), features.speed_column(F.col("traj_raw")).alias("col")).collect():
        t = np.array(trajs[r.id]).reshape(-1, 3)[:, :2]
        for order, got in ((1, r.traj_speed_mean), (2, r.traj_accel_abs_mean), (3, r.traj_jerk_abs_mean)):
            assert got == pytest.approx(np.linalg.norm(np.diff(t, order, axis=0), axis=1).mean() if len(t) > order else 0)
        v = np.diff(t, axis=0)
        assert r.traj_curvature_abs_mean == pytest.approx(np.abs(np.diff(np.unwrap(np.arctan2(v[:, 1], v[:, 0])))).mean() if len(v) > 1 else 0)
        assert r.col == pytest.approx(np.abs(np.array(trajs[r.id])[:, 2]).mean() if len(t) else 0)
    one = spark.createDataFrame([([1.0, float("nan"), 3.0], [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0], [0, 1, 0])], "a array<double>, even array<double>, odd array<double>, hot array<int>")
    r = one.select(features.sized(F.col("a"), 5), features.paired(F.col("even")), features.paired(F.col("odd")), features.hot(F.col("hot")), features.one_hot(F.lit(2), 3), features.projected(F.col("a"), 1, "n", 4, 6), features.joined(F.col("a"), F.lit(None).cast("array<double>"), F.col("odd"))).first()
    assert r[0] == [1, 0, 3, 0, 0] and r[1] == [[1, 2], [3, 4]] and r[2] == [[1, 0], [2, 0], [3, 0]] and r[3] == 1 and r[4] == [0, 0, 1] and len(r[5]) == 6 and len(r[6]) == 6
    with pytest.raises(ValueError):
        features.feature({"kind": "what"})


def test_apportion_and_select(spark):
    assert selection.apportion({0: 10, 1: 10, 2: 1}, 12) == {0: 6, 1: 6, 2: 0}
    assert selection.apportion({0: 2, 1: 10}, 8, {0: 100.0, 1: 0.0}) == {0: 2, 1: 6}
    assert selection.apportion({0: 3, 1: 1}, 99) == {0: 3, 1: 1} and selection.apportion({}, 3) == {}
    assert (selection.budget_count(0, 0.5), selection.budget_count(9, 1), selection.budget_count(9, 4.9)) == (1, 9, 4)
    rows = [(f"t{k:02}", "train" if k % 5 else "val", k % 3, float(k % 7), 0.1 * (k % 4), k % 6) for k in range(60)]
    m = spark.createDataFrame(rows, "sample_token string, split string, domain_id int, teacher_loss double, teacher_uncertainty double, agent_count int")
    got = selection.select(m, "domain_stratified", "loss", 0.25)
    pool = [r for r in rows if r[1] == "train"]
    share = selection.apportion({d: sum(r[2] == d for r in pool) for d in (0, 1, 2)}, 12)
    assert {(r.domain_id, r.sample_token) for r in got.collect()} == {(d, r[0]) for d in share for r in sorted((r for r in pool if r[2] == d), key=lambda r: (-r[3], r[0]))[: share[d]]}
    doc = selection.artifact(got, baseline="domain_stratified")
    assert doc["selected_count"] == 12 and doc["domain_counts"] == {str(d): k for d, k in share.items()} and len(doc["selection_hash"]) == 64
    assert selection.select(m, "full_data", "original", 0.1).count() == len(pool)
    assert selection.select(m, "mosaic_lite", "uncertainty", 5, exclude=got).join(got, "sample_token").count() == 0
    assert selection.select(m.limit(0), "domain_stratified", selection.linear({"teacher_loss": 1.0}, 0.0, {0: 2.0}), 0.5).count() == 0
    out = selection.rolling(m, "loss", 0.2, 3, lambda df, name: spark.createDataFrame(df.collect(), df.schema)).collect()
    mine = [r.sample_token for r in out if r.arm == "selector"]
    assert len(mine) == len(set(mine)) == 30 and sum(r.arm == "random" for r in out) == 30
    scenes = spark.createDataFrame([(f"s{k}", "abc"[k % 3], "train", 40) for k in range(9)], "name string, location string, split string, sample_count int")
    got = selection.balanced_scenes(scenes, "train", 120).orderBy("turn").collect()
    assert len({s.location for s in got}) == 3 and selection.balanced_scenes(scenes, "val", 9).collect() == []
    assert sum(s.sample_count for s in got) >= 120 > sum(s.sample_count for s in got[:-1])


def test_learners(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    rows = spark.createDataFrame([(f"t{k}", list(map(float, v)), float(np.tanh(v[0]) - v[1] + (k % 2)), k % 2) for k, v in enumerate(x)], "sample_token string, x array<double>, y double, domain int")
    model, losses = learning.train_mlp(rows, hidden=6, domains=2, epochs=12, lr=0.1)
    assert losses[-1] < 0.8 * losses[0] and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    flat, n = model.flat.copy(), len(model.flat)
    after, _ = learning.train_mlp(rows, epochs=1, lr=1.0, l2=0.0, start=model)
    zx, zy, d = (x - model.x_mean) / model.x_std, (np.array([r.y for r in rows.collect()]) - model.y_mean) / model.y_std, np.arange(80) % 2
    loss = lambda f: ((learning._forward(f, zx, d, 6, 2)[0] - zy) ** 2).mean()
    for k in rng.integers(0, n, 8):
        e = np.zeros(n)
        e[k] = 1e-6
        assert (flat - after.flat)[k] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-5)
    assert model.scores(rows, spark.createDataFrame([("t0", 5.0)], "sample_token string, v double")).count() == 80
    points = spark.createDataFrame([(k, [float(k % 3 * 10), float(k % 2)], 1.0 + k % 2) for k in range(60)], "id long, x array<double>, weight double")
    centres = learning.lloyd(points, learning.seeded(points, 3, 1))
    assert sorted(centres[:, 0].round(6)) == [0, 10, 20] and np.allclose(centres[:, 1], 2 / 3)
    assert learning.kmeans(points.limit(0), 3).size == 0 and learning.assigned(points.limit(0), np.empty((0, 0))).count() == 0
    boxes = points.select("id", F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y"), F.lit(0.0).alias("z"))
    assert learning.box_anchors(boxes, 2).shape == (2, 11) and learning.line_anchors(boxes, 3).shape == (3, 20, 2)
    paths = boxes.select("id", (F.col("id") % 2).alias("cmd"), F.array(F.array("x", "y"), F.array("y", "x")).alias("path"), (F.col("id") > 3).alias("complete"))
    assert {k: v.shape for k, v in learning.path_anchors(paths, 2, 3, by="cmd").items()} == {0: (3, 2, 2), 1: (3, 2, 2)}
    loss_rows = spark.createDataFrame([(f"t{k}", float(k), float(-k)) for k in range(40)], "sample_token string, a double, loss double")
    w, rewards = learning.policy(loss_rows, ["a"], {"a": 0.1}, rounds=3)
    assert w["a"] > 0.1 and all(r > 0 for r in rewards)


def test_motion_metrics(spark):
    rng = np.random.default_rng(1)
    modes, path = rng.normal(size=(3, 6, 2)) * 2, rng.normal(size=(4, 2))
    pred = spark.createDataFrame([(1, 0, 7, 0.9, 0.0, 0.0, modes.tolist()), (1, 0, 8, 0.5, 9.0, 9.0, modes.tolist()), (1, 1, 9, 0.5, 0.0, 0.0, modes.tolist())], "sample long, class long, pred_id long, conf double, x double, y double, modes array<array<array<double>>>")
    truth = spark.createDataFrame([(1, 0, 3, 0.5, 0.0, path.tolist()), (1, 1, 4, 0.0, 0.1, [])], "sample long, class long, truth_id long, x double, y double, path array<array<double>>")
    got = {r.pred_id: r for r in motion.matched(pred, truth).collect()}
    d = np.linalg.norm(modes[:, :4] - path[None], axis=2)
    assert (got[7].min_ade, got[7].min_fde) == (pytest.approx(d.mean(1).min()), pytest.approx(d[:, -1].min())) and got[7].miss == int(d.max(1).min() > 2)
    assert got[8].truth_id is None and got[8].min_ade is None and (got[9].min_ade, got[9].miss) == (0.0, 0)
    a = {r["class"]: r for r in motion.accuracy(motion.matched(pred, truth), truth).collect()}
    assert (a[0].tp, a[0].fp, a[0].epa) == (1, 1, pytest.approx(float(d[:, -1].min() < 2) - 0.5)) and a[1].epa == 1.0
    assert motion.accuracy(motion.matched(pred.limit(0), truth), truth).first().epa == 0.0


def test_instances_in_a_stream(spark, tmp_path):
    rng, times = np.random.default_rng(4), [1_600_000_000_000_000 + u for u in (0, 500_000, 1_000_000, 4_000_000)]
    rows = [(s, int(u), k, float(rng.random()), float(rng.random())) for s in (1, 2) for u in times for k in range(5)]
    frame = spark.createDataFrame(rows, "scene long, us long, slot long, x double, conf double")
    want = {tuple(map(str, r)) for r in instances.instances(frame, keep=3).collect()}
    assert len(want) == 40
    for k, u in enumerate(times):
        frame.filter(F.col("us") == u).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = instances.instances(stream, keep=3).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(map(str, r)) for r in spark.sql("SELECT * FROM carried").collect()} == want
    now, out = instances.step((None, 0, [], [], []), 0, pd.DataFrame({"slot": [0, 1, 2], "x": [1.0, 2.0, 3.0], "conf": [0.9, 0.4, 0.7]}), keep=2, threshold=0.5, decay=0.6, interval=2, frames=4)
    assert [o[1] for o in out] == [0, -1, 1] and now[2] == [0, 1]
    now, out = instances.step(now, 1, pd.DataFrame({"slot": [0, 1, 2], "x": [5.0, 6.0, 7.0], "conf": [0.1, 0.8, 0.6]}), keep=2, threshold=0.5, decay=0.6, interval=2, frames=4)
    assert [(o[1], o[2], o[3]) for o in out] == [(0, pytest.approx(0.54), [1.0, 5.0]), (1, 0.8, [3.0, 6.0]), (2, 0.6, [7.0])]
    assert [o[1] for o in instances.step(now, 9, pd.DataFrame({"slot": [0], "x": [1.0], "conf": [0.9]}), keep=2, threshold=0.5, decay=0.6, interval=2, frames=4)[1]] == [3]


def test_feedback_is_logged_once(spark, tmp_path):
    rows = [("a", 1, ["x", "y"], 0.5), ("b", 2, ["y", "z"], -0.5), ("a", 1, ["x", "y"], 0.5)]
    for k, part in enumerate((rows, rows[1:])):
        spark.createDataFrame(part, rounds.EPISODE).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    path, seen = "file://" + str(tmp_path / "log"), []
    stream = spark.readStream.schema(rounds.EPISODE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = rounds.collect_feedback(stream, path, str(tmp_path / "ck"), lambda log, n: seen.append(log.count()))
    q.awaitTermination()
    log = rounds.log_of(spark, path)
    assert sorted(r.episode_id for r in log.collect()) == ["a", "b"] and len(seen) == 2
    assert {tuple(r) for r in rounds.used_tokens(log).collect()} == {("x", 1), ("y", 1), ("z", 2)}
    assert rounds.resume(log) == 2 and rounds.resume(log, has_selector=False) == 0
    assert math.isclose(log.agg(F.sum("reward")).first()[0], 0.0)
