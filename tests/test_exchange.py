"""Poses, vehicle messages, submissions, folder sizes and pictures against numpy and hand-made files."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drovekit import sinks
from drovekit.functions import poses
from drovekit.plans import evaluation
from drovekit.sinks import submissions
from drovekit.sources import files, messages, mock
from drovekit.streaming import instances

POSE = "struct<q: array<double>, t: array<double>>"


def random_pose(rng):
    q = rng.normal(size=4)
    return (q / np.linalg.norm(q)).tolist(), rng.normal(0, 5, 3).tolist()


def matrix(p):
    (w, x, y, z), t = p
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def test_poses_are_matrices(spark):
    rng = np.random.default_rng(0)
    rows = [(*(random_pose(rng) for _ in range(4)), rng.normal(0, 3, 3).tolist()) for _ in range(20)]
    df = spark.createDataFrame(rows, f"sensor {POSE}, then {POSE}, now {POSE}, lidar {POSE}, v array<double>")
    c = F.col
    got = df.select(poses.sensor_to_lidar(c("sensor"), c("then"), c("now"), c("lidar")).alias("p"), poses.moved(c("sensor"), c("v")).alias("m"), poses.inverse(c("then")).alias("i"), "sensor", "then", "now", "lidar", "v").collect()
    for r in got:
        inv = lambda p: np.linalg.inv(matrix(p))
        np.testing.assert_allclose(matrix(r.p), inv(r.lidar) @ inv(r.now) @ matrix(r.then) @ matrix(r.sensor), atol=1e-9)
        np.testing.assert_allclose(matrix(r.i), inv(r.then), atol=1e-9)
        np.testing.assert_allclose(r.m, (matrix(r.sensor) @ [*r.v, 1])[:3], atol=1e-9)


def test_ego_status(spark, tmp_path):
    pose = lambda t, k: {"utime": t, "accel": [k, 0.0, 0.0], "rotation_rate": [0.0, k, 0.0], "vel": [0.0, 0.0, k], "pos": [1.0]}
    (tmp_path / "s1_pose.json").write_text(json.dumps([pose(10, 1.0), pose(20, 2.0), pose(20, 2.5), pose(40, 4.0)]))
    (tmp_path / "s1_steeranglefeedback.json").write_text(json.dumps([{"utime": 15, "value": 0.5}, {"utime": 35, "value": -0.5}]))
    (tmp_path / "s2_pose.json").write_text(json.dumps([pose(10, 9.0)]))
    (tmp_path / "other.json").write_text("[]")
    m = messages.read_messages(spark, f"file://{tmp_path}")
    assert m.count() == 7 and {r.stream for r in m.select("stream").distinct().collect()} == {"pose", "steeranglefeedback"}
    times = [1, 10, 14, 15, 16, 20, 30, 31, 99, None]
    samples = spark.createDataFrame([("s1", t, f"a{t}") for t in times] + [("s2", 10, "b"), ("s3", 10, "c")], "scene string, timestamp long, sample_token string")
    got = {r.sample_token: [round(x, 3) for x in r.ego_status] for r in messages.ego_status(samples, m).collect()}
    uts = {"pose": [10, 20, 20, 40], "steer": [15, 35]}

    def located(times, t):
        i = int(np.searchsorted(times, t))
        return i - 1 if i == len(times) or (i > 0 and t - times[i - 1] < times[i] - t) else i

    for t in times[:-1]:
        k, s = [1.0, 2.0, 2.5, 4.0][located(uts["pose"], t)], [0.5, -0.5][located(uts["steer"], t)]
        assert got[f"a{t}"] == [k, 0, 0, 0, k, 0, 0, 0, k, s], t
    assert got["b"] == got["c"] == got["aNone"] == [0.0] * 10


def test_submissions(spark):
    ego, lidar = ([1.0, 0.0, 0.0, 0.0], [100.0, 0.0, 0.0]), ([np.cos(np.pi / 4), 0.0, 0.0, np.sin(np.pi / 4)], [1.0, 0.0, 2.0])
    boxes = [("k1", "car", 0.5, [1.0, 0.0, 0.0], 0.0, [1.0, 0.0], 7, 0), ("k1", "car", 0.9, [60.0, 0.0, 0.0], 0.0, [0.1, 0.1], 8, 1), ("k1", "pedestrian", 0.7, [2.0, 0.0, 0.0], 0.0, [0.0, 0.0], 9, 2), ("k1", "barrier", 0.7, [2.0, 0.0, 0.0], 0.0, [9.0, 0.0], 9, 3), ("k1", "bus", 0.1, [2.0, 0.0, 0.0], 0.0, [0.0, 0.0], 4, 4), ("k1", "bicycle", 0.05, [2.0, 0.0, 0.0], 0.0, [1.0, 0.0], 4, 5)]
    df = spark.createDataFrame([(*b[:4], [1.0, 2.0, 3.0], *b[4:], [[[0.0, 1.0]]], [1.0]) for b in boxes], "token string, name string, score double, center array<double>, size array<double>, yaw double, velocity array<double>, instance int, place long, paths array<array<array<double>>>, path_scores array<double>")
    literal = lambda p: F.struct(F.array(*map(F.lit, p[0])).alias("q"), F.array(*map(F.lit, p[1])).alias("t"))
    world = submissions.in_world(df, literal(lidar), literal(ego))
    tokens = spark.createDataFrame([("k1",), ("k2",)], "token string")
    got = {r.token: r.results for r in submissions.detections(world, tokens, reach={"car": 50.0}).collect()}
    assert got["k2"] == [] and [(e.detection_name, e.detection_score) for e in got["k1"]] == [("pedestrian", 0.7), ("barrier", 0.7), ("car", 0.5), ("bus", 0.1), ("bicycle", 0.05)]
    assert [e.attribute_name for e in got["k1"]] == ["pedestrian.standing", "", "vehicle.moving", "vehicle.stopped", "cycle.with_rider"]
    np.testing.assert_allclose(got["k1"][2].translation, [101, 1, 2], atol=1e-9)  # turned to the left, then both translations
    np.testing.assert_allclose(got["k1"][2].velocity, [0, 1], atol=1e-9)
    tracked = submissions.tracks(world, threshold=0.1).first().results
    assert [(e.tracking_name, e.tracking_id) for e in tracked] == [("car", "8"), ("pedestrian", "9"), ("car", "7"), ("bus", "4")]
    assert submissions.motions(world).first().results[0].trajs == [[[0.0, 1.0]]]
    assert submissions.detections(world.limit(0)).collect() == []


def test_sizes_and_pictures(spark, tmp_path):
    (tmp_path / "a/cam").mkdir(parents=True)
    (tmp_path / "a/cam/1.jpg").write_bytes(b"12345")
    (tmp_path / "a/2.bin").write_bytes(b"1" * 100)
    used = files.usage(spark, {"raw": str(tmp_path / "a"), "none": str(tmp_path / "b")})
    assert sorted(tuple(r) for r in used.collect()) == [("none", 0, 0), ("raw", 2, 105)]
    assert files.reserve(used, 100 << 30, {"raw": 10.0, "work": 20.0}, 60.0)["ok"] and not files.reserve(used, 100 << 30, {"raw": 41.0}, 60.0)["ok"]
    frames = spark.createDataFrame([(0, "front", "cam/1.jpg")], "sample int, camera string, filename string")
    assert bytes(files.read_images(spark, str(tmp_path / "a"), frames).first().content) == b"12345"
    with pytest.raises(Exception, match="no picture"):
        files.read_images(spark, str(tmp_path / "a"), frames.withColumn("filename", F.lit("cam/9.jpg"))).collect()


def test_token_lists_arrays_and_documents(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit('t"'), F.col("id").cast("string")).alias("sample_token")).orderBy(F.desc("sample_token"))
    sinks.write_tokens(rows, f"file://{tmp_path}/l/tokens.json", form="json")
    assert json.loads((tmp_path / "l/tokens.json").read_text()) == sorted((f't"{i}' for i in range(5000)), reverse=True)
    sinks.write_tokens(rows.limit(0), str(tmp_path / "none.json"), form="json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    features = spark.createDataFrame([("a", [[1.0, 2.0]], 0.5, 3, None), ("b", [[3.0, 4.0], [5.0, 6.0]], None, 4, [1.0])], "sample_token string, traj_raw array<array<double>>, teacher_loss double, domain_id long, traj_hidden array<double>")
    assert sinks.write_arrays(features, f"file://{tmp_path}/npz") == 2
    got = np.load(tmp_path / "npz/b.npz")
    assert sorted(got.files) == ["domain_id", "traj_hidden", "traj_raw"] and got["traj_raw"].tolist() == [[3, 4], [5, 6]] and got["domain_id"] == 4
    back = {r.sample_token: r for r in files.read_features(spark, f"file://{tmp_path}/npz").collect()}
    assert back["a"].traj_raw == [[1.0, 2.0]] and back["a"].teacher_loss == 0.5 and back["b"].teacher_loss is None
    with pytest.raises(Exception, match="unsafe"):
        sinks.write_arrays(features.withColumn("sample_token", F.lit("../x")), str(tmp_path / "bad"))
    for path in (f"file://{tmp_path}/d/x.json", str(tmp_path / "d/y.json")):
        sinks.write_document(path, {"b": 1, "a": [2]})
        sinks.write_document(path, {"b": 2, "a": [2]})
    assert json.loads((tmp_path / "d/x.json").read_text()) == json.loads((tmp_path / "d/y.json").read_text()) == {"a": [2], "b": 2} and len(list((tmp_path / "d").iterdir())) == 2


def test_instances_in_runs(spark):
    """A table in runs of frames gives what one pass over each scene gives."""
    rng = np.random.default_rng(2)
    rows = []
    for scene in range(3):
        us = np.cumsum(rng.choice([1, 2, 3, 30], 60))
        rows += [(scene, int(t), int(s), float(rng.random()), float(rng.random())) for t in us for s in range(rng.integers(1, 5))]
    table = pd.DataFrame(rows, columns=["scene", "us", "slot", "x", "conf"])
    want = []
    for scene, g in table.groupby("scene"):
        now = (None, 0, [], [], [])
        for us, frame in g.groupby("us"):
            now, found = instances.step(now, int(us), frame, keep=2, threshold=0.4, decay=0.6, interval=5, frames=4)
            want += [(scene, us, s, i, round(c, 9), tuple(h)) for s, i, c, h in found]
    df = spark.createDataFrame(rows, "scene long, us long, slot long, x double, conf double")
    got = [(r.scene, r.us, r.slot, r.instance, round(r.conf, 9), tuple(r.history)) for r in instances.instances(df, keep=2, threshold=0.4, interval=5).collect()]
    assert sorted(got) == sorted(want) and max(g[3] for g in got) > 5
    assert instances.instances(df.limit(0)).collect() == []


def test_evaluation_modes(spark):
    with pytest.raises(ValueError, match="det"):
        evaluation.evaluate(spark, "/root/testdata/sf0.001", ["planning", "det"])
    with pytest.raises(ValueError, match="no mode"):
        evaluation.evaluate(spark, "/root/testdata/sf0.001", {"map": False})
    got = evaluation.evaluate(spark, "/root/testdata/sf0.001", ["planning", "motion"])
    assert {r.mode for r in got.select("mode").distinct().collect()} == {"planning", "motion"} and got.columns == ["mode", "part", "metric", "value"]


def test_mock_samples(spark):
    m = mock.manifest(spark, 120, 30, 3, seed=5)
    rows = m.orderBy("timestamp").collect()
    assert [sum(r.split == s for r in rows) for s in ("train", "val")] == [120, 30] and len({r.sample_token for r in rows}) == 150
    assert [r.domain_id for r in rows[:4]] == [0, 1, 2, 0] and len({r.scene_token for r in rows}) == 8
    assert rows == mock.manifest(spark, 120, 30, 3, seed=5).repartition(7).orderBy("timestamp").collect() and rows != mock.manifest(spark, 120, 30, 3, seed=6).orderBy("timestamp").collect()
    f = mock.features(m, scene=16, interaction=8, seed=5).first()
    assert np.array(f.traj_raw).shape == (8, 6) and len(f.scene_hidden) == 16 and len(f.interaction_hidden) == 8
    x = np.concatenate([r.scene_hidden for r in mock.features(m.filter("domain_id = 0")).collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05 and mock.manifest(spark, 0, 0).count() == 0
