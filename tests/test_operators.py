"""Operators beyond SQL against brute force, and streams against batches."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovekit import streaming
from drovekit.operators import learning, matching

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (4, 6)])
def test_assignment_is_the_cheapest(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = rng.random(shape)
        small = c if shape[0] <= shape[1] else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
        got = matching.assignment(c)
        assert len(got) == min(shape) and sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_greedy_takes_the_nearest_that_is_free(spark):
    pred = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0), (1, 2, 0.8, 0.1, 0.0), (1, 3, 0.7, 9.0, 9.0), (2, 4, 0.5, 0.0, 0.0)], "token long, pred_id long, conf double, x double, y double")
    truth = spark.createDataFrame([(1, 10, 0.2, 0.0), (1, 11, 0.5, 0.0)], "token long, truth_id long, x double, y double")
    got = {r.pred_id: r.truth_id for r in matching.greedy(pred, truth, ["token"], 2.0).collect()}
    assert got == {1: 10, 2: 11, 3: None, 4: None}


def test_kmeans_finds_clusters(spark):
    rows = [(k, [float(k % 3 * 10), float(k % 2)], 1.0) for k in range(60)]
    points = spark.createDataFrame(rows, "id long, x array<double>, weight double")
    centres = learning.kmeans(points, 3)
    assert sorted(centres[:, 0]) == [0, 10, 20]
    assert learning.assigned(points, centres).groupBy("cluster").count().filter("count = 20").count() == 3


def test_ridge_without_penalty_is_least_squares(spark):
    x = np.random.default_rng(0).random((50, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(3 * a - b + 2)) for a, b in x], "a double, b double, y double")
    w = learning.ridge(rows, ["a", "b"], "y", 0.0)
    assert np.allclose(w, [3 * (x[:, 0].std() + 1e-6), -(x[:, 1].std() + 1e-6), (3 * x[:, 0] - x[:, 1] + 2).mean()])


@pytest.mark.parametrize(("op", "key"), [(streaming.sessions, "user_id"), (streaming.tumbling, "event_type")])
def test_stream_equals_batch(spark, tmp_path, op, key):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = op(stream, late="365 days").writeStream.format("memory").queryName(op.__name__).outputMode("complete" if op is streaming.tumbling else "append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(map(str, r)) for r in spark.sql(f"SELECT * FROM {op.__name__}").collect()}
    want = {tuple(map(str, r)) for r in op(events).collect()}
    assert got == want if op is streaming.tumbling else got <= want
