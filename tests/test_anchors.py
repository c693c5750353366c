"""K-means at anchor sizes: plans that don't grow with k, seeds by weight and distance, steps against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovekit.operators import learning


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(60_000).select("id", F.array(*(((F.xxhash64("id", F.lit(k)) % 1000) / 10.0 for k in range(3)))).alias("x"), (1 + F.col("id") % 3).cast("double").alias("weight"))
    df.write.parquet(path := learning.scratch(spark, "points"))
    return spark.read.parquet(path)


def test_plan_does_not_grow(spark, points):
    size = lambda k: len(learning.assigned(points, np.zeros((k, 3)))._jdf.queryExecution().executedPlan().toString())
    assert abs(size(3) - size(900)) < 50


def test_step_is_numpy(points):
    rows = points.orderBy("id").limit(3000)
    table = rows.toPandas()
    x, w = np.stack(table["x"]), table["weight"].to_numpy()
    centres = x[:50].copy()
    at = np.square(x[:, None] - centres[None]).sum(2).argmin(1)
    got = {r.id: (r.cluster, r.distance) for r in learning.assigned(rows, centres).collect()}
    np.testing.assert_array_equal([got[i][0] for i in table["id"]], at)
    np.testing.assert_allclose([got[i][1] for i in table["id"]], np.square(x - centres[at]).sum(1))
    want = np.array([(x * w[:, None])[at == k].sum(0) / w[at == k].sum() for k in range(50)])
    np.testing.assert_allclose(learning.lloyd(rows, centres, rounds=1), want)
    assert np.array_equal(learning._nearest(np.zeros((1, 2)), np.ones((4, 2)))[0], [0])  # the lowest number on a tie


def test_900_anchors(points):
    seeds = learning.seeded(points, 900, 1)
    assert seeds.shape == (900, 3) and len(np.unique(seeds, axis=0)) == 900
    np.testing.assert_array_equal(seeds, learning.seeded(points.repartition(7), 900, 1))  # draws don't depend on partitions
    spread = learning.assigned(points, seeds).agg(F.avg("distance")).first()[0]
    random = points.orderBy(F.xxhash64("id", F.lit(5))).limit(900).toPandas()
    assert spread < learning.assigned(points, np.stack(random["x"])).agg(F.avg("distance")).first()[0]
    boxes = points.select("id", (F.col("x")[0] / 2).alias("x"), (F.col("x")[1] / 2).alias("y"), (F.col("x")[2] / 50).alias("z"))
    anchors = learning.box_anchors(boxes.limit(20_000), 900)
    assert anchors.shape == (900, 11) and np.hypot(*anchors[:, :2].T).max() < 55


def test_seeds_of_few_places(spark):
    rows = spark.createDataFrame([(i, [float(i % 4), 0.0], 0.0 if i % 4 == 3 else 1.0) for i in range(40)] + [(99, None, 1.0)], "id long, x array<double>, weight double")
    got = learning.seeded(rows, 10, 0)
    assert sorted(got[:, 0].tolist()) == [0.0, 1.0, 2.0]  # a place without weight is no start
    assert learning.seeded(rows.limit(0), 3, 0).size == 0
    far = learning.lloyd(rows, np.array([[0.0, 0.0], [100.0, 100.0]]), rounds=1)
    assert far.shape == (2, 2) and far[1].tolist() in ([2.0, 0.0], [3.0, 0.0])  # an empty cluster starts again at the farthest point
