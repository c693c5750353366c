"""Places at a size at which a plan that runs twice would cut its ranges differently, with repeated keys, with and without AQE."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovekit.functions.placement import decayed, placed, running
from drovekit.sources import files


@pytest.fixture(params=[True, False])
def adaptive(spark, request):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", was)


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(500_000).select("id", (F.xxhash64("id") % 5000).alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 977).alias("g"))


def test_places_are_a_permutation(spark, many, adaptive):
    got = placed(many, ["k"])
    s = got.agg(F.count("*"), F.countDistinct("_place"), F.min("_place"), F.max("_place")).first()
    assert tuple(s) == (500_000, 500_000, 0, 499_999)
    upset = got.groupBy("k").agg(F.min("_place").alias("lo"), F.max("_place").alias("hi"), F.count("*").alias("n"))
    assert upset.filter("hi - lo + 1 != n").isEmpty()
    ordered = sorted(tuple(r) for r in upset.select("k", "lo").collect())
    assert [lo for _, lo in ordered] == sorted(lo for _, lo in ordered)


def test_places_within_groups_of_any_size(spark, many, adaptive):
    got = placed(many, ["k", "id"], within=["g"])
    sizes = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("_place").alias("d"), F.min("_place").alias("lo"), F.max("_place").alias("hi"))
    assert sizes.filter("n != d or lo != 0 or hi != n - 1").isEmpty()  # one group holds a third of all rows
    want = sorted(((r.k, r.id) for r in many.filter("g = 0").collect()))
    have = [(r.k, r.id) for r in got.filter("g = 0").orderBy("_place").collect()]
    assert have == want


def test_places_of_few_rows(spark):
    assert placed(spark.createDataFrame([], "k int, g string"), ["k"], within=["g"]).collect() == []
    rows = spark.createDataFrame([(3, None), (1, None), (None, "a"), (2, "a"), (2, "a")], "k int, g string")
    got = sorted((str(r.g), r["_place"], r.k) for r in placed(rows, ["k"], within=["g"]).collect())
    assert got == [("None", 0, 1), ("None", 1, 3), ("a", 0, None), ("a", 1, 2), ("a", 2, 2)]


def test_strided_infos_at_a_size(spark, many, adaptive):
    infos = many.select(F.col("id").alias("token"), F.col("k").alias("timestamp"), F.lit("s").alias("scene_token"))
    kept = files.read_infos(infos, 3)
    assert kept.count() == 166_667
    want = {r.id for i, r in enumerate(sorted(many.select("k", "id").collect())) if i % 3 == 0}
    assert {r.token for r in kept.select("token").collect()} == want


def test_running_sums(spark):
    rng = np.random.default_rng(5)
    values = {k: rng.integers(0, 1 << 32, n) for k, n in enumerate((1, 7, 8, 9, 300))}
    df = spark.createDataFrame([(k, i, int(v)) for k, vs in values.items() for i, v in enumerate(vs)], "k int, i int, v long")
    got = {(r.k, r.i): r.s_v for r in running(df, "k", "i", ["v"], 1 << 32, block=8).collect()}
    assert got == {(k, i): int(s) % (1 << 32) for k, vs in values.items() for i, s in enumerate(np.cumsum(vs))}


@pytest.mark.parametrize("block", [4, 64, 512])
def test_decayed_means(spark, block):
    rng = np.random.default_rng(6)
    values = {k: rng.normal(size=n) for k, n in enumerate((1, 5, 700))}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "k int, i int, v double")
    got = {(r.k, r.i): r.before for r in decayed(df, "k", "i", "v", keep=0.9, gain=0.1, block=block).collect()}
    for k, vs in values.items():
        m = 0.0
        for i, v in enumerate(vs):
            assert got[k, i] == pytest.approx(m, abs=1e-12)
            m = 0.9 * m + 0.1 * v
