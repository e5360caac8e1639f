"""Neighbours in time, interpolation and exact percentiles against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import asof, joins, metrics, quantiles


def test_between_irregular_samples(spark):
    r = random.Random(2)
    samples = sorted({round(r.uniform(0, 100), 2) for _ in range(60)})
    right = [(t, r.uniform(-5, 5), r.uniform(-180, 180)) for t in samples]
    left = [(k, r.uniform(-20, 120)) for k in range(200)] + [(900 + k, samples[k % 60]) for k in range(80)] + [(1000, None)] + [(2000 + k, 50.0) for k in range(300)]
    ldf, rdf = spark.createDataFrame(left, "k long, t double"), spark.createDataFrame(right, "s double, v double, yaw double")
    got = {x["k"]: (x["v"], x["yaw"]) for x in asof.interpolated(ldf.repartition(3), rdf, "t", "s", ["v"], ["yaw"]).collect()}
    assert len(got) == len(left) and got[1000] == (None, None)
    for k, t in left:
        if t is None:
            continue
        i = min(max(int(np.searchsorted(samples, t, side="right")) - 1, 0), len(samples) - 2)
        (t0, v0, y0), (t1, v1, y1) = right[i], right[i + 1]
        w = (t - t0) / (t1 - t0)
        assert math.isclose(got[k][0], v0 + (v1 - v0) * w, abs_tol=1e-9)
        s, c = (round(f(math.radians(y0)) + (f(math.radians(y1)) - f(math.radians(y0))) * w, 9) for f in (math.sin, math.cos))
        assert math.isclose(got[k][1], math.degrees(math.atan2(s, c)), abs_tol=1e-6)
    held = {x["k"]: x["v"] for x in asof.interpolated(ldf, rdf, "t", "s", ["v"], extrapolate=False).collect()}
    assert all(math.isclose(held[k], float(np.interp(t, samples, [x[1] for x in right])), abs_tol=1e-9) for k, t in left if t is not None)


def test_wrap_one_sample_and_none(spark):
    left = spark.createDataFrame([(1, 5.0), (2, -5.0)], "k long, t double")
    right = spark.createDataFrame([(0.0, 170.0), (10.0, -170.0), (10.0, -170.0), (None, 3.0)], "s double, yaw double")
    assert {x["k"]: round(x["yaw"], 6) for x in asof.interpolated(left, right, "t", "s", [], ["yaw"]).collect()}[1] in (180.0, -180.0)
    one = right.filter("s = 0")
    assert [x["yaw"] for x in asof.interpolated(left, one, "t", "s", ["yaw"]).collect()] == [170.0, 170.0]
    assert [x["yaw"] for x in asof.interpolated(left, right.filter("false"), "t", "s", ["yaw"]).collect()] == [None, None]


def test_nearest_with_a_hot_time(spark):
    """A third of all rows at one time; ties go to the earlier one, of one time to the smaller id."""
    r = random.Random(3)
    right = [(r.randrange(1000), k) for k in range(150)]
    left = [(k, r.randrange(-100, 1100)) for k in range(300)] + [(1000 + k, 500) for k in range(200)] + [(5000, None)]
    got = {x["k"]: (x["i"], x["dt_us"]) for x in joins.nearest_in_time(spark.createDataFrame(left, "k long, t long"), spark.createDataFrame(right, "u long, i long"), "t", "u", "i").collect()}
    assert got.pop(5000) == (None, None)
    for k, t in left[:-1]:
        d, u, i = min((abs(u - t), u, i) for u, i in right)
        assert got[k] == (i, d)


@pytest.mark.parametrize("few", [1, 50, 20_000])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    r = np.random.default_rng(1)
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for values in (r.normal(size=3000), np.repeat([1.0, 2.0, 3.0], [2000, 1, 5]), np.exp(r.normal(size=500) * 40), np.array([1e308, -1e308, 5.0]), np.array([7.0])):
        d = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        assert np.allclose(quantiles.percentiles(d, "v", shares), np.quantile(values / 2, shares) * 2, rtol=1e-12)
        assert quantiles.percentiles(d, "v", shares, lower=True) == np.quantile(values, shares, method="lower").tolist()
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    assert quantiles.percentiles(ends, "v", (0.0, 0.5, 0.9, 1.0)) == [-math.inf, 1.5, math.inf, math.inf]
    assert quantiles.percentiles(ends.filter("v is null"), "v", (0.5,)) == [None]


def test_points_and_caps(spark):
    d = spark.createDataFrame([(0.9, 0, 0, 15, 1.0), (0.9, 0, 1, 15, 1.0), (0.9, 241, 250, 255, 1.0), (0.9, 240, 250, 255, 1.0), (0.1, 9, 9, 9, 1.0), (0.9, 9, 9, 9, 0.01), (0.9, 9, 9, 9, float("nan"))], "c double, r int, g int, b int, z double")
    kept = metrics.kept_points(d, "c", 50.0, ("r", "g", "b"), z="z")
    assert sorted((x["r"], x["g"]) for x in kept.collect()) == [(0, 1), (240, 250)]
    assert metrics.kept_points(d.withColumn("c", F.lit(0.0)), "c", 0.0).count() == 0
    caps = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    assert (metrics.density_cap(caps, "v").first()[0], metrics.density_cap(caps, "v", lower=True).first()[0]) == (9.9, 9.0)
    assert metrics.density_cap(caps.filter("v < 0"), "v").first()[0] == 0.5 and metrics.density_cap(caps.filter("v = 0"), "v").first()[0] == 0.1
