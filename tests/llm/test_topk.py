"""Exact top-k search against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import topk


def brute(rows, every, k, scale):
    xs = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, a in xs:
        if q % every == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1), i) for i, b in xs if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def got(df, every, p):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, every, p).collect())


@pytest.mark.parametrize("shape", ["normal", "clustered", "long tail", "equal"])
def test_equals_brute_force(spark, shape):
    rng, n, dim = np.random.default_rng(3), 1200, 16
    v = rng.normal(size=(n, dim))
    if shape == "clustered":
        v = v[rng.integers(0, 10, n)] + 0.05 * v
    elif shape == "long tail":
        v *= np.exp(2 * rng.normal(size=(n, 1)))
    elif shape == "equal":
        v = np.round(v[rng.integers(0, 5, n)])
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for p in (topk.SearchParams(), topk.SearchParams(bucket=50, block=7, seeds=20, cosine=0.3), topk.SearchParams(k=1, bucket=100, seeds=3, cosine=2.0)):
        assert got(df, 50, p) == brute(rows, 50, p.k, p.scale)


def test_odd_vectors(spark):
    r = random.Random(0)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (150, [1.0, None, 0.0, 0.0]), (200, [math.nan] * 4), (250, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (300, [0.0] * 4), (350, [1.0, 2.0]), (351, [3.0, 4.0]), (400, []), (450, [1e12, 1e12, -1e12, 3.5]), (451, [1e12, -1e12, 1e12, 2.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "norm": F.lit("own"), "v": F.lit("own"), "dim": F.lit("own")})
    assert got(df, 50, topk.SearchParams()) == brute(rows, 50, 5, 256)
    assert got(df.limit(0), 50, topk.SearchParams()) == []


def test_repeated_ids(spark):
    """Each row is a candidate, and a query's rows are one query."""
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 0.0]), (1, [0.5, 0.0]), (2, [0.125, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 2.0]), (3, [0.0, 1.0])]
    found = got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, topk.SearchParams(k=3))
    assert [x for x in found if x[0] == 0] == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 1, 16384)]
    assert [x for x in found if x[0] == 50] == [(50, 1, 3, 131072), (50, 2, 3, 65536), (50, 3, 0, 0)]


def test_large_numbers_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 5.0], [-(2.0**40), 1.0]])
    assert topk.products(a, b, 2.0**81).tolist() == [[2**80 + 15, -(2**80) + 3]]


def test_seeds_reach_the_driver_from_one_task(spark):
    """However many splits the vectors have, or results of all of them meet in the driver."""
    sc = spark.sparkContext
    x = topk.quantised(spark.range(600).repartition(150).selectExpr("id vec_id", "array(double(id), 1d) embedding"), 256)
    x = topk.settled(x)
    sc.setJobGroup("seeds", "seeds")
    found = topk.longest(x, 5)
    assert {r["vec_id"] for r in found.collect()} == {595, 596, 597, 598, 599}
    tracker, sizes = sc.statusTracker(), []
    for job in tracker.getJobIdsForGroup("seeds"):
        stages = [tracker.getStageInfo(s) for s in tracker.getJobInfo(job).stageIds]
        sizes.append(max(s.numTasks for s in stages if s))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found.rdd.getNumPartitions() == 1 and max(sizes) <= 64


def test_blocks_of_queries_do_not_follow_the_partitions(spark):
    """A block is copied for cores and buckets, not for each partition of the shuffle."""
    p = topk.SearchParams()
    assert topk.spread_of(615_384, 600, 12, p) == topk.spread_of(615_384, 5000, 12, p) == 48
    assert [topk.spread_of(n, 600, 12, p) for n in (0, 1, 2049, 40_000_000)] == [1, 1, 2, 600] and topk.spread_of(40_000_000, 5000, 12, p) == 1221
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(400)]
    df, held = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        found = topk.search(df, 50, p)
        assert "sequence(0, 96" not in found._jdf.queryExecution().logical().toString()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == brute(rows, 50, 5, 256)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
