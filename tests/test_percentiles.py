"""Percentiles by counting, against sorting."""

import math
import random

import pytest

from veilgrid.operators import metrics


def plain(rows, shares):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {(g, *(sorted(v)[max(1, math.ceil(s * len(v))) - 1] for s in shares), max(v), len(v)) for g, v in groups.items()}


@pytest.mark.parametrize("most", [50_000, 0])
def test_percentiles_equal_sorting(spark, monkeypatch, most):
    monkeypatch.setattr(metrics, "MOST_BRACKETS", most)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, 1.5, rng.random() * 1e9, rng.expovariate(1), -rng.random(), None])) for _ in range(20_000)] + [("one", 7.0), ("none", None), ("same", 3.0), ("same", 3.0)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    assert {tuple(r) for r in metrics.nearest_rank(df, "v", shares, ["g"]).collect()} == plain(rows, shares)
    assert {tuple(r) for r in metrics.nearest_rank(df, "v", shares).collect()} == {r[1:] for r in plain([(0, v) for _, v in rows], shares)}
    assert metrics.nearest_rank(df.limit(0), "v", shares).count() == 0


def test_a_bracket_that_misses_is_made_good(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(metrics.F, "percentile_approx", lambda *a: F.array(*(F.lit(5.0) for _ in range(6))))
    rows = [("a", float(v)) for v in range(100)]
    assert {tuple(r) for r in metrics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", [0.01, 0.5, 0.06], ["g"]).collect()} == plain(rows, [0.01, 0.5, 0.06])


def test_rates(spark):
    import datetime as dt

    at = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for k, s in (("a", 0), ("a", 5), ("a", 10), ("b", 3))] + [("c", None)]
    got = {r.k: (r.requests, r.seconds, r.per_second) for r in metrics.throughput(spark.createDataFrame(at, "k string, t timestamp"), "t", ["k"]).collect()}
    assert got == {"a": (3, 10.0, 0.3), "b": (1, 0.0, None)}
