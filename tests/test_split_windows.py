"""Windows of keys that are split over tasks, against a plain fold."""

import datetime as dt
import random

import pytest

from veilgrid.operators import limits


def plain(rows, limit, seconds):
    start, n, out = {}, {}, []
    for key, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in start or (at - start[key]).total_seconds() >= seconds:
            start[key], n[key] = at, 0
        n[key] += 1
        out.append((key, i, n[key], n[key] <= limit))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most,seconds,spread", [(7, 5, 300), (50, 60, 300), (3, 1000, 300), (40, 1, 50), (10_000, 5, 300)])
def test_split_keys_equal_a_fold(spark, most, seconds, spread):
    rng = random.Random(most)
    day = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "warm", None, f"k{rng.randrange(40)}"]), None if rng.random() < 0.02 else day + dt.timedelta(seconds=rng.randrange(spread), microseconds=rng.choice([0, 0, 1, 999_999])), i) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at timestamp, id long").repartition(5)
    got = limits.first_hit_windows(df, "key", "at", 3, seconds, most)
    assert got.columns == ["key", "at", "id", "hit", "allowed"]
    assert sorted(repr((r.key, r.id, r.hit, r.allowed)) for r in got.collect()) == plain(rows, 3, seconds)


@pytest.mark.parametrize("seconds,wide", [(5, 40), (60, 20), (1000, 20), (30, 1 << 19)])
def test_rounds_follow_wide_blocks(spark, monkeypatch, seconds, wide):
    """120 blocks, of which rounds need not take each, and windows shorter and longer than both kinds of blocks."""
    rng, day, names = random.Random(wide), dt.datetime(2024, 1, 1), []
    monkeypatch.setattr(limits, "WIDE", wide, raising=False)
    kept = limits.written
    monkeypatch.setattr(limits, "written", lambda df, name: names.append(name) or kept(df, name))
    rows = [("hot" if i % 4 else "warm", day + dt.timedelta(seconds=rng.randrange(300)), i) for i in range(480)]
    got = limits.first_hit_windows(spark.createDataFrame(rows, "key string, at timestamp, id long").repartition(3), "key", "at", 3, seconds, 3)
    assert sorted(repr((r.key, r.id, r.hit, r.allowed)) for r in got.collect()) == plain(rows, 3, seconds)
    assert names.count("reached") <= (360 // (wide // 3 * 3) + 1).bit_length()
