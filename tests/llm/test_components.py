import random

import numpy as np
import pyarrow as pa
import pytest

from veilgrid.llm import components as C


def plain(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def drawn(nodes, n, seed):
    rng = random.Random(seed)
    names = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(nodes)]
    return [(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(n)) if a != b]


def test_few_links_need_no_step(spark, monkeypatch):
    """A path, which steps over the table halve one after another."""
    monkeypatch.setattr(C, "_large_star", lambda edges: pytest.fail("a step over the table"))
    links = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(7, 7), (None, 3), (900, 901)], "a long, b long").repartition(3)
    assert sorted(map(tuple, C.components(links).collect())) == [(i, 0) for i in range(501)] + [(900, 900), (901, 900)]


def test_links_in_many_parts_equal_a_fold(spark, monkeypatch):
    links = drawn(300, 260, 1)
    for part in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(C, "PART_LINKS", part)
        batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in x]), pa.array([b for _, b in x])], ["a", "b"]) for x in (links[:90], [], links[90:]) if x]
        made = [(a, b) for got in C._contracted(iter(batches)) for a, b in zip(*(c.to_pylist() for c in got.columns))]
        assert all(a > b for a, b in made) and plain(made) == plain(links)
    assert C._stars(np.array([], np.int64), np.array([], np.int64))[0].size == 0
    monkeypatch.setattr(C, "_contracted", lambda batches: batches)  # so that steps over the table do all
    steps = sorted(map(tuple, C.components(spark.createDataFrame(links, "a long, b long")).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, C.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())) == steps == sorted(plain(links).items())
