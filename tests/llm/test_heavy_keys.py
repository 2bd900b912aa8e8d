"""Heavy keys against plain counting, and the bounds of the summaries."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import heavy_keys as hk


def plain(rows, one_in=50):
    groups, n = defaultdict(Counter), Counter()
    for stream, grp, item, weight in rows:
        if None not in (stream, grp, item, weight) and weight >= 0:
            groups[stream, grp][item] += weight
            n[stream, grp] += 1
    total = {g: sum(c.values()) for g, c in groups.items()}
    return {(*g, k): (n[g], total[g], w) for g, c in groups.items() for k, w in c.items() if one_in * w > total[g]}


def check(found, rows, one_in=50):
    got = {(r.stream, r.grp, r["item"]): r for r in found.collect()}
    assert {k: (r.n_entries, r.total, r.w) for k, r in got.items()} == plain(rows, one_in)
    for r in got.values():
        assert r.low <= r.w <= r.high and r.low <= r.estimate <= r.high and 2 * one_in * (r.high - r.low) <= r.total
    return got


def skewed(n, seed):
    rng = random.Random(seed)
    return [("a" if rng.random() < 0.4 else rng.choice("bc"), 1 if rng.random() < 0.3 else rng.randrange(9), f"k{int(rng.paretovariate(0.4))}", rng.choice((1, 1, 2, 9))) for _ in range(n)]


@pytest.mark.parametrize("one_in", [3, 50])
def test_many_blocks_and_rounds_equal_plain_counting(spark, monkeypatch, one_in):
    # small blocks and rounds, set in the closures that the workers get
    rows = skewed(30_000, 1)
    for name, value in (("FAN", 3), ("BLOCK", 500), ("ROW", 7), ("MERGED", 900), ("HELD", 2500)):
        monkeypatch.setattr(hk, name, value)
    parts = [rows[i::13] for i in range(13)]
    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("stream", "grp", "item", "weight"), r)) for r in rows])
    error = 1 / (2 * one_in)
    tables = [pa.Table.from_batches(list(hk._summarise(error)(iter([batch(p[i : i + 300]) for i in range(0, len(p), 300)])))) for p in parts]
    all_rows = pa.concat_tables(tables)
    slots = pa.array(np.repeat(np.arange(13), [t.num_rows for t in tables]), pa.int32())
    all_rows = all_rows.set_column(2, "slot", slots)
    for _ in range(3):
        slot = pa.array(all_rows["slot"].to_numpy() // hk.FAN, pa.int32())
        all_rows = all_rows.set_column(2, "slot", slot).sort_by([("stream", "ascending"), ("grp", "ascending"), ("slot", "ascending")])
        all_rows = pa.Table.from_batches(list(hk._merge(error)(iter(all_rows.to_batches(max_chunksize=50)))))
    assert set(all_rows["slot"].to_pylist()) == {0}
    exact, totals = defaultdict(Counter), Counter()
    for s, g, k, w in rows:
        exact[s, g][k] += w
        totals[s, g] += w
    kept, seen = defaultdict(dict), Counter()
    for r in all_rows.to_pylist():
        g = r["stream"], r["grp"]
        kept[g] |= dict(zip(r["items"], r["counts"]))
        assert r["total"] == totals[g] and r["error"] <= error * totals[g]
        seen[g] += r["head"]
    assert set(seen.values()) == {1} and set(kept) == set(totals)
    for g, counts in exact.items():
        lost = next(r["error"] for r in all_rows.to_pylist() if (r["stream"], r["grp"]) == g)
        assert all(kept[g].get(k, 0) <= w <= kept[g].get(k, 0) + lost for k, w in counts.items())
        assert len(kept[g]) <= hk.RATE ** -hk.LEVELS / (error * (1 - hk.RATE))


def test_small_counts_go_and_the_error_stays_in_its_share():
    rng = np.random.default_rng(5)
    error, node = 0.01, None
    for rank in range(64):
        key = np.concatenate([rng.integers(0, 1 << 40, 20_000), np.full(1500, 7)])
        part = hk.leaf(np.zeros(len(key), np.int64), key, np.ones(len(key), np.int64), 1, error)
        node = part if node is None else hk.merged(hk._both(node, part), np.zeros(2, np.int64), error)
        assert node.error[0] <= error * node.total[0] and len(node.key) <= hk.RATE ** -int(node.level[0]) / (error * (1 - hk.RATE))
    assert node.total[0] == 64 * 21_500 and node.key.tolist() == [7] and node.count[0] <= 64 * 1500 <= node.count[0] + node.error[0]


def test_over_a_table(spark):
    rows = skewed(20_000, 2) + [(None, 1, "x", 1), ("a", None, "x", 1), ("a", 1, None, 1), ("a", 1, "x", None), ("a", 1, "x", -5)]
    rows += [("zero", 1, "k", 0), ("one", 1, "", 1), ("long", 1, "l" * 200_000, 3), ("tie", 1, "half", 1)] + [("tie", 1, f"t{i}", 1) for i in range(49)]
    df = spark.createDataFrame(rows, "stream string, grp long, item string, weight long").withColumns({"slot": F.lit(9), "w": F.lit(1), "total": F.lit("x")})
    got = check(hk.heavy_keys(df.repartition(9)), rows)
    assert ("one", 1, "") in got and ("long", 1, "l" * 200_000) in got and not any(k[0] in ("zero", "tie") for k in got)
    assert hk.heavy_keys(df.limit(0)).count() == 0


def test_keys_of_properties():
    assert hk.prop_keys('{"device": {"os": "tv"}, "tags": ["b", "b", null, 3, true], "items": [{"sku": 5}, {"qty": 1}, {"sku": null}, {"sku": "x"}, 7]}') == ["os=tv", "tag=b", "tag=b", "tag=3", "tag=true", "sku=5", "sku=x"]
    for broken in (None, "", " ", '{"tags": ["a"]', '{"tags": ["a"]} x', '{"tags": ["a"]}]', '{"tags": ["a", NaN]}', '{"tags": ["\\ud800"]}', "[" * 100_000, '{"tags": ["a"],}', "null", "3", '["a"]'):
        assert hk.prop_keys(broken) == []
    assert hk.prop_keys(' {"device": {"os": null}, "tags": null, "items": {}} ') == hk.prop_keys('{"device": "tv", "tags": "a"}') == []


def test_the_shop(spark, data):
    import datetime

    rows = []
    for r in spark.read.parquet(f"{data}/clicks.parquet").collect():
        if r.ts is not None:
            rows.append(("user", int((r.ts - datetime.datetime(1970, 1, 1)).total_seconds() // 21600), None if r.client_id is None else str(r.client_id), 1))
        rows += [("prop", r.client_id, k, 1) for k in hk.prop_keys(r.props)]
    rows += [("part", r.vendor_id, None if r.item_id is None else str(r.item_id), r.quantity) for r in spark.read.parquet(f"{data}/sale_lines.parquet").collect()]
    got = check(hk.shop_heavy_keys(spark, data), rows)
    assert {k[0] for k in got} == {"user", "part", "prop"}
