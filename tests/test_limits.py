"""Limiters and stores that forget, against plain folds over all requests."""

import datetime as dt

from veilgrid.operators import limits
from veilgrid.plans import catalog
from veilgrid.sources import logs, stores

DAY = 86_400_000_000


def in_order(spark, data):
    rows = catalog._requests(spark, data).collect()
    return sorted(rows, key=lambda r: (r.server, r.ts, r.user_id, r.event_id))


def micros(t):
    return (t - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1)


def test_capped_limiter(spark, data):
    want, free, known, hits = {}, {}, {}, {}
    for r in in_order(spark, data):
        t, k = micros(r.ts), r.user_id
        for most, out in ((8, want), (10**9, free)):
            held = known.setdefault((most, r.server), {})
            if k not in held or t >= held[k]:
                if k not in held:
                    for x in [x for x, end in held.items() if t >= end]:
                        del held[x]
                    while len(held) >= most:
                        del held[list(held)[0]]
                held[k] = t + DAY
                hits[most, r.server, k] = 0
            hits[most, r.server, k] += 1
            out[r.event_id] = (hits[most, r.server, k], hits[most, r.server, k] <= 2)
    got = {r.event_id: (r.hit, r.allowed) for r in catalog.rate_capped_limiter(spark, data).collect()}
    assert got == want
    small = limits.capped_limiter(catalog._requests(spark, data), "server", "user_id", "ts", 2, 86400, 1).collect()
    assert {r.event_id: (r.hit, r.allowed) for r in small} != free  # keys were forgotten
    assert limits.capped_limiter(catalog._requests(spark, data).where("false"), "server", "user_id", "ts").count() == 0


def test_pending_store(spark, data):
    want, held = {}, {}
    for r in in_order(spark, data):
        t, k, store = micros(r.ts), r.user_id, held.setdefault(r.server, {})
        if r.event_id % 3 == 0:
            want[r.event_id] = k in store and store.pop(k) > t
            continue
        for x in [x for x, end in store.items() if end <= t]:
            del store[x]
        want[r.event_id] = k in store or len(store) < 4
        if want[r.event_id]:
            store[k] = t + DAY
    got = {r.event_id: r.ok for r in catalog.pending_logins(spark, data).collect()}
    assert got == want and len(set(want.values())) == 2


def test_a_full_store_and_nulls(spark):
    at = dt.datetime(2024, 1, 1)
    steps = [("s", at, "set", "a"), ("s", at, "set", "b"), ("s", at, "set", "c"), ("s", at + dt.timedelta(seconds=10), "take", "a"), ("s", at + dt.timedelta(seconds=11), "take", "a"),
             ("s", at + dt.timedelta(seconds=12), "set", "c"), ("s", at + dt.timedelta(seconds=60), "take", "b"), (None, at, "set", None), ("s", None, "set", "z")]
    df = spark.createDataFrame(steps, "store string, at timestamp, action string, key string")
    got = limits.pending_store(df, "store", "key", "action", "at", 60, 2).orderBy("at", "action", "key").where("store is not null").collect()
    assert [r.ok for r in got] == [True, True, False, True, False, True, False]


def test_stores(spark, data, tmp_path):
    assert stores.vault_table(spark, f"{tmp_path}/none").count() == 0 and stores.caller_table(spark, f"{tmp_path}/none").columns[0] == "token_hash"
    logs.replace_table(catalog._vault(spark, data), f"{tmp_path}/v")
    read = stores.vault_table(spark, f"{tmp_path}/v")
    assert read.count() == spark.read.parquet(f"{data}/customer.parquet").count() and read.where("envelope.ct is null").count() == 0


def test_streams_hold_addresses(spark, data):
    """Else the queries over streams would check nothing."""
    assert catalog.issued_tokens(spark, data).where("n > 0").count() == catalog.stream_tallies(spark, data).count() > 0
