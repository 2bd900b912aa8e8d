"""Logs read from their end, tables with versions, ranks without a task that holds a group."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from veilgrid.operators import events as E
from veilgrid.plans.ranks import ranked
from veilgrid.sources import logs, tail, versioned

# -- tails --


def event(i, size=0):
    return json.dumps({"id": str(i), "blocked": i % 3 == 0, "mode": "m" * size, "summary": {"detection_count": i}, "audit_integrity": {"sequence": i}})


def write(folder, files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_bytes(b"".join(lines))
    return f"file://{folder}"


@pytest.mark.parametrize("span", [37, 100, 1 << 20])
def test_every_window_gives_the_lines_that_begin_in_it(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(tail, "RANGE", span)
    monkeypatch.setattr(tail, "FIRST", 16)
    files = {"a": [b"one\n", b"\n", b"two is longer\r\n", b"three"], "b": [b"\xc3\xa4 four\n", b"x" * 300 + b"\n", b"five\n"], "c": [], "_no": [b"hidden\n"], "d": [b"six\n", b"torn"]}
    path = write(tmp_path / "log", files)
    whole = b"".join(b"".join(files[k]) for k in "abcd")
    for window in (0, 1, 4, 5, 8, 9, 10, 14, 15, 100, 313, 314, 330, len(whole) - 1, len(whole), 10_000):
        # what begins within the window, file by file
        left, want = window, []
        for k in "dcba":
            text = b"".join(files[k])
            low = max(0, len(text) - left)
            at = 0
            for line in text.split(b"\n"):
                if at >= low and line.strip() and at < len(text) and left > 0:
                    want.append((k, at, line.removesuffix(b"\r").decode()))
                at += len(line) + 1
            left -= len(text) - low
        ranges, size = tail.planned(path, window)
        assert size == len(whole) and sum(r.end - r.start for r in ranges) == min(window, size) and all(r.end - r.start <= span for r in ranges)
        got = sorted((f.rsplit("/", 1)[1], at, line) for r in ranges for f, at, _, line in tail._Reader(path, window).read(r))
        assert got == sorted(want), window


def test_the_tail_of_a_log_reads_its_last_ranges_alone(spark, tmp_path):
    path = write(tmp_path / "log", {f"part-{k:03}": [event(k * 1000 + i, 200).encode() + b"\n" for i in range(1000)] for k in range(20)} | {"part-999": [event(20_000).encode() + b"\n", b'{"torn": ']})
    got = tail.last_events(spark, path, 150).collect()
    assert sorted(r.audit_integrity.sequence for r in got) == list(range(19_851, 20_001)) and not any(r.covered_from_start for r in got)
    lines = tail.window_lines(spark, path, tail.FIRST)
    read = lines.groupBy("file").agg(F.max("bytes").alias("bytes")).collect()
    assert {r.file.rsplit("/", 1)[1] for r in read} == {"part-999", "part-019"} and sum(r.bytes for r in read) == tail.FIRST < tail.planned(path, 0)[1] / 70
    all_ = tail.last_events(spark, path, 50_000).collect()
    assert len(all_) == 20_001 and all(r.covered_from_start for r in all_)
    short = write(tmp_path / "short", {"a": [event(1).encode() + b"\n", event(2).encode()]})
    assert [(r.audit_integrity.sequence, r.covered_from_start) for r in tail.last_events(spark, short, 1).collect()] == [(2, False)]
    assert {(r.audit_integrity.sequence, r.covered_from_start) for r in tail.last_events(spark, short, 2).collect()} == {(1, True), (2, True)}
    assert tail.last_events(spark, f"file://{tmp_path}/none", 5).count() == 0
    assert tuple(E.report(tail.last_events(spark, short, 9)).first())[:3] == (2, 0, 3)


# -- versions --


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def write(name):
        try:
            table = versioned.VersionedTable(spark, path, "k long, v string")
            for i in range(6):
                table.append(rows(spark, (i, name)), writer=name, batch=i)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    table = versioned.VersionedTable(spark, path, "k long, v string")
    assert not failed and table.head().version == 18
    assert sorted((r.v, r.k) for r in table.read().collect()) == [(n, i) for n in "abc" for i in range(6)]
    # a batch that comes again adds nothing
    assert table.append(rows(spark, (99, "a")), writer="a", batch=3) == 18 and table.read().count() == 18
    assert table.read(5).count() == 5


def test_a_moved_head_is_tried_again_up_to_a_bound(spark, tmp_path, monkeypatch):
    table = versioned.VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string")
    real, lost = table._create, []
    monkeypatch.setattr(table, "_create", lambda m: real(m) if len(lost) >= 5 else lost.append(m.version) or False)
    assert table.append(rows(spark, (1, "x"))) == 1 and lost == [1] * 5
    monkeypatch.setattr(table, "_create", lambda m: False)
    monkeypatch.setattr(versioned, "MOST_TRIES", 3)
    with pytest.raises(versioned.Moved):
        table.append(rows(spark, (2, "y")))


def test_keys_are_merged_and_deleted(spark, tmp_path):
    table = versioned.VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    assert table.read().count() == 0
    table.append(rows(spark, (1, "a"), (2, "b"), (3, "c"), (None, "n")))
    table.append(rows(spark, (2, "B")), deletes=spark.createDataFrame([(2,), (3,)], "k long"))
    want = {(1, "a"), (2, "B"), (None, "n")}
    assert {tuple(r) for r in table.read().collect()} == want
    before = table.compact()
    assert {tuple(r) for r in table.read().collect()} == want and len(table.head().segments) == 1 and table.read(before - 1).count() == 3
    table.append(deletes=spark.createDataFrame([(None,), (9,)], "k long"))
    table.append(rows(spark, (3, "again")))
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "B"), (3, "again")}


def test_a_replaced_table_is_always_there(spark, tmp_path):
    table = logs.replace_table(rows(spark, (1, "a")), f"file://{tmp_path}/t")
    held = table.read()
    logs.replace_table(rows(spark, (2, "b"), (3, "c")), f"file://{tmp_path}/t")
    assert held.count() == 1 and table.read().count() == 2


def test_chains_of_writers_at_once(spark, tmp_path):
    path, ends = f"file://{tmp_path}/log", []
    batch = lambda k, n: spark.createDataFrame([(json.dumps({"event": f"{k}-{i}"}), i) for i in range(n)], "record string, position long")
    two = [threading.Thread(target=lambda k=k: ends.append(logs.append_chained(spark, batch(k, 7), path, "w"))) for k in range(2)]
    for t in two:
        t.start()
    for t in two:
        t.join()
    assert logs.append_chained(spark, batch(2, 3), path, "w", batch_id=4) == 17 == logs.append_chained(spark, batch(2, 3), path, "w", batch_id=4)
    assert logs.append_chained(spark, batch(3, 2), path, "v") == 2 and logs.append_chained(spark, batch(3, 0), path, "v") == 2
    lines = logs.chained_log(spark, path).read()
    got = E.verify_chains(lines.select(F.col("writer").alias("chain"), F.col("sequence").alias("position"), "line")).collect()
    assert {(r.chain, r.valid, r.records) for r in got} == {("w", True, 17), ("v", True, 2)}


# -- ranks --


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ranks_equal_those_of_a_window(spark, keys):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919) % 400).alias("x"), "id")
    from pyspark.sql import Window

    order = [F.col("x"), F.col("id")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    got = ranked(df.repartition(7), keys, order)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert ranked(df.limit(0), keys, order).count() == 0
