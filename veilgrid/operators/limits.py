"""Rate limits over requests (key, time): windows from a key's first request, and windows on the clock."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.plans.ranks import ranked
from veilgrid.sources.shared import written

#: Requests of the wide blocks of a key that is split over tasks.
WIDE = 1 << 19


def clock_windows(requests: DataFrame, key: str, time: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests with hit (the number within key and window), and allowed; windows begin at multiples of ``seconds``. Ties
    in time are ordered by the other columns; requests without a time are left out."""
    start = F.floor(F.unix_micros(time) / (seconds * 1_000_000)).cast("long")
    rest = [c for c in requests.columns if c not in (key, time)]
    over = Window.partitionBy(key, "_w").orderBy(time, *rest)
    return requests.where(F.col(time).isNotNull()).withColumn("_w", start).withColumn("hit", F.row_number().over(over)).withColumn("allowed", F.col("hit") <= limit).drop("_w")


def first_hit_windows(requests: DataFrame, key: str, time: str, limit: int, seconds: int = 60, most: int = 100_000) -> DataFrame:
    """The same with windows that begin at a key's first request after its last window ended. They depend on the data, so
    each key is folded in order: rows are sorted by key and time and stream through a task, which holds one key's state.
    Keys with over ``most`` requests are split over tasks (:func:`_split_windows`). Requests without a time are left out,
    as limiters leave them out."""
    requests = requests.where(F.col(time).isNotNull())
    sizes = written(requests.groupBy(F.col(key).alias("_big")).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_big"), "large")
    if sizes.isEmpty():
        return _folded_windows(requests, key, time, limit, seconds)
    same = F.col(key).eqNullSafe(F.col("_big"))
    small, large = (requests.join(sizes, same, kind) for kind in ("left_anti", "left_semi"))
    return _folded_windows(small, key, time, limit, seconds).unionByName(_split_windows(large, key, time, limit, seconds, most))


def _split_windows(requests: DataFrame, key: str, time: str, limit: int, seconds: int, most: int) -> DataFrame:
    """The same for keys of any size. Requests are numbered in ranges, and each learns which request is the first a span
    later, where a window that began with it would be followed by the next. Blocks of ``most`` requests then work out where
    the windows that begin at each of their requests lead out of the block. Only requests that are led to matter further:
    wide blocks of about WIDE requests work out the same for them. Which of those that are led to from wide blocks a key's
    first request reaches is found by doubling, a round for each power of two of wide blocks; a round takes about as many
    rows as a window has requests, for each wide block. So every wide block knows its first window, then every block in it,
    and its windows follow."""
    rest = [c for c in requests.columns if c not in (key, time)]
    name = F.when(F.col(key).isNull(), "none").otherwise(F.concat(F.lit("key "), F.col(key).cast("string")))
    rows = written(ranked(requests.withColumn("_k", name), ["_k"], [F.col(time), *(F.col(c) for c in rest)], "_n"), "numbered")
    block = F.floor((F.col("_n") - 1) / most)
    at = rows.select("_k", "_n", F.unix_micros(time).alias("_t"))
    # requests before a span's end, counted: one more is the next window's first, if there is one
    ends = at.select("_k", "_n", (F.col("_t") + seconds * 1_000_000).alias("_t"), F.lit(0).alias("_w")).unionByName(at.withColumn("_w", F.lit(1)))
    counted = ranked(ends, ["_k"], [F.col("_t"), F.col("_w"), F.col("_n")], "_upto", weight="_w")
    follows = written(counted.where("_w = 0").select("_k", "_n", (F.col("_upto") + 1).alias("_next")).withColumn("_b", block), "follows")

    def out_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            n, follow = t["_n"].to_pylist(), t["_next"].to_pylist()
            leave, last = [0] * len(n), [0] * len(n)
            places = np.searchsorted(t["_n"].to_numpy(), t["_next"].to_numpy()).tolist()
            for i in range(len(n) - 1, -1, -1):
                j = places[i]
                leave[i], last[i] = (follow[i], n[i]) if j >= len(n) else (leave[j], last[j])
            return pa.RecordBatch.from_arrays([t["_k"].combine_chunks(), t["_n"].combine_chunks(), pa.array(leave, pa.int64()), pa.array(last, pa.int64())], ["_k", "_n", "_leave", "_last"])

        now = None
        for batch in batches:
            places = list(zip(batch["_k"].to_pylist(), batch["_b"].to_pylist()))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and places[a] != now:
                        yield done()
                        held.clear()
                    now = places[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, want = None, 0
        for batch in batches:
            k, starts = [], []
            for key_, b, n, follow, entry in zip(*(batch[c].to_pylist() for c in ("_k", "_b", "_n", "_next", "_entry"))):
                if (key_, b) != now:
                    now, want = (key_, b), entry
                if n == want:
                    k.append(key_)
                    starts.append(n)
                    want = follow
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(starts, pa.int64())], ["_k", "_n"])

    def in_blocks(rows: DataFrame, run, schema: str) -> DataFrame:
        return rows.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_n").mapInArrow(run, schema)

    def led(follows: DataFrame, name: str) -> DataFrame:
        """Where blocks (_k, _b, _n, _next) are left from requests that blocks lead to and from a key's first one."""
        leads = written(in_blocks(follows, out_of_blocks, "_k string, _n long, _leave long, _last long"), "leads")
        targets = leads.select("_k", F.col("_leave").alias("_n")).unionByName(leads.select("_k", F.lit(1).cast("long").alias("_n"))).distinct()
        return written(leads.join(targets, ["_k", "_n"]), name)

    jumps = led(follows, "jumps")
    size = most * max(2, WIDE // most)
    wide = F.floor((F.col("_n") - 1) / size)
    steps = jumps.select("_k", "_n", F.col("_leave").alias("_next"), wide.alias("_b"))
    far = led(steps, "far").select("_k", "_n", "_leave")
    reached = far.where("_n = 1").select("_k", "_n")
    blocks = follows.agg(F.max("_n")).first()[0] // size + 1
    for left in range(blocks.bit_length() - 1, -1, -1):
        more = reached.join(far, ["_k", "_n"]).select("_k", F.col("_leave").alias("_n"))
        reached = written(reached.unionByName(more).distinct(), "reached")
        if left:
            further = far.select("_k", F.col("_n").alias("_leave"), F.col("_leave").alias("_far"))
            far = written(far.join(further, ["_k", "_leave"]).select("_k", "_n", F.col("_far").alias("_leave")), "far")
    # the last window leads to one more than there are requests, which can count as of the last block
    entered = steps.join(reached.groupBy("_k", wide.alias("_b")).agg(F.min("_n").alias("_entry")), ["_k", "_b"])
    first = in_blocks(entered, windows, "_k string, _n long")
    entries = written(first.join(jumps, ["_k", "_n"]).select("_k", block.alias("_b"), F.col("_n").alias("_entry"), "_last"), "entries")

    starts = in_blocks(follows.join(entries, ["_k", "_b"]), windows, "_k string, _n long")
    # the window that is open when a block begins is the last one of the blocks before
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opened = follows.select("_k", "_b").distinct().join(entries, ["_k", "_b"], "left").withColumn("_open", F.last("_last", ignorenulls=True).over(before)).select("_k", "_b", "_open")
    inside = Window.partitionBy("_k", "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_b", block).join(starts.withColumn("_start", F.col("_n")), ["_k", "_n"], "left").join(opened, ["_k", "_b"])
    start = F.coalesce(F.last("_start", ignorenulls=True).over(inside), F.col("_open"))
    found = found.withColumn("hit", (F.col("_n") - start + 1).cast("int"))
    return found.select(*requests.columns, "hit", (F.col("hit") <= limit).alias("allowed"))


def _folded_windows(requests: DataFrame, key: str, time: str, limit: int, seconds: int) -> DataFrame:
    rest = [c for c in requests.columns if c not in (key, time)]
    schema = f"{requests._jdf.schema().toDDL()}, hit int, allowed boolean"
    names = [*requests.columns, "hit", "allowed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, start, n = object(), 0, 0
        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            times = batch.column(names.index(time)).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            hits = np.empty(len(keys), np.int32)
            for i, (k, t) in enumerate(zip(keys, times)):
                if k != now_key or t - start >= seconds * 1_000_000:
                    now_key, start, n = k, t, 0
                n += 1
                hits[i] = n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits), pa.array(hits <= limit)], names)

    return requests.repartition(key).sortWithinPartitions(key, time, *rest).mapInArrow(run, schema)


class _Windows:
    """The windows of one limiter with at most ``most`` keys, each from its key's first request. A new key makes room by
    what has ended, then by the keys that came first."""

    def __init__(self, key: str, limit: int, span: int, most: int):
        self.key, self.limit, self.span, self.most = key, limit, span, most
        self.open: dict = {}  # key: [end, hits], in the order in which keys came
        self.ends: deque = deque()  # (end, key), ascending; outdated ones are passed over

    def step(self, row: dict, now: int) -> tuple[int, bool]:
        k = row[self.key]
        held = self.open.get(k)
        if held is None or now >= held[0]:
            if held is None:
                while self.ends and self.ends[0][0] <= now:
                    end, old = self.ends.popleft()
                    if self.open.get(old, (None,))[0] == end:
                        del self.open[old]
                while len(self.open) >= self.most:
                    del self.open[next(iter(self.open))]
            held = self.open[k] = [now + self.span, 0]
            self.ends.append((held[0], k))
        held[1] += 1
        return held[1], held[1] <= self.limit


class _Pending:
    """Entries of one store that wait to be taken, at most ``most``; each is taken once, before its end."""

    def __init__(self, key: str, action: str, ttl: int, most: int):
        self.key, self.action, self.ttl, self.most = key, action, ttl, most
        self.ends: dict = {}  # key: end, in the order of the ends

    def step(self, row: dict, now: int) -> tuple[bool]:
        k = row[self.key]
        if row[self.action] == "take":
            return (self.ends.pop(k, now) > now,)
        while self.ends and next(iter(self.ends.values())) <= now:
            del self.ends[next(iter(self.ends))]
        if k not in self.ends and len(self.ends) >= self.most:
            return (False,)
        self.ends.pop(k, None)
        self.ends[k] = now + self.ttl
        return (True,)


def _in_order(rows: DataFrame, by: str, time: str, added: dict[str, pa.DataType], begin) -> DataFrame:
    """Rows with the columns that ``begin()``'s ``step(row, microseconds)`` adds. The rows of each ``by`` stream through a
    task, sorted by time and then by their other columns; a null ``by`` is one of its own."""
    names, kinds = rows.columns, {pa.int32(): "int", pa.bool_(): "boolean"}
    schema = ", ".join([rows._jdf.schema().toDDL(), *(f"{c} {kinds[t]}" for c, t in added.items())])
    at = names.index(time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row, t in zip(batch.to_pylist(), batch.column(at).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()):
                if row[by] != now:
                    now, state = row[by], begin()
                out.append(state.step(row, t))
            made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *added])

    rest = [c for c in names if c not in (by, time)]
    return rows.where(F.col(time).isNotNull()).repartition(by).sortWithinPartitions(by, time, *rest).mapInArrow(run, schema)


def capped_limiter(requests: DataFrame, limiter: str, key: str, time: str, limit: int = 120, seconds: int = 60, most: int = 4096) -> DataFrame:
    """Requests with hit and allowed, as limiters that know at most ``most`` keys decide them: a key that was forgotten
    begins anew. What one limiter forgets depends on all its requests, so each limiter (a server, say) is folded in order
    by a task, which holds ``most`` keys. Requests without a time are left out; those with equal times come in the order
    of their other columns."""
    span = seconds * 1_000_000
    return _in_order(requests, limiter, time, {"hit": pa.int32(), "allowed": pa.bool_()}, lambda: _Windows(key, limit, span, most))


def pending_store(steps: DataFrame, store: str, key: str, action: str, time: str, ttl_seconds: int = 600, most: int = 1000) -> DataFrame:
    """Steps (action: set or take) with ok: a set fails in a store that is full of others that have not ended, a take
    where nothing waits any more. An entry ends at its end. Stores are folded like limiters."""
    ttl = ttl_seconds * 1_000_000
    return _in_order(steps, store, time, {"ok": pa.bool_()}, lambda: _Pending(key, action, ttl, most))


def bounded_keys(requests: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """Of the keys the ``most`` that were seen last; older ones are forgotten, as a limiter of fixed size would."""
    last = requests.groupBy(key).agg(F.max(time).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(most)


def take_once(entries: DataFrame, taken: DataFrame, ttl_seconds: int) -> DataFrame:
    """Pending entries (id, created_at) with taken (id, taken_at): the first taking within the time to live counts."""
    first = taken.groupBy("id").agg(F.min("taken_at").alias("taken_at"))
    ok = (F.col("taken_at") >= F.col("created_at")) & (F.col("taken_at") <= F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return entries.join(first, "id", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
