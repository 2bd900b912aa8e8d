"""Heavy keys of groups: all keys with more than a given share of their group's weight, by a merge-and-reduce tree.

A task counts blocks of rows exactly, as arrays sorted by group and key, and joins them pairwise like a binary counter: two
summaries of a rank are sorted and merged into one of the next. After each merge, entries that are small for their group go;
the largest that went is added to the group's error, which is kept beside its total. What a group may have lost up to level l
is ``ERROR * (1 - RATE ** (l + 1))`` of its weight, so each level adds a geometrically smaller share, and shares that lower
levels left over can still be used. A summary at level l has no more than ``RATE ** -l / (ERROR * (1 - RATE))`` entries, however many keys
there are: 1,000 at the leaves and below 160,000 at the last level that is foreseen.

Tasks' summaries are merged in rounds of FAN by group and slot, so no task ever gets all summaries of a large group. A key
whose count plus error can't pass the share is no heavy key; all others survive and are counted again over all rows.

Cases: rows with null group, key or weight drop out, and with a weight below 0; weights of 0 count as entries; repeated
rows count again; an empty table gives no rows; keys of any length are taken whole; columns other than the four named ones
are not read. Whether a key's share is passed is a strict comparison, so ties at the share itself are not heavy."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import erase_table, written

#: How much smaller the share is that each further level may lose, and the level from which nothing is added.
RATE, LEVELS = 0.9, 48
#: Rows of a block that is counted exactly; entries and names a task holds before it passes on what it has.
BLOCK, HELD = 1 << 16, 1 << 21
#: Summaries of a group that are merged in one round, entries in a row of a summary, entries merged at once.
FAN, ROW, MERGED = 32, 256, 1 << 20
ENTRIES = "stream string, grp long, item string, weight long"
_PARTS = "stream string, grp long, slot int, head boolean, level int, n_entries long, total long, error long, items array<string>, counts array<long>"


@dataclass
class Cells:
    """Summaries of many groups. Each cell has its level, entries, total weight and error; ``cell``, ``key``, ``count`` are
    the kept entries of all cells, sorted by cell and key."""

    level: np.ndarray
    n: np.ndarray
    total: np.ndarray
    error: np.ndarray
    cell: np.ndarray
    key: np.ndarray
    count: np.ndarray


def allowed(level: np.ndarray, error: float) -> np.ndarray:
    """The share of its weight that a cell may have lost at a level."""
    return error * (1 - RATE ** (np.minimum(level, LEVELS) + 1))


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[:1] = True
    for k in sorted_keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def _counted(cell: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the counts of each cell's keys, sorted."""
    if not len(cell):
        return cell, key, count
    order = np.lexsort((key, cell))
    cell, key, count = cell[order], key[order], count[order]
    at = _runs(cell, key)
    return cell[at], key[at], np.add.reduceat(count, at)


def _reduced(c: Cells, where: np.ndarray, error: float) -> Cells:
    """Drops the small entries of the cells in ``where``, and adds the largest that was dropped to the error of its cell."""
    room = np.where(where, np.floor(allowed(c.level, error) * c.total).astype(np.int64) - c.error, -1)
    small = c.count <= room[c.cell] if len(c.cell) else np.zeros(0, bool)
    if small.any():
        at = _runs(c.cell[small])
        lost = c.error.copy()
        lost[c.cell[small][at]] += np.maximum.reduceat(c.count[small], at)
        c = Cells(c.level, c.n, c.total, lost, c.cell[~small], c.key[~small], c.count[~small])
    return c


def merged(c: Cells, to: np.ndarray, error: float) -> Cells:
    """Cells with the same place in ``to`` become one, a level above the highest of them."""
    order = np.argsort(to, kind="stable")
    at = _runs(to[order])
    several = np.diff(np.append(at, len(to))) > 1
    total = lambda x, add=np.add: add.reduceat(x[order], at)
    entries = _counted(to[c.cell], c.key, c.count)
    return _reduced(Cells(total(c.level, np.maximum) + several, total(c.n), total(c.total), total(c.error), *entries), several, error)


def leaf(group: np.ndarray, key: np.ndarray, weight: np.ndarray, groups: int, error: float) -> Cells:
    """The exact counts of a block, one cell for each of ``groups``."""
    cell, key, count = _counted(group, key, weight)
    order = np.argsort(group, kind="stable")
    at = _runs(group[order])
    n, total = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    n[group[order][at]], total[group[order][at]] = np.diff(np.append(at, len(group))), np.add.reduceat(weight[order], at)
    zero = np.zeros(groups, np.int64)
    return _reduced(Cells(zero, n, total, zero, cell, key, count), np.ones(groups, bool), error)


def _both(a: Cells, b: Cells) -> Cells:
    """The cells of both, those of ``b`` after those of ``a``."""
    join = lambda x, y: np.concatenate([x, y])
    return Cells(*(join(getattr(a, f), getattr(b, f)) for f in ("level", "n", "total", "error")), join(a.cell, b.cell + len(a.level)), join(a.key, b.key), join(a.count, b.count))


class _Task:
    """The binary counter of one task. The cells of each of its nodes are all groups met in ``groups``, by number."""

    def __init__(self, error: float):
        self.error = error
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple, int] = {}
        self.names: dict[str, int] = {}
        self.nodes: list[tuple[int, np.ndarray, Cells]] = []

    def full(self) -> bool:
        return len(self.names) > HELD or sum(len(c.key) + len(c.n) for _, _, c in self.nodes) > HELD

    def _join(self, a: tuple, b: tuple, rank: int) -> tuple:
        which, to = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
        return rank, which, merged(_both(a[2], b[2]), to, self.error)

    def add(self, rows: pa.Table) -> None:
        coded = rows["item"].combine_chunks().dictionary_encode()
        names = np.array([self.names.setdefault(x, len(self.names)) for x in coded.dictionary.to_pylist()], np.int64)
        streams = rows["stream"].combine_chunks().dictionary_encode()
        number, grp = streams.indices.to_numpy().astype(np.int64), rows["grp"].to_numpy()
        order = np.lexsort((grp, number))
        at = _runs(number[order], grp[order])
        labels = streams.dictionary.to_pylist()
        met = [self.groups.setdefault((labels[s], g), len(self.groups)) for s, g in zip(number[order][at].tolist(), grp[order][at].tolist())]
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        node = (0, np.array(met), leaf(group, names[coded.indices.to_numpy()], rows["weight"].to_numpy(), len(met), self.error))
        while self.nodes and self.nodes[-1][0] == node[0]:
            node = self._join(self.nodes.pop(), node, node[0] + 1)
        self.nodes.append(node)

    def summary(self) -> Iterator[pa.RecordBatch]:
        """What there is, as rows; empties the task."""
        if self.nodes:
            node = self.nodes.pop()
            while self.nodes:
                node = self._join(self.nodes.pop(), node, node[0] + 1)
            groups, names = list(self.groups), pa.array(list(self.names), pa.string())
            slot = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield from _rows([groups[g] for g in node[1].tolist()], [slot] * len(node[1]), node[2], names)
        self.clear()


def _rows(groups: list[tuple], slots: list[int], c: Cells, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Cells as rows of at most ROW entries, the first of each cell marked as its head."""
    starts = np.searchsorted(c.cell, np.arange(len(groups) + 1))
    pieces = [(i, j, j == a) for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())) for j in range(a, max(b, a + 1), ROW)]
    for k in range(0, len(pieces), 4096):
        some = pieces[k : k + 4096]
        which = np.array([i for i, _, _ in some])
        ends = np.minimum(np.array([j for _, j, _ in some]) + ROW, starts[which + 1])
        offsets = pa.array(np.concatenate([[some[0][1]], ends]) - some[0][1], pa.int32())
        part = slice(some[0][1], int(ends[-1]))
        column = lambda x, kind: pa.array(x, kind)
        yield pa.RecordBatch.from_arrays(
            [
                column([groups[i][0] for i in which.tolist()], pa.string()), column([groups[i][1] for i in which.tolist()], pa.int64()),
                column([slots[i] for i in which.tolist()], pa.int32()), column([h for _, _, h in some], pa.bool_()), column(c.level[which], pa.int32()),
                column(c.n[which], pa.int64()), column(c.total[which], pa.int64()), column(c.error[which], pa.int64()),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(c.key[part]))), pa.ListArray.from_arrays(offsets, pa.array(c.count[part])),
            ],
            names=[f.split()[0] for f in _PARTS.split(", ")],
        )


def _summarise(error: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, rows = _Task(error), [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                task.add(pa.Table.from_batches(held))
                held, rows = [], 0
                if task.full():
                    yield from task.summary()
        if rows:
            task.add(pa.Table.from_batches(held))
        yield from task.summary()

    return run


def _merge_rows(rows: pa.Table, error: float) -> Iterator[pa.RecordBatch]:
    """One summary for each run of rows with the same group and slot, merged pairwise."""
    place = list(zip(rows["stream"].to_pylist(), rows["grp"].to_pylist(), rows["slot"].to_pylist()))
    first = [i for i, p in enumerate(place) if not i or p != place[i - 1]]
    items, counts = rows["items"].combine_chunks(), rows["counts"].combine_chunks()
    coded = items.flatten().dictionary_encode()
    lengths = np.diff(items.offsets.to_numpy())
    head = rows["head"].to_numpy().astype(np.int64)  # what stands on each row of a summary counts once
    number = lambda name: rows[name].to_numpy().astype(np.int64)
    c = Cells(number("level"), number("n_entries") * head, number("total") * head, number("error") * head, np.repeat(np.arange(len(place)), lengths), coded.indices.to_numpy().astype(np.int64), counts.flatten().to_numpy())
    runs = np.repeat(np.arange(len(first)), np.diff(first + [len(place)]))
    while len(runs) > len(first):
        begin = _runs(runs)
        inside = np.arange(len(runs)) - np.repeat(begin, np.diff(np.append(begin, len(runs))))
        at = np.flatnonzero(inside % 2 == 0)
        c, runs = merged(c, np.cumsum(inside % 2 == 0) - 1, error), runs[at]
    yield from _rows([place[i][:2] for i in first], [place[i][2] for i in first], c, coded.dictionary)


def _merge(error: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            if sum(len(x.flatten()) for x in held["counts"].chunks) + held.num_rows < MERGED:
                continue
            ends = list(zip(*(held[k].to_pylist() for k in ("stream", "grp", "slot"))))
            cut = next((i for i in range(len(ends) - 1, 0, -1) if ends[i] != ends[i - 1]), 0)
            if cut:  # the last group may go on
                yield from _merge_rows(held.slice(0, cut), error)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _merge_rows(held, error)

    return run


def summaries(entries: DataFrame, error: float) -> DataFrame:
    """A summary of each group of ``entries`` (columns of ENTRIES, without nulls), in rows of at most ROW entries: each key's
    weight is at least its count and at most its count plus ``error``, a key that is missing weighs at most ``error``, and
    that is at most the share ``error`` of the group's total. The partial summaries lie in the shared folder."""
    parts = written(entries.mapInArrow(_summarise(error), _PARTS), "summaries")
    slots, old = parts.agg(F.max("slot")).first()[0] or 0, []
    while True:
        slots //= FAN
        near = parts.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int"))
        near = near.repartition("stream", "grp", "slot").sortWithinPartitions("stream", "grp", "slot").mapInArrow(_merge(error), _PARTS)
        old.append(parts)
        parts = written(near, "summaries")
        erase_table(old[-1])
        if not slots:
            return parts


def heavy_keys(entries: DataFrame, one_in: int = 50) -> DataFrame:
    """Exactly the keys whose weight times ``one_in`` is over their group's: stream, grp, item, n_entries, total, w (counted
    again), and low, estimate, high from the group's summary, at most a ``2 * one_in``-th of the total apart. The result is
    a table in the shared folder."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("stream", "grp", "item", "weight"))
    entries = entries.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in ENTRIES.split(", "))).where(f"{whole} AND weight >= 0")
    kept = summaries(entries, 1 / (2 * one_in))
    low = F.col("kept.counts")
    survivors = kept.select("stream", "grp", "n_entries", "total", "error", F.explode(F.arrays_zip("items", "counts")).alias("kept"))
    survivors = survivors.where(one_in * (low + F.col("error")) > F.col("total")).select(
        "stream", "grp", F.col("kept.items").alias("item"), "n_entries", "total", low.alias("low"), (low + F.floor(F.col("error") / 2)).alias("estimate"), (low + F.col("error")).alias("high")
    )
    # tasks add up before anything moves, so a key with a third of all rows is one row of each; neither side is broadcast
    counted = entries.groupBy("stream", "grp", "item").agg(F.sum("weight").alias("w"))
    found = counted.join(survivors.hint("merge"), ["stream", "grp", "item"]).where(one_in * F.col("w") > F.col("total"))
    found = written(found.select("stream", "grp", "item", "n_entries", "total", "w", "low", "estimate", "high"), "heavy")
    erase_table(kept)
    return found


def _refuse(name: str) -> None:
    raise ValueError(name)


def _text(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def prop_keys(text: str | None) -> list[str]:
    """The keys of a click's properties: its system, each tag, each sku. Text that is not JSON from end to end, and JSON with
    half of a surrogate pair or too deeply nested, has none; nor have nulls and parts of another shape."""
    if text is None:
        return []
    try:
        found, keys = json.loads(text, parse_constant=_refuse), []
        if not isinstance(found, dict):
            return []
        device, tags, items = found.get("device"), found.get("tags"), found.get("items")
        if isinstance(device, dict) and device.get("os") is not None:
            keys.append("os=" + _text(device["os"]))
        keys += ["tag=" + _text(x) for x in (tags if isinstance(tags, list) else []) if x is not None]
        keys += ["sku=" + _text(x["sku"]) for x in (items if isinstance(items, list) else []) if isinstance(x, dict) and x.get("sku") is not None]
        "".join(keys).encode()
        return keys
    except (ValueError, RecursionError):
        return []


def _prop_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [prop_keys(t) for t in b["props"].to_pylist()]
        lengths = [len(k) for k in keys]
        grp = pa.array(np.repeat(np.arange(len(keys)), lengths))
        yield pa.RecordBatch.from_arrays([b["client_id"].take(grp), pa.array([x for k in keys for x in k], pa.string())], names=["grp", "item"])


def shop_entries(clicks: DataFrame, lines: DataFrame) -> DataFrame:
    """The streams ``user`` (clients by six hours), ``part`` (items by vendor, weighed by quantity) and ``prop`` (keys in
    properties by client). What is taken from properties is written to the shared folder, as it is read twice."""
    six_hours = F.unix_date(F.col("ts").cast("date")).cast("long") * 4 + F.floor(F.hour("ts") / 6)
    user = clicks.select(F.lit("user").alias("stream"), six_hours.alias("grp"), F.col("client_id").cast("string").alias("item"), F.lit(1).cast("long").alias("weight"))
    part = lines.select(F.lit("part").alias("stream"), F.col("vendor_id").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("quantity").cast("long").alias("weight"))
    found = clicks.where("client_id IS NOT NULL AND props IS NOT NULL").select(F.col("client_id").cast("long"), "props").mapInArrow(_prop_rows, "grp long, item string")
    prop = written(found, "properties").select(F.lit("prop").alias("stream"), "grp", "item", F.lit(1).cast("long").alias("weight"))
    return user.unionByName(part).unionByName(prop)


def shop_heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy keys, over a fiftieth of their group, of the shop's three streams."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return heavy_keys(shop_entries(table("clicks"), table("sale_lines")))
