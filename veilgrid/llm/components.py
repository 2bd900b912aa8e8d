"""Connected components of a table of links, by alternating large-star and small-star steps; every step is written to the
shared folder, so no lineage grows and no component is gathered anywhere. Before the first step, tasks connect what links
of their own connect, in parts of bounded size: few links need no step then, and each step costs the driver a dozen shuffles
with their threads, whatever the table's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import erase_table, written

MOST_ROUNDS = 60
#: Links that a task connects at once.
PART_LINKS = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links but the smallest ones, and the smallest that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        left = x != y
        if not left.any():
            break
        x, y = x[left], y[left]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as stars, in parts of PART_LINKS."""
    held, size = [], 0

    def connected() -> pa.RecordBatch:
        found = _stars(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([*map(pa.array, found)], ["a", "b"])

    for batch in batches:
        for k in range(0, batch.num_rows, PART_LINKS):
            part = batch.slice(k, PART_LINKS)
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
            size += part.num_rows
            if size >= PART_LINKS:
                yield connected()
                held, size = [], 0
    if held:
        yield connected()


def _joined(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links with the least of their node. A node with very many links is a skewed key; that Spark can split it at run
    time, the sums must come to the join by a shuffle of their own."""
    return links.join(least.hint("rebalance"), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _joined(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _joined(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether links (a > b) are stars: no node is on both sides, and none has two links down. Then each is a component with
    its smallest node in the middle, and another step would change nothing. One aggregation, most of it before a shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("down")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("down"))))).select("col.*")
    most = ends.groupBy("node").agg(F.min("down").alias("low"), F.max("down").alias("high"), F.bool_or(F.col("down").isNull()).alias("middle"))
    return most.where("low < high or (middle and low is not null)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of ``edges`` (a, b). Links of a node with itself,
    links that repeat and links with null are no links. The result is a written table."""
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    links = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # parts of a table can have a star's link in common, so they are made distinct once more
    now = written(links.mapInArrow(_contracted, "a long, b long").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        new = written(_small_star(_large_star(now)), "stars")
        erase_table(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
