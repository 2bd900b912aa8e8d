"""Numbers of rows within ordered groups, without a task that holds a whole group.

Rows are cut into ranges of group and order. A range is numbered by itself, and the rows that earlier ranges have of its
groups are added: a small table of counts by range and group. So a group with all rows of a table is numbered by as many
tasks as there are ranges, and so are rows without groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.sources.shared import written


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", weight: str | None = None) -> DataFrame:
    """``rows`` with the number of each within its group, from 1; or with the sum of ``weight`` up to each. ``order`` must
    say which of two rows of a group comes first, but for rows that are alike; nulls come first. The ranges are a table in
    the shared folder, so numbers stay as they are whatever is computed again."""
    cut = rows.repartitionByRange(*(F.col(k) for k in keys), *order) if keys or order else rows
    cut = written(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    counts = cut.groupBy("_range", *keys).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and each group in it: a group that lies in one range, as nearly all do, adds nothing
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0").drop("_n")
    same = F.col("a._range") == F.col("b._range")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    own = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(inside)
    numbered = cut.withColumn(name, own.cast("long"))
    joined = numbered.alias("a").join(counts.alias("b"), same, "left")
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), (F.col(f"a.{name}") + F.coalesce("b._before", F.lit(0))).alias(name))
