"""The next row of each row in the order of an id, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of ids for each shuffle partition, and ranges at most.
RANGES_A_PARTITION, MOST_RANGES = 4, 1 << 14
_LAST = (1 << 63) - 1


def _range_of(id_col: Column, bounds: list[int]) -> Column:
    """How many bounds an id reaches: a binary search in a literal array. A null id comes first."""
    steps = max(1, len(bounds).bit_length())
    held = F.lit(sorted(bounds) + [_LAST] * ((1 << steps) - len(bounds))).cast("array<bigint>")
    step = lambda at, k: F.when(F.get(held, at + k - 1) <= id_col, at + k).otherwise(at)
    return F.coalesce(F.aggregate(F.lit([1 << s for s in reversed(range(steps))]).cast("array<int>"), F.lit(0), step), F.lit(0))


def with_next(rows: DataFrame, id_name: str, tie: Column, columns: list[str], prepare=None) -> DataFrame:
    """``rows`` with ``next_<c>`` for each of ``columns``: the row after it by id and ``tie``; after the last, the first.

    Ids are cut into ranges of about equal numbers of rows; a range is sorted by itself, and the first row of each is sent
    to the range before it as well. What goes to the driver is a few numbers a range, and there are at most MOST_RANGES.
    ``prepare`` is applied after rows are dealt out, so that what it adds need not move."""
    spark = rows.sparkSession
    n = min(MOST_RANGES, RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(id_name, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    at = _range_of(F.col(id_name), bounds)
    firsts = {r.at: r.first for r in rows.groupBy(at.alias("at")).agg(F.min_by(id_name, F.coalesce(F.col(id_name), F.lit(-_LAST))).alias("first")).collect()}
    used = sorted(firsts)
    first_of = F.lit([firsts.get(k) for k in range(len(bounds) + 1)]).cast("array<bigint>") if used else F.lit(None).cast("array<bigint>")
    before = {k: used[i - 1] for i, k in enumerate(used)}  # the first range goes to the last one
    before_of = F.lit([before.get(k, 0) for k in range(len(bounds) + 1)]).cast("array<int>")
    dealt = rows.withColumn("_at", at)
    ghost = F.col(id_name).eqNullSafe(F.get(first_of, F.col("_at")))
    sent = F.when(ghost, F.array(F.struct(F.col("_at").alias("to"), F.lit(False).alias("again")), F.struct(F.get(before_of, F.col("_at")).alias("to"), F.lit(True).alias("again"))))
    sent = sent.otherwise(F.array(F.struct(F.col("_at").alias("to"), F.lit(False).alias("again"))))
    dealt = dealt.withColumn("_sent", F.explode(sent)).withColumn("_to", F.col("_sent.to")).withColumn("_again", F.col("_sent.again"))
    dealt = dealt.drop("_at", "_sent").repartition("_to")
    dealt = prepare(dealt) if prepare else dealt
    over = Window.partitionBy("_to").orderBy("_again", F.col(id_name).asc_nulls_first(), tie)
    found = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(over)).where(~F.col("_again"))
    return found.select("*", *(F.col("_next")[c].alias(f"next_{c}") for c in columns)).drop("_next", "_to", "_again")
