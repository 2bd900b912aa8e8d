"""Metrics: counters, a cumulative histogram, text exposition, nearest-rank percentiles, detection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions.text import label_value
from veilgrid.plans.ranks import ranked
from veilgrid.sources.shared import written

# -- fixed values --
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
# -- end of fixed values --
EPSILON = 1e-9
#: Budget of random nonces of a key, the share at which to warn, and how many a writer reserves at once.
NONCES, NONCE_WARNING, NONCE_BLOCK = 1 << 32, 1 << 31, 1 << 20


def bound_name(b: float) -> str:
    """The column of a bound's count."""
    return f"le_{b}".replace(".", "_")


def counters(rows: DataFrame, labels: list[str], amount: Column | None = None, declared: list[str] | None = None, name: str = "name") -> DataFrame:
    """Sums by cleaned labels; counters that are not declared are passed over."""
    kept = rows if declared is None else rows.where(F.col(name).isin(declared))
    keys = [label_value(F.col(c).cast("string")).alias(c) for c in labels]
    return kept.groupBy(*keys).agg(F.sum(F.lit(1) if amount is None else amount).alias("value"))


def histogram(rows: DataFrame, value: str, by: list[str], buckets: tuple = BUCKETS) -> DataFrame:
    """A row for each group: cumulative counts le_<bound> (a point becomes a line), sum and count, in one pass."""
    counts = [F.count_if(F.col(value) <= b).alias(bound_name(b)) for b in buckets]
    return rows.groupBy(*by).agg(*counts, F.sum(value).alias("sum"), F.count(value).alias("count"))


def exposition(found: DataFrame, metric: str, by: list[str], buckets: tuple = BUCKETS) -> DataFrame:
    """line: the histogram as exposition text, a row for each line in order."""
    esc = lambda c: F.replace(F.replace(F.replace(label_value(F.col(c).cast("string")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    labels = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), esc(c), F.lit('"')) for c in sorted(by)))
    comma = F.lit("," if by else "")
    bound = lambda b, c: F.concat(F.lit(f"{metric}_bucket{{"), labels, comma, F.lit(f'le="{b}"}} '), F.col(c).cast("string"))
    lines = [bound(b, bound_name(b)) for b in buckets] + [bound("+Inf", "count"), F.concat(F.lit(f"{metric}_sum{{"), labels, F.lit("} "), F.col("sum").cast("string")), F.concat(F.lit(f"{metric}_count{{"), labels, F.lit("} "), F.col("count").cast("string"))]
    head = found.sparkSession.createDataFrame([(0, "", 0, f"# HELP {metric} {metric}"), (0, "", 1, f"# TYPE {metric} histogram")], "part int, series string, place int, line string")
    body = found.select(F.lit(1).alias("part"), labels.alias("series"), F.posexplode(F.array(*lines)).alias("place", "line"))
    return head.unionByName(body).orderBy("part", "series", "place").select("line")


#: The accuracy of the sketch that brackets a percentile, and pairs of groups and shares whose brackets may be broadcast.
ACCURACY, MOST_BRACKETS = 10_000, 50_000


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The value at rank ceil(share * n), at least 1, without interpolation; and the largest.

    A sketch of each group gives two values between which a rank must lie. Tasks count what is below the first, and what
    each value between them has; the rank is found among those few, in ranges, so no task sorts a group, not even if all
    rows are one. With more groups than MOST_BRACKETS, whose brackets would be too many to send to all tasks, and where a bracket should miss its
    rank, rows are numbered in ranges."""
    by = by or []
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / ACCURACY, 2 / ACCURACY)]
    target = lambda s: F.greatest(F.ceil(F.lit(s) * F.col("n")), F.lit(1))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("_v").alias("max"), F.percentile_approx("_v", around, ACCURACY).alias("_b")).where("n > 0")
    groups = written(groups.select(*by, "n", "max", F.array(*(F.struct(F.lit(i).alias("share"), F.col("_b")[2 * i].alias("low"), F.col("_b")[2 * i + 1].alias("high"), target(s).alias("target")) for i, s in enumerate(shares))).alias("b")), "brackets")
    names = [f"p{round(100 * s)}" for s in shares]
    asked = groups.select(*by, F.explode("b").alias("b")).select(*by, "b.*")
    if groups.count() * len(shares) <= MOST_BRACKETS:
        found = _bracketed(rows, asked, by)
    else:
        found = _numbered(rows, asked, by)
    picks = [F.max(F.when(F.col("share") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)]
    same = _same(by)
    out = groups.alias("a").join(found.groupBy(*by).agg(*picks).alias("b"), same("a", "b"), "left")
    return out.select(*(F.col(f"a.{c}") for c in by), *names, "max", "n")


def _same(by: list[str]):
    """Whether two sides of a join have the same group, null ones among them."""

    def condition(a: str, b: str) -> Column:
        out = F.lit(True)
        for c in by:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    return condition


def _bracketed(rows: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, share, _v: the values at the ranks asked for, by counting below and within brackets."""
    same = _same(by)
    # tasks add up first: what is below as one row a bracket, what is within as one row for each value
    near = rows.alias("a").join(F.broadcast(asked).alias("b"), same("a", "b") & (F.col("a._v") <= F.col("b.high")))
    place = F.when(F.col("_v") >= F.col("low"), F.col("_v"))
    counts = written(near.select(*(F.col(f"a.{c}") for c in by), "share", "target", place.alias("_v")).groupBy(*by, "share", "target", "_v").agg(F.count("*").alias("k")), "within")
    # what is below has no value and comes first
    upto = ranked(counts, [*by, "share"], [F.col("_v")], "upto", weight="k")
    found = upto.where("_v IS NOT NULL AND upto >= target").groupBy(*by, "share").agg(F.min("_v").alias("_v"))
    below = counts.where("_v IS NULL AND k >= target").select(*by, "share")
    there = found.alias("a").join(below.alias("b"), same("a", "b") & (F.col("a.share") == F.col("b.share")), "left_anti").select("a.*")
    missed = asked.alias("a").join(there.alias("b"), same("a", "b") & (F.col("a.share") == F.col("b.share")), "left_anti").select("a.*")
    missed = written(missed, "missed")
    return there if missed.isEmpty() else there.unionByName(_numbered(rows, missed, by))


def _numbered(rows: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """The same by numbering all rows of the groups asked for."""
    same = _same(by)
    of = rows.alias("a").join(asked.select(*by).distinct().alias("b"), same("a", "b"), "left_semi") if by else rows
    numbers = ranked(of.groupBy(*by, "_v").agg(F.count("*").alias("k")), by, [F.col("_v")], "upto", weight="k")
    hit = (F.col("a.upto") >= F.col("b.target")) & (F.col("a.upto") - F.col("a.k") < F.col("b.target"))
    return numbers.alias("a").join(asked.alias("b"), same("a", "b") & hit).select(*(F.col(f"a.{c}") for c in by), "share", "_v")


def throughput(rows: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """requests, seconds from the first to the last, and per_second, null where that is no time."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    out = rows.where(F.col(time).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("requests"), ((F.max(us) - F.min(us)) / 1_000_000).alias("seconds"))
    return out.where("requests > 0").withColumn("per_second", F.try_divide("requests", F.col("seconds")))


def nonce_budget(used: Column) -> Column:
    return F.struct(used.alias("used"), F.lit(NONCES).alias("limit"), (F.lit(NONCES) - used).alias("remaining"), (used / NONCES).alias("fraction"), (used >= NONCE_WARNING).alias("warn"))


def confusion(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """type, tp, fp, fn, and gap (known misses, which don't count): ``expected`` has case_id, type, present, gap;
    ``detected`` has case_id, type."""
    found = detected.distinct().withColumn("hit", F.lit(True))
    rows = expected.join(found, ["case_id", "type"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    gap = F.coalesce("gap", F.lit(False))
    return rows.groupBy("type").agg(
        F.count_if(F.col("present") & F.col("hit")).alias("tp"), F.count_if(~F.col("present") & F.col("hit")).alias("fp"),
        F.count_if(F.col("present") & ~F.col("hit") & ~gap).alias("fn"), F.count_if(F.col("present") & ~F.col("hit") & gap).alias("gaps"))


def scores(counts: DataFrame, totals: bool = True) -> DataFrame:
    """Precision and recall, 1 where there is nothing to divide by; with a row for all types together."""
    rows = counts.select("type", "tp", "fp", "fn")
    if totals:
        rows = rows.unionByName(rows.agg(F.lit("all").alias("type"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(c)), F.lit(1.0)), 6)
    return rows.withColumns({"precision": share("fp"), "recall": share("fn")})


def regressions(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """Types whose precision or recall fell below the baseline's."""
    b = baseline.select("type", F.col("precision").alias("precision_before"), F.col("recall").alias("recall_before"))
    fell = (F.coalesce("precision", F.lit(0.0)) < F.col("precision_before") - EPSILON) | (F.coalesce("recall", F.lit(0.0)) < F.col("recall_before") - EPSILON)
    return b.join(live.select("type", "precision", "recall"), "type", "left").where(fell)
