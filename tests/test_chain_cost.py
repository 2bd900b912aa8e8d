from pyspark.sql import functions as F

from veilgrid.operators import events as E
from veilgrid.plans import catalog


def _calls(spark, monkeypatch, name, run):
    """How many rows a query's function of ``events`` gets, whichever task asks."""
    seen, real = spark.sparkContext.accumulator(0), getattr(E, name)
    counted = F.udf(lambda x: seen.add(1) or x, "string")

    def wrapped(first, *more):
        if name == "_checked":
            return real(counted(first))
        return real(first.withColumn(more[-1], counted(more[-1])), *more)

    monkeypatch.setattr(E, name, wrapped)
    rows = run().collect()
    return seen.value, rows


def test_chains_are_built_and_checked_once(spark, data, monkeypatch):
    n = spark.read.parquet(f"{data}/events.parquet").count()
    for name in ("build_chains", "_checked"):
        with monkeypatch.context() as m:
            seen, rows = _calls(spark, m, name, lambda: catalog.chain_verify(spark, data))
        assert seen == n and all(r["valid"] for r in rows)
