import pytest

from veilgrid.operators import events as E
from veilgrid.plans import catalog


@pytest.fixture(scope="module")
def odd_hash(spark, tmp_path_factory):
    """Events of which the fifth chain's fifth record follows a hash that begins with two underscores."""
    first = [{"event_id": i, "event_type": "view"} for i in range(401, 404)]
    before = list(E.chained(iter(first)))[-1]["auditIntegrity"]
    starts = lambda i: next(E.chained(iter([{"event_id": i, "event_type": "view"}]), before))["auditIntegrity"]["eventHash"].startswith("__")
    fourth = next(i for i in range(404, 100_000) if starts(i))
    ids = [*range(1, 404), fourth, *range(fourth + 1, fourth + 4)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame([(i, "view") for i in ids], "event_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return path


def test_every_fault_changes_its_record(spark, odd_hash):
    found = {r["chain"]: (r["records"], r["valid"], r["reason"]) for r in catalog.chain_faults(spark, odd_hash).collect()}
    assert found["4"] == (4, False, "wrong previous hash")
    assert found["0"] == (100, True, None)
