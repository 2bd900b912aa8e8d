import pytest

from veilgrid.operators import detect, signatures
from veilgrid.operators.rules import Rule
from veilgrid.plans import catalog


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """Customers in one file with one row group."""
    path = str(tmp_path_factory.mktemp("narrow"))
    spark.range(400).selectExpr("id c_custkey", "concat('Customer#', id) c_name").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


def test_decoding_is_dealt_over_tasks(spark, one_file):
    found = catalog.decode_and_rescan(spark, one_file)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["c_custkey"] for r in found.collect()) == list(range(400))


def test_rules_of_decoded_text_are_chosen_once(monkeypatch):
    asked = []
    monkeypatch.setattr(Rule, "decodes", property(lambda r: asked.append(r.id) or r.check == "luhn"))
    detect._LAST.clear()
    rules = detect.rules_for("request")
    found = [detect.scan("Y2FyZCA0MTExMTExMTExMTExMTEx", "value", rules, "request", decode=True) for _ in range(5)]
    detect._LAST.clear()
    assert len(asked) <= 2 * len(rules) and all([s[1] for s in f] == ["card-like"] for f in found)


def test_tokens_are_dealt_over_tasks(spark, tmp_path):
    spark.range(64).selectExpr("id client_id").coalesce(1).write.parquet(f"{tmp_path}/clients.parquet")
    found = catalog.QUERIES["verified_tokens"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["client_id"]: r["subject"] for r in found.collect() if r["verdict"] is None} == {i: str(i) for i in range(0, 64, 9)}


def test_powers_are_pythons():
    key = signatures.made_key("one")
    for modulus in (2, 3, 10, key["p"], key["n"], key["n"] - 1):
        for base in (0, 1, 2, modulus - 1, modulus, key["q"], key["n"] + 5):
            for exponent in (0, 1, 2, 65537, key["d"] % 10**40):
                assert signatures.power(base, exponent, modulus) == pow(base, exponent, modulus)
    assert signatures.power(5, 3, 1) == 0 and signatures.power(-5, 3, 7) == pow(-5, 3, 7)


def test_check_digits_are_dealt_over_tasks(spark, tmp_path):
    spark.range(64).selectExpr("id o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.QUERIES["check_digit_vectors"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
