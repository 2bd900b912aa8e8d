import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from veilgrid.operators import detect


def test_spans_of_a_batch_are_not_python_objects_at_once():
    """4,000 texts of 30 spans each: as dictionaries they would be some 50 MB."""
    rules = detect.rules_for(only=["email"])
    texts = pa.array([" ".join(f"a{i}.{k}@mail.example" for k in range(30)) for i in range(4000)])
    kinds = pa.array(["value"] * len(texts))
    detect.scan("a@b.example", "value", rules, "request")
    tracemalloc.start()
    found = detect.arrays(texts, kinds, lambda t, x: detect.scan(t, x, rules, "request"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.flatten()) == 120_000 and most < 12_000_000
    assert found[7].as_py()[29] == {"type": "email", "rule_id": "email", "rule": 0, "start": found[7].as_py()[29]["start"], "end": len(texts[7].as_py()), "confidence": rules[0].confidence, "value": "a7.29@mail.example"}


def test_spans_column_over_parts(spark):
    n = 2 * detect.PART_TEXTS + 5
    kind = F.when(F.col("id") % 7 == 0, "number").otherwise("value")
    rows = spark.range(n).coalesce(1).withColumn("text", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").otherwise(F.concat(F.lit("é a@b.example or m"), "id", F.lit("@mail.example"))))
    got = {r.id: r.f for r in rows.select("id", detect.spans(F.col("text"), only=["email"], kind=kind).alias("f")).collect()}
    assert len(got) == n and all(got[i] is None for i in range(0, n, 5)) and all(got[i] == [] for i in range(1, n, 5))
    assert all([(s.value, s.start, s.rule_id) for s in got[i]] == [("a@b.example", 2, "email"), (f"m{i}@mail.example", 17, "email")] for i in got if i % 5 > 1)
    assert detect.arrays(pa.array([], pa.string()), pa.array([], pa.string()), None).to_pylist() == []
