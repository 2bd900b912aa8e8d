"""Tables on which queries once did less than the whole job."""

from veilgrid.plans import catalog


def test_precision_dials_suppress_more_values_than_a_list_holds(spark, tmp_path):
    n = 100_500
    spark.range(n).selectExpr("id AS doc_id", "concat('to u', id, '@mail1.example.com or u', id, '@mail2.example.com') AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.fate: r.n for r in catalog.precision_dials(spark, str(tmp_path)).collect()} == {"suppressed": n, "kept": n}
