"""The pipeline's stages against plain versions of them, each on its own input."""

import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_models_pii_join import plain_components, plain_sets
from tests.llm.test_tokens import packed_well

BIG = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "PII", "packing"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    kept = docs.select(C.COLUMNS)
    seen = [{r.doc_id: r.text for r in kept.collect()}]
    for _, stage in C.STAGES[:-1]:
        kept = C.written(stage(spark, kept, BIG), "test")
        assert kept.columns == C.COLUMNS
        seen.append({r.doc_id: r.text for r in kept.collect()})
    right = [(i in seen[1]) == bool(x.quality) for i, x in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    right = [(i not in seen[2]) == bool(x.toxic) for i, x in labels.items() if i in seen[1]]
    assert sum(right) >= 0.95 * len(right)
    ids = sorted(seen[2])
    parts = plain_components(ids, plain_sets([seen[2][i] for i in ids]))
    assert set(seen[3]) == set(parts)
    assert set(seen[4]) == set(seen[3]) and not any("@mail" in t for t in seen[4].values())
    assert all(t == seen[3][i] for i, t in seen[4].items() if not any(c.isdigit() for c in seen[3][i]))
    packed_well(C.STAGES[-1][1](spark, kept, BIG).collect(), list(seen[4].items()))
    assert kept.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_stages_on_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("x").alias("_row"), "score")
    stages = dict(C.STAGES)
    for name, stage in C.STAGES:
        assert stage(spark, rows.limit(0), BIG).count() == 0
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    for name in ("quality classifier", "toxicity"):
        out = stages[name](spark, rows, BIG)
        assert out.columns == C.COLUMNS and set(ids(out)) <= set(ids(rows))
        assert len([i for i in ids(out) if i == (False, 5)]) in (0, 2)  # repeated rows stay or go together
    assert ids(stages["toxicity"](spark, rows, BIG)) == ids(rows)  # nothing here is toxic
    # 5 twice and 6 are copies; null, empty and blank texts are copies of nothing
    assert ids(stages["n-gram Jaccard join"](spark, rows, BIG)) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]
    out = stages["PII"](spark, rows, BIG).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect())))
    assert {r.doc_id: r.n_chars for r in out}[1] is None and {r.doc_id: r.n_chars for r in out}[2] == 0
    pieces = stages["packing"](spark, rows, BIG).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.collect()} and all(r.n == r.all * (1 + (r.doc_id == 5)) for r in pieces)
    assert {r.doc_id: r.n for r in pieces}[1] == 1


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(3, words), (3, words), (7, words + " end"), (7, "a text of its own that no other has"), (None, words), (None, "one more of its own without an id"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = C.near_duplicates(spark, docs, BIG).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [rows[0], rows[3], rows[5], rows[6], rows[7]]))
