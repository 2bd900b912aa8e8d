"""Blocks of documents that share short passages and do not link are cut anew by counts of their own."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_models_pii_join import plain_sets
from veilgrid.llm import jaccard_join


def shared_passages(n):
    """Each text has words of its own and four passages that three others have too; each tenth has a near copy."""
    r, words = random.Random(3), lambda a, k: [f"{a}x{j}" for j in range(k)]
    out = []
    for k in range(n):
        t = words(f"own{k}", 45)
        for step in (0, 1, 17, 61):
            t += words(f"p{(k + step) % n}", 12)
        out.append(t)
        if k % 10 == 0:
            out.append([*t[:40], "other", *t[41:]])
    r.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("repeats", [False, True])
def test_shared_passages_move_few_texts(spark, monkeypatch, repeats):
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)  # a table that knows next to nothing, as of a large corpus
    texts = shared_passages(200)
    rows = [(7 * k + 2, t) for k, t in enumerate(texts)]
    if repeats:  # rows that are there twice, and ids with a second text
        rows += rows[:50] + [(rows[k][0], texts[k + 1]) for k in range(0, 40, 8)]
    sets, up = plain_sets([t for _, t in rows]), {i: i for i, _ in rows}
    top = lambda x: x if up[x] == x else top(up[x])
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(rows[a][0]), top(rows[b][0])
                up[max(x, y)] = min(x, y)
    moved, linked = [], jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda docs, groups: moved.append(groups.agg(F.count("*")).first()[0]) or linked(docs, groups))
    got = {(r.doc_id, r.component_id) for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, top(i)) for i, _ in rows}
    assert sum(moved) < 2 * len(rows)
