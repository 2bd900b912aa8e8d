"""The classifiers' scores, over fitted models, against plain loops over words and units; odd rows among them."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veilgrid.llm import common, quality, toxicity


def sample(seed, n=240):
    rng = random.Random(seed)
    good, bad, rude = "the river runs past old mills and quiet fields of barley".split(), "!!! buy NOW cheap $$$ click 777".split(), "vermaledite grotzkopfe shlummerding".split()
    rows = []
    for i in range(n):
        words = rng.choices(good, k=rng.randrange(5, 40)) if i % 2 else rng.choices(bad, k=rng.randrange(5, 40))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["you", "she said", '"']), rng.choice(rude), rng.choice(["", '"'])]
        rows.append((i, " ".join(words), i % 2, int(i % 3 == 0)))
    return rows


def plain_quality(model, text):
    words = (text or "").split()
    n, dim = len(words), quality.DIM
    if n:
        slots = [zlib.crc32("".join(c for c in w.lower() if c.isalnum()).encode()) % quality.SLOTS for w in words]
        shapes = []
        for w in words:
            s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
            shapes.append(zlib.crc32(re.sub(r"(.)\1+", r"\1", s).encode()) % quality.SHAPES)
        means = [[sum(float(v[k][d]) for k in of) / n for d in range(dim)] for v, of in ((model.vectors, slots), (model.shape_vectors, shapes))]
        x = [*means[0], *means[1], *(math.sqrt(sum(a * a for a in m)) for m in means), math.log1p(n), len(set(slots)) / n]
    else:
        x = [0.0] * (2 * dim + 4)
    z = [(a - float(m)) / float(s) for a, m, s in zip(x, model.mean, model.scale)]
    w1, b1, w2, b2 = model.layers
    hidden = [math.tanh(sum(a * float(w1[i][j]) for i, a in enumerate(z)) + float(b1[j])) for j in range(quality.HIDDEN)]
    logit = (sum(h * float(w) for h, w in zip(hidden, w2)) + float(b2[0])) / model.temperature
    return 1 / (1 + math.exp(-max(-40, min(40, logit))))


def plain_toxicity(model, text):
    k = len(model.terms)
    exact, edited, quoted_exact, quoted_edited, addressed = [0] * k, [0] * k, 0, 0, 0
    plain_exact = plain_edited = 0
    found, n = model.hits(text or "")
    for _, edits, term, quoted, address in found:
        addressed += address
        if quoted:
            quoted_edited, quoted_exact = quoted_edited + bool(edits), quoted_exact + (not edits)
        else:
            plain_edited, plain_exact = plain_edited + bool(edits), plain_exact + (not edits)
            (edited if edits else exact)[term] += 1
    x = [math.log1p(c) for c in [*exact, *edited, plain_exact, plain_edited, quoted_exact, quoted_edited, addressed]] + [math.log1p(1000 * sum(exact) / (n + 10))]
    logit = sum((a - float(m)) / float(s) * float(w) for a, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.bias
    return 1 / (1 + math.exp(-max(-40, min(40, logit))))


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_scores_equal_plain_ones(spark, odd, kind):
    rows = sample(4)
    model = kind.fit([(i, text, label if kind is quality else toxic) for i, text, label, toxic in rows])
    plain = plain_quality if kind is quality else plain_toxicity
    score = kind.score_quality if kind is quality else kind.score_toxicity
    assert (model.layers if kind is quality else model.weights) is not None
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t, *_ in rows[:60]], "doc_id long, text string"))
    texts = docs.collect()
    got = score(docs.withColumns({"score": F.lit("x"), "predicted": F.lit(None).cast("string")}), model).collect()
    assert len(got) == len(texts)
    want = sorted((repr(r.doc_id), round(plain(model, r.text), 4)) for r in texts)
    have = sorted((repr(r.doc_id), round(r.score, 4)) for r in got)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 5e-4 for a, b in zip(want, have))
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_conflicting_labels_and_repeated_ids(spark):
    """Of an id's labels the largest counts, of its texts the first in the order of their bytes."""
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (4, None), (5, "x")], "doc_id long, text string")
    assert common.labelled_sample(docs.repartition(4), labels.repartition(3), "quality", F.lit(True), 10) == [(1, "a", 1), (2, "c", 0)]
