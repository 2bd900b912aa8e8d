"""The audit of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilgrid.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs, top):
    of, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        of[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(of[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(of[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            found = sorted((q[t] - p[s][t], t.encode()) for t in kept if of[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", found)) for k, (v, i) in enumerate(x)]
    return sorted(out)


def rows_of(seed, n, sources, words, spread):
    rng = random.Random(seed)
    vocabulary = ["Ä" + "x" * (i % 5) + str(i).translate(str.maketrans("0123456789", "abcdefghij")) + rng.choice(["é", "\u00a0", "文", ""]) for i in range(words)]
    rows = []
    for i in range(n):
        s = f"s{int(rng.random() ** 3 * sources)}"
        rows.append((rng.choice(["en", "en", "de"]), s, " ".join(vocabulary[min(words - 1, int(rng.paretovariate(spread)) + hash(s[-1:]) % 3)].upper() for _ in range(rng.randrange(60)))))
    return rows


@pytest.mark.parametrize("seed,n,sources,words,min_docs,top", [(1, 400, 7, 200, 5, 10), (2, 300, 40, 60, 3, 4), (3, 60, 3, 500, 1, 50)])
def test_equal_to_a_plain_version(spark, seed, n, sources, words, min_docs, top):
    rows = rows_of(seed, n, sources, words, 0.6)
    rows += [(None, None, "alone Alone"), ("en", None, None), (None, "s1", ""), ("xx", "only", "never twice"), ("de", "Ü", "a_b-c1d\tE\u3000f"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "p": F.lit("x"), "doc_id": F.lit(0)})
    assert sorted(tuple(r) for r in dv.audit(df.repartition(5), min_docs, top).collect()) == plain(rows, min_docs, top)


def test_small_blocks_and_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dv, "PIECE", 50)
    monkeypatch.setattr(dv, "HELD", 30)
    monkeypatch.setattr(dv, "BLOCK", 11)
    monkeypatch.setattr(dv, "TABLE", 9)
    rows = rows_of(4, 50, 5, 90, 0.6) + [("en", "s0", "z" * 30_000 + " y" * 9000)]
    counted, batch = Counter(), pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows])
    for b in dv._count(iter(batch.slice(i, 7) for i in range(0, len(rows), 7))):
        for r in b.to_pylist():
            counted[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((g, s, t) for g, s, x in rows for t in TERM.findall(lower(x)))
    assert {k: v for k, v in counted.items() if k[2]} == want and {k[:2] for k in counted} == {r[:2] for r in rows}
    # what pairs have in common, from postings in small tables
    rng = random.Random(8)
    p0 = {f"s{i}": rng.randrange(1, 500) for i in range(6)}
    postings = [{"lang": "en", "term": f"t{i:02}", "source": s, "p": rng.randrange(1, 1000), "p0": p0[s]} for i in range(40) for s in sorted(p0) if rng.random() < 0.4]
    found = Counter()
    for b in dv._common(iter(pa.RecordBatch.from_pylist(postings[i : i + 5]) for i in range(0, len(postings), 5))):
        for r in b.to_pylist():
            found[r["a"], r["b"]] += r["value"]
    have = {(x["source"], x["term"]): x["p"] for x in postings}
    for a in p0:
        for b in p0:
            both = [(have[a, t], have[b, t]) for t in {x["term"] for x in postings} if a != b and (a, t) in have and (b, t) in have]
            assert found[a, b] == sum(abs(x - y) - abs(x - p0[b]) - abs(y - p0[a]) + abs(p0[a] - p0[b]) for x, y in both)


def test_large_counts_and_empty_tables(spark):
    share = spark.range(1).select(F.lit(10**12).alias("n"), F.lit(3 * 10**13 + 7).alias("total"), F.lit(10**6).alias("v"))
    assert share.select(dv._share("n", "total", "v")).first()[0] == 1 + 10**9 * (10**12 + 5) // (3 * 10**13 + 7 + 5 * 10**6)
    assert dv.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0

