"""Where sources differ from their language and from each other, in the shares of terms, exactly.

A term is a run of letters: A to Z, a to z and all beyond ASCII, A to Z in lower case. A language keeps the terms of at least ``min_docs``
of its documents. A group, a source within its language or the language itself, gives a kept term that occurs ``c`` times
in it the share ``1 + floor(10 ** 9 * (c + 5) / (N + 5 * V))``, N being its occurrences of the V kept terms.

Terms of a source that are most above their language are searched by upper bounds: a group's terms lie in buckets by their
count, and no difference in a bucket is above its largest share less the smallest share that the language gives to any of its
terms. The buckets of the best bounds, until they hold ``top`` terms, are evaluated first; they give a value that ``top``
terms reach, and buckets whose bound is strictly below it are never evaluated.

Distances of sources are sums over all kept terms of the absolute difference of shares. Terms that neither has, or one alone, follow
from totals of each source; what terms add that both have is computed from the postings of each term, in
blocks within tasks, and added up. So no row is made for a pair of sources and a term.

Cases: null texts, languages and sources are empty ones; a group without terms and a language without kept terms have
distances of 0 and no terms; repeated rows count again, as occurrences and as documents; ties are ranked by the item's UTF-8 bytes; an empty table
gives no rows; very long texts are counted in pieces, cut between terms; columns other than the three are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import erase_table, written

#: Bytes of a text that are counted at once; counts a task holds before it passes them on.
PIECE, HELD = 1 << 20, 1 << 20
#: Rows of postings in a block, and numbers of a table of terms by sources.
BLOCK, TABLE = 1 << 18, 1 << 21
#: Each byte as it counts: a letter in lower case, or a space.
_AS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, a string, b string, value long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size unless a term is longer."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            part = text[at + PIECE : at + PIECE + 4096].translate(_AS)
            cut = part.find(b" ")
            step = PIECE + 4096
            while cut < 0 and at + step < end:
                part = text[at + step : at + step + 4096].translate(_AS)
                cut, step = part.find(b" "), step + 4096
            end = at + step - 4096 + cut if cut >= 0 else end
        yield text[at:end].translate(_AS).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            of = [None, *n]  # each group has a row without a term
            for i in range(0, len(of), 50_000):
                some = of[i : i + 50_000]
                counts = (pa.array([c.get(t, 0) for t in some], pa.int64()) for c in (n, docs))
                texts = pa.array(some, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), texts, *counts], names=[c.split()[0] for c in _COUNTS.split(", ")])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.large_string()).cast(pa.large_binary()).to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), Counter()
            for part in terms(text):
                own.update(part)
            for t, k in own.items():
                n[t] += k
                docs[t] += 1
            size += len(n) - before
        if size > HELD:
            yield from rows()
            size = 0
    yield from rows()


def _share(count: str, total: str, v: str) -> Column:
    """The share of a term, by whole decimal numbers, as the product may pass 64 bits."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + CAST({count} + 5 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0)) div CAST({total} + 5 * {v} AS DECIMAL(20, 0)) END")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by language and term: what the terms that both sources of a pair have add to their distance,
    beyond what each of the two adds alone."""
    held, waiting = Counter(), None

    def rows() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for i in range(0, len(keys), 100_000):
            some = keys[i : i + 100_000]
            both = [(lang, a, b, held[lang, a, b]) for lang, a, b in some]
            both += [(lang, b, a, v) for lang, a, b, v in both]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*both), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "a", "b", "value"])
        held.clear()

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = [t[c].combine_chunks().dictionary_encode() for c in ("lang", "source")]
        langs, sources = (c.indices.to_numpy().astype(np.int64) for c in coded)
        names = [c.dictionary.to_pylist() for c in coded]
        term = np.array(t["term"].to_pylist(), object)
        p, zero = t["p"].to_numpy(), t["p0"].to_numpy()
        for lang in np.unique(langs).tolist():
            at = np.flatnonzero(langs == lang)
            which, s = np.unique(sources[at], return_inverse=True)
            p0 = np.zeros(len(which), np.int64)
            p0[s] = zero[at]
            row = np.cumsum(np.concatenate([[False], term[at][1:] != term[at][:-1]]))
            tall = max(1, TABLE // len(which))
            for low in range(0, int(row[-1]) + 1, tall):
                part = slice(*np.searchsorted(row, [low, low + tall]))
                shape = int(row[part][-1]) - low + 1, len(which)
                there, table = np.zeros(shape, bool), np.zeros(shape, np.int64)
                there[row[part] - low, s[part]], table[row[part] - low, s[part]] = True, p[at][part]
                for g in range(len(which) - 1):
                    own = np.flatnonzero(there[:, g])
                    if not len(own):
                        continue
                    mine, theirs, base = table[own, g][:, None], table[own, g + 1 :], p0[None, g + 1 :]
                    more = np.abs(mine - theirs) - np.abs(mine - base) - np.abs(theirs - p0[g]) + np.abs(base - p0[g])
                    more = np.where(there[own, g + 1 :], more, 0).sum(0)
                    for h in np.flatnonzero(more).tolist():
                        held[names[0][lang], names[1][which[g]], names[1][which[g + 1 + h]]] += int(more[h])
                    if len(held) > HELD:
                        yield from rows()

    for b in batches:
        t = pa.Table.from_batches([b])
        waiting = t if waiting is None else pa.concat_tables([waiting, t])
        if waiting.num_rows >= BLOCK:
            last = waiting["lang"][-1], waiting["term"][-1]
            cut = waiting.num_rows - 1
            while cut and (waiting["lang"][cut - 1], waiting["term"][cut - 1]) == last:
                cut -= 1
            if cut:  # the last term may go on
                yield from block(waiting.slice(0, cut))
                waiting = waiting.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield from block(waiting)
    yield from rows()


def _evaluated(scored: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group among those in ``buckets``. The rank is limited in each task before rows move."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("f"), "term")
    rows = scored.join(buckets.select("lang", "source", "bucket"), ["lang", "source", "bucket"], "left_semi").withColumn("f", F.col("p") - F.col("q"))
    return rows.where("f > 0").select("lang", "source", "term", "f").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_terms(scored: DataFrame, top: int) -> DataFrame:
    """lang, source, term, f, rank: the ``top`` terms of each group whose share is most above the language's."""
    buckets = scored.groupBy("lang", "source", "bucket").agg(F.count("*").alias("terms"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.withColumn("first", F.coalesce(F.sum("terms").over(best), F.lit(0)) < top), "buckets")
    first = written(_evaluated(scored, buckets.where("first"), top), "first")
    reached = first.where(F.col("rank") == top).select("lang", "source", F.col("f").alias("kth"))
    rest = buckets.where("NOT first").join(reached, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("f"), "term")
    both = first.drop("rank").unionByName(_evaluated(scored, rest, top).drop("rank"))
    found = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "top")
    erase_table(buckets)
    erase_table(first)
    return found


def distances(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for each two sources of a language, in both orders."""
    own = scored.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"), F.count("*").alias("m"))
    g = groups.join(own, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("p0", F.lit(0)).alias("p0"), F.coalesce("sum_p", F.lit(0)).alias("sum_p"), F.coalesce("m", F.lit(0)).alias("m"))
    g = written(g, "sources")
    a, b = (g.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "v", "p0", "sum_p", "m"))) for x in "ab")
    c = F.col
    apart = F.abs(c("p0_a") - c("p0_b"))
    alone = (c("v_a") - c("m_a") - c("m_b")) * apart + c("sum_p_a") - c("m_a") * c("p0_b") + c("sum_p_b") - c("m_b") * c("p0_a")
    base = a.join(b, "lang").where("source_a <> source_b").select("lang", c("source_a").alias("a"), c("source_b").alias("b"), alone.alias("value"))
    # that counts a share below the other's for a term it does not have as if it were above it
    most = g.groupBy("lang").agg(F.max("p0").alias("most"))
    below = scored.select("lang", "source", "p").join(most, "lang").where("p < most").groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    below = below.join(g.select("lang", c("source").alias("other"), "p0"), "lang").where("source <> other AND p < p0").groupBy("lang", "source", "other").agg(F.sum(2 * c("terms") * (c("p0") - c("p"))).alias("value"))
    below = below.select("lang", F.explode(F.array(*(F.struct(c(x).alias("a"), c(y).alias("b")) for x, y in (("source", "other"), ("other", "source"))))).alias("s"), "value").select("lang", "s.a", "s.b", "value")
    postings = scored.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = postings.mapInArrow(_common, _PAIRS)
    found = written(base.unionByName(below).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "distances")
    erase_table(g)
    return found


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: parts ``pair``, all other sources of the language by distance, and ``term``,
    the ``top`` terms that a source gives more than its language does. The result lies in tables in the shared folder."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = written(read.mapInArrow(_count, _COUNTS), "counts")
    of_term = Window.partitionBy("lang", "term")
    counts = partial.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "once": (F.min("source").over(of_term) == F.col("source")).cast("int")})
    postings = written(counts.where(F.col("docs") >= min_docs).drop("docs"), "postings")
    langs = postings.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("lang_total"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = partial.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = written(groups.withColumn("p0", _share("0", "total", "v")), "groups")
    share = _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q")
    bucket = F.floor(F.log2("n") * 4).cast("int").alias("bucket")
    scored = written(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", bucket, *share, "p0"), "scored")
    erase_table(partial)
    erase_table(postings)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(scored, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(by))
    found = top_terms(scored, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), "rank")
    erase_table(scored)
    erase_table(groups)
    return pairs.unionByName(found)
