"""N-gram Jaccard join: all texts whose shingle sets have a Jaccard likeness of at least a threshold, by count-vector
R-trees over blocks of points.

A set becomes a point: its shingles are hashed into groups, and each coordinate counts those of a group. Two sets share at
most the sum, over groups, of the smaller count. An R-tree over the points keeps in each node the largest counts and the
range of set sizes below it, so a whole subtree falls away when even its largest counts share too little; pairs that
survive are verified on the sets themselves. Sums of minima tell unrelated long texts apart only with many groups, and an
R-tree of many dimensions prunes little, so points are first cut into blocks that lose no link: of each set the rarest
shingles are signatures, as many as must contain one that any linked set shares (size - ceil(threshold * size) + 1), and
a block is what signatures connect, directly or through others, among sets of sizes that can link. Frequent shingles come
last in the order that says which are rarest, so that what many unlike documents share ties none of them. They are counted
over all documents, among the shingles that can be signatures; the order knows the FREQUENT most frequent ones, a table of
fixed size, and changes nothing in the result, only the sizes of blocks. Equal sets are one point. A signature that many
sets of a task have leaves it as one row, an interval of sizes, so that a signature of a third of all sets is a row or two
a task.

In a large corpus that table misses most shingles that a few documents share, and documents without a link make one block,
which grows as the corpus does. So a block of over CUT_PARTS parts is cut anew: all shingles of its sets are counted within
the block, and signatures are those that fewest sets of it have. A shingle that no other set has comes first, so that what
has enough of its own leaves the block.

A block over PART_DOCS documents or PART_SHINGLES shingles is worked on in parts of that size, first each part by itself,
then what is left: of each component that was found one document, in parts again, until few are left or no fewer become
so. That makes one component of many near copies in a few rounds, each linear in them. Then the nodes above the points are
built, a node having documents of one component, or of small ones and like sizes; two nodes whose sizes allow a link and
that are not one component are a task, in which one tree holds both. So every link between two components is found, and a
text moves again only where it may link with what it is not connected with. In a tree a document that has joined a
component is held against no more of its members, so that thousands of near copies cost about a comparison each.

Cases: null, empty and blank texts have no shingles, link with nothing and are their own component; texts of any length
are taken whole; rows with equal ids count as texts of one document's id, with a row for each in the result; null ids are
left null and give no name to a component unless alone; empty tables give no rows; other columns of the input are
ignored, whatever their names."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import erase_table, remembering, trim, written
from veilgrid.llm.components import components
from veilgrid.llm.shingles import sets

#: The threshold as a fraction: intersection * DEN >= NUM * union.
NUM, DEN = 4, 5
#: Frequent shingles that the order knows; a shingle's hash without its last bits stands for it, which can only change the
#: order; shingles are counted in parts of COUNT_SHINGLES, and only those whose hash lies in the lowest share LOW.
FREQUENT, DROPPED_BITS, COUNT_SHINGLES, LOW = 1 << 18, 24, 1 << 20, 0.25
#: Bounds of a part of a block, which one task works on; groups of a point; children of a node; the factor between sizes of a band.
PART_DOCS, PART_SHINGLES, GROUPS, FANOUT, BAND = 256, 1_000_000, (16, 256), 32, 1.12
#: Parts of a block above which it is cut anew by counts of its own.
CUT_PARTS = 4
#: Blocks of a signature up to this size list their pairs, larger ones tie all to the smallest.
SMALL = 8
#: Rows of one signature that are held at once.
MOST_HELD = 100_000


def needed(a, b):
    """The least intersection for which sets of sizes a and b link."""
    return -(-NUM * (a + b) // (NUM + DEN))


# -- sets, keys and frequent shingles ---------------------------------------------------------------------------------


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, key and node (the key's first half as a number) of each set."""
    remembering("jaccard", lambda: None)
    for batch in batches:
        found = [(len(s), _key(s)) for s in sets(batch.column(1))]
        nodes = np.frombuffer(b"".join(k[:8] for _, k in found), "<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary()), pa.array(nodes)], ["doc_id", "n", "key", "node"])


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the different sets of a task that have shingles. Copies in other tasks come once for each."""
    remembering("jaccard", lambda: None)
    known: set[bytes] = set()
    for batch in batches:
        for s in sets(batch.column(0)):
            key = _key(s)[:8]
            if len(s) and key not in known:
                known.add(key)
                yield int.from_bytes(key, "little", signed=True), s
    known.clear()
    trim()  # the worker may stay idle from here on, beside other stages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, seen) of the low shingles of a task's different sets, summed within parts."""
    top, held, size = int(-(1 << 63) + LOW * (1 << 64)), [], 0

    def summed() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int32))], ["shingle", "seen"])

    for _, s in _different(batches):
        held.append(s[: np.searchsorted(s, top)] >> DROPPED_BITS)
        size += len(held[-1])
        if size >= COUNT_SHINGLES:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def signatures_of(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, rarest first: enough to share one with any set that links. ``often`` are the frequent
    ones without their last bits, ascending, and ``rank`` how frequent they are."""
    count = len(s) - -(-NUM * len(s) // DEN) + 1
    if not len(often):
        return s[:count]
    at = np.minimum(np.searchsorted(often, s >> DROPPED_BITS), len(often) - 1)
    is_often = often[at] == s >> DROPPED_BITS
    rare, rest = s[~is_often], s[is_often]
    if len(rare) < count:
        rare = np.concatenate([rare, rest[np.argsort(rank[at[is_often]], kind="stable")]])
    return rare[:count]


#: Signatures that are looked at together.
MARKED = 200_000
MARKS = "sig long, node long, low int, high int, place int, other long"


def _marks(sig: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """sig, node, low, high, place, other: a row for each signature of a set, whose size is low and high; place is the
    signature's among the set's. Where more than SMALL sets have a signature, sets of sizes that can link are tied here
    (other is the smallest of them), and a row with place -1 stands for them all."""
    order = np.lexsort((node, n, sig))
    sig, node, n, place = sig[order], node[order], n[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.concatenate([cut, [len(sig)]]))
    many = np.repeat(count > SMALL, count)
    wide = n.astype(np.int64)
    begins = np.concatenate([[True], (sig[1:] != sig[:-1]) | (wide[:-1] * DEN < wide[1:] * NUM)])[many]
    at = np.flatnonzero(many)[begins]
    ends = np.flatnonzero(many)[np.concatenate([begins[1:], [True]])] if len(begins) else at
    few, tied = ~many, node[many]
    first = np.minimum.reduceat(tied, np.flatnonzero(begins))[np.cumsum(begins) - 1] if len(begins) else tied
    columns = [
        np.concatenate([sig[few], sig[at], tied]), np.concatenate([node[few], node[at], tied]), np.concatenate([n[few], n[at], np.zeros(len(tied), np.int32)]),
        np.concatenate([n[few], n[ends], np.zeros(len(tied), np.int32)]), np.concatenate([place[few], np.full(len(at), -1, np.int32), np.zeros(len(tied), np.int32)]),
    ]
    other = pa.array(np.concatenate([np.zeros(len(columns[0]) - len(tied), np.int64), first]), mask=np.arange(len(columns[0])) < len(columns[0]) - len(tied))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), other], ["sig", "node", "low", "high", "place", "other"])


def _signatures(often: np.ndarray, rank: np.ndarray):
    """:func:`_marks` of the signatures of a task's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def out() -> pa.RecordBatch:
            lens = np.array([len(g) for *_, g in got])
            node = np.repeat(np.array([i for i, *_ in got], np.int64), lens)
            n = np.repeat(np.array([n for _, n, _ in got], np.int32), lens)
            return _marks(np.concatenate([g for *_, g in got]), node, n, np.concatenate([np.arange(k, dtype=np.int32) for k in lens]))

        for node, s in _different(batches):
            got.append((node, len(s), signatures_of(s, often, rank)))
            size += len(got[-1][2])
            if size > MARKED:
                yield out()
                got, size = [], 0
        if got:
            yield out()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_marks` of signatures (sig, node, n, place) that are a table already."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size > MARKED:
            yield _marks(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield _marks(*map(np.concatenate, zip(*held)))


def _tied(marks: DataFrame) -> DataFrame:
    """node, root: blocks of what marks connect."""
    ties = marks.repartition("sig").sortWithinPartitions("sig", "low", "node").mapInArrow(_ties, "a long, b long")
    return components(ties)


# -- from signatures to blocks ----------------------------------------------------------------------------------------


def _tie_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Ties, each once and none of a node with itself."""
    if not a:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    x, y = np.concatenate(a), np.concatenate(b)
    x, y = np.maximum(x, y), np.minimum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = (x != y) & np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) that connect what shares a signature and may link, those that tasks have made already among them; rows
    come sorted by sig, low, node."""
    carry = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))

    def filtered(n1, p1, n2, p2):
        low, high = np.minimum(n1, n2), np.maximum(n1, n2)
        # what comes after a first shared signature bounds the intersection
        return (low * DEN >= high * NUM) & (np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2))

    def of(sig, rep, low, high, place, goes_on: bool = False) -> pa.RecordBatch:
        """Ties of whole signatures; the first one may be the end of one that was too large to hold."""
        a, b = [], []
        if len(sig):  # copies from other tasks
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (rep[1:] != rep[:-1]) | (place[1:] < 0) | (place[:-1] < 0)])
            sig, rep, low, high, place = sig[new], rep[new], low[new], high[new], place[new]
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
        size = np.diff(np.concatenate([cut, [len(sig)]]))
        is_large = (size > SMALL) | (np.minimum.reduceat(place, cut) < 0 if len(cut) else np.empty(0, bool))
        is_large[:1] |= goes_on
        for k in range(2, SMALL + 1):
            rows = cut[(size == k) & ~is_large][:, None] + np.arange(k)
            if len(rows):
                i, j = np.triu_indices(k, 1)
                x, y = rows[:, i].ravel(), rows[:, j].ravel()
                ok = filtered(low[x].astype(np.int64), place[x], low[y].astype(np.int64), place[y])
                a.append(rep[x[ok]])
                b.append(rep[y[ok]])
        large = np.flatnonzero(is_large)
        for start, k in zip(cut[large].tolist(), size[large].tolist()):
            # sizes ascend: over a gap that no pair can bridge a new tie begins
            upto = np.maximum.accumulate(high[start : start + k].astype(np.int64))
            run = np.concatenate([[0], np.cumsum(upto[:-1] * DEN < low[start + 1 : start + k].astype(np.int64) * NUM)])
            head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            a.append(rep[start : start + k])
            b.append(np.minimum.reduceat(rep[start : start + k], head)[run])
        return _tie_batch(a, b)

    goes_on = False
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.asarray(batch.column(5).is_null())
        columns = [batch.column(i).to_numpy() for i in range(5)]
        if not mark.all():
            made = batch.column(5).drop_null().to_numpy()
            yield _tie_batch([columns[1][~mark]], [made])
        now = [np.concatenate([c, x[mark]]) for c, x in zip(carry, columns)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last:
            yield of(*(x[:last] for x in now), goes_on)
            goes_on = False
        carry = tuple(x[last:] for x in now)
        if len(carry[0]) > MOST_HELD:  # tie what is there, and go on from its last row and largest size
            yield of(*carry, True)
            sig, rep, low, high, place = (x[-1:].copy() for x in carry)
            carry, goes_on = (sig, rep, low, np.array([carry[3].max()], np.int32), np.full(1, -1, np.int32)), True
    if len(carry[0]):
        yield of(*carry, goes_on)


# -- the R-tree join of a block ---------------------------------------------------------------------------------------


class RTree:
    """Points in a bulk-loaded R-tree: they are sorted by set size and, within runs of like sizes, along the coordinates
    that vary most; each FANOUT neighbours make a node. A node has the largest counts and the sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.points, self.sizes, self.fanout = points, sizes, fanout
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points, sizes, sizes
        while len(top) > 1:
            cut = np.arange(0, len(top), fanout)
            top, low, high = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Places below ``before`` of points that may link with one, and bounds of what they share."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            nodes = nodes[nodes * self.fanout ** (depth + 1) < before]
            share = np.minimum(top[nodes], point).sum(axis=1)
            nodes = nodes[(share >= needed(size, np.maximum(low[nodes], -(-NUM * size // DEN)))) & (high[nodes] * DEN >= size * NUM) & (low[nodes] * NUM <= size * DEN)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            nodes = nodes[nodes < below]
        nodes = nodes[nodes < before]
        share = np.minimum(self.points[nodes], point).sum(axis=1)
        ok = share >= needed(size, self.sizes[nodes])
        return nodes[ok], share[ok]


def link_block(members: list[np.ndarray], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of members) that connect what links within a block, as few as connect it: no link between two
    components of the result exists. Members with equal labels in ``known`` are connected already."""
    if not members:
        return []
    sizes = np.array([len(s) for s in members], np.int64)
    groups = min(GROUPS[1], max(GROUPS[0], 1 << int(np.ceil(np.log2(max(1.0, sizes.mean() / 4))))))
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    hashed = ((flat.view(np.uint64) * _SPREAD) >> np.uint64(64 - int(np.log2(groups)))).astype(np.int64)
    points = np.bincount(owner * groups + hashed, minlength=len(members) * groups).reshape(len(members), groups).astype(np.int32)
    wide = np.argsort(-points.std(axis=0))[:2]
    order = np.lexsort((points[:, wide[1]], points[:, wide[0]], (np.log(sizes) / np.log(1.05)).astype(int)))
    _, ids = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    points, ordered = points[order], sizes[order]
    tree = RTree(points, ordered)
    root = np.arange(len(members)) if known is None else np.unique(known[order], return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    out = []
    for i in range(1, len(order)):
        found, share = tree.search(points[i], int(ordered[i]), i)
        found = found[np.argsort(-share, kind="stable")]
        found = found[root[found] != root[i]]
        if not len(found):
            continue
        own = ids[start[order[i]] : start[order[i] + 1]]
        mark[own] = True
        step = 4
        while len(found):
            part, found = found[:step], found[step:]
            step = min(256, 4 * step)
            places = order[part]
            pieces = [ids[start[p] : start[p + 1]] for p in places]
            shared = np.add.reduceat(mark[np.concatenate(pieces)].astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in pieces])[:-1]]))
            for k in np.flatnonzero(shared >= needed(int(ordered[i]), ordered[part])):
                if root[part[k]] != root[i]:
                    out.append((int(order[i]), int(places[k])))
                    root[root == root[i]] = root[part[k]]
            found = found[root[found] != root[i]]
        mark[own] = False
    return out


_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same connections as ``links`` as pairs of a node and the smallest that it is connected with."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up) if top(x) != x]


def _link_group(table: pa.Table) -> pa.Table:
    """Links between the labels ``c`` of a group's rows, each with the smallest that it is connected with in the group."""
    labels = table.column("c").to_numpy()
    texts = table.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    found = _stars([(int(labels[i]), int(labels[j])) for i, j in link_block(list(sets(texts)), labels)])
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


# -- the join ---------------------------------------------------------------------------------------------------------


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to. One row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    described = written(rows.mapInArrow(_describe, "doc_id long, n long, key binary, node long"), "sets")
    texts = rows.select("text")
    seen = texts.mapInArrow(_count, "shingle long, seen int").groupBy("shingle").agg(F.sum("seen").alias("seen")).where("seen > 1")
    # the table of frequent shingles has a fixed size, whatever the corpus
    table = seen.orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow().sort_by("shingle")
    often, rank = (table.column(c).to_numpy() for c in ("shingle", "seen"))

    blocks = _tied(texts.mapInArrow(_signatures(often, rank), MARKS))

    # one document of each set, the one with the smallest id
    reps = written(described.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("node").alias("node")), "reps")
    members = _finer(rows, written(blocks.join(reps, "node").select("rep", "root", "n", "node"), "members"))
    named = reps.join(_roots(rows, members), "rep", "left").select("key", F.coalesce("c", "rep").alias("root"))
    out = described.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: Bits of the table that says which documents are in blocks.
MEMBER_BITS = 1 << 24


def _only(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among ``ids`` (rep): a table of MEMBER_BITS bits, two MB whatever the corpus, spares most
    texts the way to a join that they would not survive."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS)) + 1  # noqa: E731  positions and buckets count from 1
    maps = ids.select(at("rep").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    table = bytearray(MEMBER_BITS // 8)
    for m in maps:
        table[(m.k - 1) * 4096 : m.k * 4096] = m.bits
    bits = rows.sparkSession.sparkContext.broadcast(bytes(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(held[batch.column(2).to_numpy() - 1])).columns[:2], ["doc_id", "text"])

    return rows.where("doc_id is not null").withColumn("p", at("doc_id")).mapInArrow(run, "doc_id long, text string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, sig: a row for each shingle of the sets of texts (text, root, node), of which n is the size; sig tells a
    block's shingles from those of other blocks. A text whose set is not the node's, of an id that has several, has none."""
    remembering("jaccard", lambda: None)
    held, size = [], 0

    def out() -> pa.RecordBatch:
        lens = np.array([len(s) for *_, s in held])
        node, n = np.repeat(np.array([i for i, _ in held], np.int64), lens), np.repeat(lens.astype(np.int32), lens)
        return pa.RecordBatch.from_arrays([*map(pa.array, (node, n, np.concatenate([s for *_, s in held])))], ["node", "n", "sig"])

    for batch in batches:
        roots, nodes = (batch.column(k).to_numpy() for k in (1, 2))
        for s, block, node in zip(sets(batch.column(0)), (roots.view(np.uint64) * _SPREAD).view(np.int64), nodes.tolist()):
            if int.from_bytes(_key(s)[:8], "little", signed=True) == node:
                held.append((node, s ^ block))
                size += len(s)
            if size > MARKED:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _too_large(members: DataFrame) -> DataFrame:
    """Blocks of more than CUT_PARTS parts: root, k (their members)."""
    return members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where(_parts("k", "s") > CUT_PARTS).select("root", "k")


def _finer(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (rep, root, n, node) with large blocks cut anew, as often as that at least halves what is in large ones:
    within a block all shingles are counted, so that signatures are its rarest ones indeed. A set whose signatures no other
    set of the block has links with nothing and is no member any more."""
    before = None
    while True:
        large = _too_large(members)
        now = large.agg(F.sum("k")).first()[0] or 0
        if not now or (before is not None and 2 * now > before):
            return members
        before = now
        own = written(members.join(large.select("root").hint("rebalance"), "root").select("rep", "root", "n", "node"), "large")
        texts = _only(own, rows).join(own.select(F.col("rep").alias("doc_id"), "root", "node").hint("shuffle_hash"), "doc_id")
        pieces = written(texts.select("text", "root", "node").mapInArrow(_pieces, "node long, n int, sig long"), "pieces")
        seen = pieces.groupBy("sig").agg(F.count("*").alias("seen")).where("seen > 1")
        # a text that is there twice has its shingles twice
        shared = pieces.join(seen.hint("rebalance"), "sig").repartition("node").dropDuplicates(["node", "sig"])
        mine = Window.partitionBy("node")
        place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("seen", "sig")) - 1
        chosen = shared.withColumn("place", place.cast("int")).where(f"place < n - (n * {NUM} + {DEN - 1}) div {DEN} + 1")
        blocks = _tied(chosen.select("sig", "node", "n", "place").mapInArrow(_marked, MARKS))
        erase_table(pieces)
        finer = blocks.join(own.select("rep", "n", "node"), "node").select("rep", "root", "n", "node")
        members = written(members.join(large.hint("rebalance"), "root", "left_anti").unionByName(finer), "members")


def _linked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between labels within groups (doc_id, root, p, q, c): a label and the smallest of its group that it is
    connected with there. Where no two groups have a label in common, these are components already."""
    texts = _only(groups.select(F.col("doc_id").alias("rep")), rows).join(groups.hint("shuffle_hash"), "doc_id").select("text", "root", "p", "q", "c")
    return texts.groupBy("root", "p", "q").applyInArrow(_link_group, "a long, b long")


def _parts(count: str, shingles: str | None = None):
    """How many parts a block needs."""
    parts = F.ceil(F.col(count) / PART_DOCS)
    return (F.greatest(parts, F.ceil(F.col(shingles) / PART_SHINGLES)) if shingles else parts).cast("int")


def _roots(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rep, c: the smallest member of its component, for members (rep, root, n) that link with any."""
    totals = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s")).select("root", _parts("k", "s").alias("parts"))
    parted = members.join(totals.hint("rebalance"), "root")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    first = components(_linked(rows, parted.select(F.col("rep").alias("doc_id"), "root", part.alias("p"), F.lit(0).alias("q"), F.col("rep").alias("c"))))
    first = first.select(F.col("node").alias("rep"), F.col("root").alias("c"))
    large = parted.where("parts > 1").select("rep", "root", "n")
    if large.isEmpty():
        return first
    labels = written(large.join(first, "rep", "left").select("rep", "root", "n", F.coalesce("c", "rep").alias("was")).withColumn("c", F.col("was")), "labels")
    labels = _between(rows, _leaders(rows, labels))
    moved = labels.where("was <> c").select("was", "c").distinct()
    every = first.unionByName(labels.select("rep", F.col("was").alias("c"))).distinct().withColumnRenamed("c", "was")
    return every.join(moved.hint("rebalance"), "was", "left").select("rep", F.coalesce("c", "was").alias("c"))


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    new = roots.select(F.col("node").alias("c"), F.col("root").alias("new"))
    return written(labels.join(new.hint("rebalance"), "c", "left").select("rep", "root", "n", "was", F.coalesce("new", "c").alias("c")), "labels")


def _leaders(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after components have been connected through one document of each, in rounds."""
    turn = 0
    while True:
        leaders = labels.where("rep = c")
        counts = leaders.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where("k > 1").select("root", "k", _parts("k", "s").alias("parts"))
        before = counts.agg(F.sum("k"), F.max("parts")).first()
        if not before[0]:
            return labels
        part = F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("parts")).cast("int")
        groups = leaders.join(counts.hint("rebalance"), "root").select(F.col("rep").alias("doc_id"), "root", part.alias("p"), F.lit(-1 - turn).alias("q"), "c")
        labels, turn = _relabelled(labels, components(_linked(rows, groups))), turn + 1
        if before[1] == 1 or 2 * labels.where("rep = c").join(counts.hint("rebalance"), "root").count() > before[0]:
            return labels


def _between(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after every link between two components of a block has been found: between nodes of which at most one
    component is known, where sizes allow a link and they are not the same component."""
    sizes = labels.groupBy("root", "c").agg(F.count("*").alias("k"))
    more = sizes.groupBy("root").agg(F.count("*").alias("components")).where("components > 1").select("root")
    if more.isEmpty():
        return labels
    own = labels.join(more.hint("rebalance"), "root").join(sizes.hint("rebalance"), ["root", "c"])
    band = F.floor(F.log("n") / math.log(BAND))
    own = own.withColumn("key", F.when(F.col("k") >= PART_DOCS, F.xxhash64(F.lit("component"), "c")).otherwise(F.xxhash64(F.lit("band"), band)))
    keys = own.groupBy("root", "key").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("root", "key", _parts("m", "s").alias("subs"))
    placed = own.join(keys.hint("rebalance"), ["root", "key"])
    placed = written(placed.select("rep", "root", "n", "c", F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("subs"))).alias("node")), "nodes")
    nodes = placed.groupBy("root", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    one, two = (nodes.select("root", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "low", "high", "c1", "c2"))) for x in "pq")
    pairs = one.join(two, "root").where(
        f"node_p <= node_q and low_p * {NUM} <= high_q * {DEN} and low_q * {NUM} <= high_p * {DEN} and not (c1_p = c2_p and c1_q = c2_q and c1_p = c1_q)")
    sides = pairs.select("root", F.col("node_p").alias("p"), F.col("node_q").alias("q"), F.explode(F.array_distinct(F.array("node_p", "node_q"))).alias("node"))
    groups = placed.join(sides, ["root", "node"]).select(F.col("rep").alias("doc_id"), "root", "p", "q", "c")
    return _relabelled(labels, components(_linked(rows, groups)))
