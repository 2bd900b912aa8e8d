"""URL filters by a cascade of Bloom filters.

Rules (a host, with all its subdomains, and the beginning of a path) and listed hosts are keys. A URL has a key for each
shape, a number of host labels and a length of path, that occurs among the lists; so what fits it are its own keys that are listed.
The cascade knows them without a join: its first level encodes the listed keys, the second those keys of the corpus that
pass the first by mistake, the third the listed keys that pass the second, and so on until no mistake is left. Over the
corpus's complete set of keys, which is what the cascade is built from, membership is exact.

Keys are dealt into shards of a bounded number of listed keys, each with its own cascade, so what is broadcast has a proven bound
whatever the lists' size (:data:`MOST_BITS` for a level); with several shards the rows are marked in one pass for each.

Cases: a null URL, and one without ``://``, has an empty host and path and fits no rule; hosts keep ports, user names and
empty labels as they stand; very long URLs are taken whole; repeated rows are judged alike; empty tables give no rows; an
empty list lists nothing; of an allowing and a blocking rule with the same key the blocking one wins; columns other than
``page_id`` and ``url`` are not read."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import erase_table, written

#: Bits of one level at most, listed keys of one shard at most: with 24 bits a key the first follows from the second.
MOST_KEYS = 4_000_000
MOST_BITS = 24 * MOST_KEYS
#: Keys that are left below which the other levels are built without further jobs; levels at most.
SMALL, MOST_LEVELS = 50_000, 64
_STEP = 0x9E3779B97F4A7C15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` in words of 64, of which ``k`` are set for a key."""

    number: int
    size: int
    k: int
    bits: np.ndarray

    @property
    def turn(self) -> int:
        """What the first hash is crossed with here, so that mistakes of one level are none of the next."""
        return _turn(self.number)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found, at, step = np.ones(len(h1), bool), np.mod(h1 ^ np.int64(self.turn), self.size), np.mod(h2, self.size)
        for i in range(self.k):
            place = (at + i * step) % self.size
            found &= (self.bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels that alternately encode listed keys and mistakes."""

    levels: tuple[Level, ...]

    def members(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys, by their hashes, are listed. Exact for all keys that the cascade was built from."""
        found, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in self.levels:
            passed = level.passes(h1[open_], h2[open_])
            found[open_[~passed]] = level.number % 2 == 0  # what a filter of mistakes does not hold is listed
            open_ = open_[passed]
        found[open_] = len(self.levels) % 2 == 1
        return found


def _turn(number: int) -> int:
    x = number * _STEP & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _shape(number: int, n: int, others: int) -> tuple[int, int]:
    """Bits and hashes of a level for ``n`` keys: the first passes few of many others, all later ones half of them."""
    rate = min(0.5, n * math.sqrt(0.5) / others) if number == 1 and others else 0.5
    k = max(1, min(16, math.ceil(-math.log2(rate))))
    return max(63, math.ceil(n * k / math.log(2))) | 1, k


def _words(places: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros((size + 63) // 64, np.uint64)
    np.bitwise_or.at(bits, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
    return bits


def small_level(number: int, h1: np.ndarray, h2: np.ndarray, others: int) -> Level:
    """A level for keys given by their hashes."""
    size, k = _shape(number, len(h1), others)
    at, step = np.mod(h1 ^ np.int64(_turn(number)), size), np.mod(h2, size)
    return Level(number, size, k, _words(np.concatenate([(at + i * step) % size for i in range(k)]), size))


def _large_level(number: int, keys: DataFrame, n: int, others: int) -> Level:
    """The same with the bits set by Spark: what comes to the driver are the words that have bits, at most the level's size."""
    size, k = _shape(number, n, others)
    at, step = F.pmod(F.col("h1").bitwiseXOR(F.lit(_turn(number))), F.lit(size)), F.pmod("h2", F.lit(size))
    place = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (at + i * step) % size)).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 64 AS INT))")
    rows = place.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros((size + 63) // 64, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Level(number, size, k, bits)


def hashes(key: Column) -> Column:
    """The two hashes of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(level.passes(b["h1"].to_numpy(), b["h2"].to_numpy())))

    return keys.mapInArrow(run, "h1 long, h2 long, listed boolean")


def _counts(keys: DataFrame) -> tuple[int, int]:
    n = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    return n.get(True, 0), n.get(False, 0)


def build(keys: DataFrame) -> Cascade:
    """The cascade of ``keys``: h1, h2 and whether a key is listed, each key once. While many keys are open a level is a job
    over them; the last SMALL of them are worked on here."""
    levels: list[Level] = []
    n = list(_counts(keys))  # the open keys of both kinds
    while n[0] and n[1] and sum(n) > SMALL:
        kind = len(levels) % 2 == 0
        coded, rest = (n[0], n[1]) if kind else (n[1], n[0])
        level = _large_level(len(levels) + 1, keys.where(F.col("listed") == kind), coded, rest)
        levels.append(level)
        # those that it encodes stay open for the next level's mistakes, the others only if they pass
        old, keys = keys, written(keys.where(F.col("listed") == kind).unionByName(_passing(keys.where(F.col("listed") != kind), level)), "open")
        if len(levels) > 1:
            erase_table(old)
        n = list(_counts(keys))
    rows = keys.toArrow() if sum(n) <= SMALL else None
    if levels:
        erase_table(keys)
    if rows is None:  # all that is left is of one kind
        return _closed(levels, n)
    h1, h2, is_listed = rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows["listed"].to_numpy()
    while True:
        kind = len(levels) % 2 == 0
        own = is_listed == kind
        if not (~own).any():
            return _closed(levels, [int(is_listed.sum()), int((~is_listed).sum())])
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys, one of them listed, have the same 128 bits of hashes")
        level = small_level(len(levels) + 1, h1[own], h2[own], int((~own).sum()))
        levels.append(level)
        stay = own | level.passes(h1, h2)
        h1, h2, is_listed = h1[stay], h2[stay], is_listed[stay]


def _closed(levels: list[Level], left: list[int]) -> Cascade:
    """When one kind of keys alone is left, what passes all levels must be of that kind: an odd number of levels for listed keys."""
    kind = left[0] > 0
    if left[0] or left[1]:
        if (len(levels) % 2 == 1) != kind:  # a level that all pass
            levels.append(Level(len(levels) + 1, 63, 1, np.full(1, np.uint64(0xFFFFFFFFFFFFFFFF))))
    return Cascade(tuple(levels))


def cascades(universe: DataFrame, listed: DataFrame) -> list[Cascade]:
    """A cascade for each shard of keys. ``universe`` has all keys that will be asked for (``key``, any number of times),
    ``listed`` the listed ones."""
    once = universe.select("key").distinct()
    marked = once.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    keys = written(marked.select(hashes(F.col("key")).alias("h"), F.coalesce("listed", F.lit(False)).alias("listed")).select("h.*", "listed"), "keys")
    shards = -(-max(1, _counts(keys)[0]) // (MOST_KEYS // 2))  # half full on average, so that none is over the bound
    made = [build(keys.where(_shard(F.col("h1"), shards) == i) if shards > 1 else keys) for i in range(shards)]
    erase_table(keys)
    return made


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 40), F.lit(shards))


def _asked(cascade: Cascade, shard: int, shards: int) -> Callable:
    """A function for columns of arrays of hashes: which are listed, for the keys of one shard."""

    @F.arrow_udf("array<boolean>")
    def run(h: pa.Array) -> pa.Array:
        flat = h.flatten()
        h1, h2 = flat.field("h1").to_numpy(), flat.field("h2").to_numpy()
        found = cascade.members(h1, h2)
        if shards > 1:
            found &= (h1.view(np.uint64) >> np.uint64(40)).astype(np.int64) % shards == shard
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())]), pa.int32()), pa.array(found))

    return run


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host``, with A to Z in lower case, and ``path``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    part = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2)})


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def listed_keys(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """Keys of rules (``host``, ``path``, ``verdict``) and of listed hosts (``host``), with their shapes. The first character
    of a key says what it is of: b and a of a blocking and an allowing rule, h of a listed host."""
    of_rules = rules.select(F.when(F.col("verdict") == "block", "b").otherwise("a").alias("kind"), F.translate("host", _UPPER, _LOWER).alias("host"), "path")
    keys = of_rules.unionByName(hosts.select(F.lit("h").alias("kind"), F.translate("host", _UPPER, _LOWER).alias("host"), F.lit("").alias("path"))).where("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
    return keys.select(F.concat("kind", "host", "path").alias("key"), "kind", F.size(_labels(F.col("host"))).alias("labels"), F.char_length("path").alias("length")).distinct()


def _own_keys(shapes: list[tuple[str, int, int]]) -> Column:
    """The keys that a row with ``host`` and ``path`` has of the given shapes, longest first."""
    held = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("labels"), F.lit(m).alias("length")) for k, n, m in shapes))
    there = F.filter(held, lambda s: (s["labels"] <= F.size("_labels")) & (s["length"] <= F.char_length("path")) & (F.col("host") != ""))
    text = lambda s: F.concat(F.array_join(F.slice(F.col("_labels"), F.size("_labels") - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["length"]))
    return F.transform(there, lambda s: F.concat(s["kind"], text(s)))


def judge(pages: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """page_id, host, path, the longest fitting rule, the verdict, and whether the host or one above it is listed. A page that no rule
    fits is blocked where its host is listed. The shapes that occur in the lists, which are labels of a host by lengths of a path, come to the driver."""
    listed = written(listed_keys(rules, hosts), "listed")
    shapes = sorted((r.kind, r.labels, r.length) for r in listed.select("kind", "labels", "length").distinct().collect())
    rows = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    if not shapes:
        erase_table(listed)
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("host_listed"))
    rows = rows.withColumn("_labels", _labels(F.col("host"))).withColumn("_keys", _own_keys(shapes)).drop("_labels")
    made = cascades(rows.select(F.explode("_keys").alias("key")), listed)
    erase_table(listed)
    rows = rows.withColumn("_in", F.transform("_keys", lambda k: F.lit(False)))
    for i, cascade in enumerate(made):
        found = _asked(cascade, i, len(made))(F.transform("_keys", hashes))
        rows = rows.withColumn("_in", F.zip_with("_in", found, lambda a, b: a | b))
        if len(made) > 1:
            rows = written(rows, "judged")
    hits = F.filter(F.arrays_zip(F.col("_keys").alias("k"), F.col("_in").alias("i")), lambda x: x["i"])
    hits = F.transform(hits, lambda x: x["k"])
    of_rules = F.transform(F.filter(hits, lambda k: F.substring(k, 1, 1) != "h"), lambda k: F.struct(F.char_length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("m"), k.alias("k")))
    rows = rows.withColumn("_hits", hits).withColumn("_rule", F.array_max(of_rules)["k"]).withColumn("host_listed", F.exists("_hits", lambda k: F.substring(k, 1, 1) == "h"))
    verdict = F.when(F.col("_rule").startswith("b"), "block").when(F.col("_rule").isNotNull(), "allow").when(F.col("host_listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.expr("substring(_rule, 2)").alias("rule"), verdict.alias("verdict"), "host_listed")


#: The rules of the contract, and words of which a label of a listed host holds one.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
WORDS = ["adult", "bets", "casino", "pills", "spam"]


def hosts_with_words(pages: DataFrame, words: list[str]) -> DataFrame:
    """A list of hosts: those of ``pages`` of which a label, cut at its hyphens, holds one of ``words``."""
    pattern = "(^|[.-])(" + "|".join(words) + ")([.-]|$)"
    return with_host_and_path(pages.select("url")).where(F.col("host").rlike(pattern)).select("host").distinct()
