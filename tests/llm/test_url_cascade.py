"""URL filters against plain rules, and the cascade's exactness."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import url_cascade as uc

HOSTS = "host string"
RULES = "host string, path string, verdict string"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain(url, rules, hosts):
    host, path = parts(url)
    under = lambda h: bool(host) and (host == h or host.endswith("." + h))
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if under(h) and path.startswith(p)]
    listed = any(under(h) for h in hosts)
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "block" if listed else "allow", listed


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://COM/en/x", "https://www.Example.com/en/1?q#f", "http://example.com/en/", "http://xexample.com/en/", "http://a.example.com/en/x", "http://a.www.example.com/en/x", "http://www.example.com/EN/x",
    "http://net/es/", "http://a.net/es", "http://a.net/es/x", "http://a.net/fr/x#y", "http://.com/", "http://com./", "http://a..com/", "http://ÄÖ.com/ü/é", "http://a.com?x=/en/", "http://a.com#/en/", "http://u@a.com:80/x", "ftp://a://b/c", "http://a.org/new\nline?x", "http://" + "a." * 3000 + "com/" + "p" * 100_000,
]


def test_rules_equal_plain_ones(spark):
    rules = uc.RULES + [("both.com", "/", "allow"), ("both.com", "/", "block"), ("deep.a.org", "", "block"), ("a.org", "/lo", "allow"), ("a.org", "/longer/path", "block")]
    hosts = ["bad.org", "org.bad", "a.net"]
    rng = random.Random(3)
    urls = URLS + [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choices(['a', 'b', 'deep', 'www', 'bad', 'example', 'both'], k=rng.randrange(0, 4)))}.{rng.choice(['com', 'org', 'net'])}{rng.choice(['', '/', '/en/', '/es/x', '/lo', '/longer/path/x', '/longer', '/fr/'])}{rng.choice(['', '?a/b', '#c'])}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(7, URLS[7]), (None, URLS[8])], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit("x"), "_keys": F.lit(2)})
    got = uc.judge(pages, spark.createDataFrame(rules, RULES), spark.createDataFrame([(h,) for h in hosts], HOSTS)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert tuple(r)[1:] == plain(URLS[8] if r.page_id is None else urls[r.page_id], rules, hosts), urls[r.page_id or 0]


def test_empty_lists_and_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES), spark.createDataFrame([], HOSTS)
    assert [tuple(r) for r in uc.judge(pages, *none).collect()] == [(1, "a.com", "/", None, "allow", False)]
    assert uc.judge(pages.limit(0), spark.createDataFrame(uc.RULES, RULES), none[1]).count() == 0


@pytest.mark.parametrize("listed,others,small", [(300, 40_000, 1), (9000, 9000, 1), (5000, 60, 1), (40, 30_000, 50_000), (0, 50, 1), (50, 0, 1), (0, 0, 1), (1, 1, 1)])
def test_the_cascade_is_exact_over_its_keys(spark, monkeypatch, listed, others, small):
    monkeypatch.setattr(uc, "SMALL", small)
    keys = spark.range(listed + others).select(uc.hashes(F.col("id").cast("string")).alias("h"), (F.col("id") < listed).alias("listed")).select("h.*", "listed")
    made = uc.build(keys)
    rows = keys.toArrow()
    assert (made.members(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["listed"].to_numpy()).all()
    if others > 10 * listed > 0:
        assert sum(level.size for level in made.levels) < 20 * listed + 2000 + 64 * len(made.levels)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(uc, "MOST_KEYS", 40)
    hosts = [f"h{i}.org" for i in range(0, 400, 2)]
    pages = spark.createDataFrame([(i, f"http://w.h{i}.org/x") for i in range(400)], "page_id long, url string")
    listed = uc.listed_keys(spark.createDataFrame([], RULES), spark.createDataFrame([(h,) for h in hosts], HOSTS))
    assert len(uc.cascades(listed, listed)) == 10
    got = uc.judge(pages, spark.createDataFrame([("h7.org", "/", "block")], RULES), spark.createDataFrame([(h,) for h in hosts], HOSTS)).collect()
    assert all(r.host_listed == (r.page_id % 2 == 0) and r.verdict == ("block" if r.page_id % 2 == 0 or r.page_id == 7 else "allow") for r in got) and len(got) == 400


def test_levels_are_alike_wherever_they_are_built(spark):
    keys = spark.range(5000).select(uc.hashes(F.col("id").cast("string")).alias("h")).select("h.*")
    rows = keys.toArrow()
    a, b = uc._large_level(1, keys, 5000, 900_000), uc.small_level(1, rows["h1"].to_numpy(), rows["h2"].to_numpy(), 900_000)
    assert (a.size, a.k) == (b.size, b.k) and np.array_equal(a.bits, b.bits)


def test_hosts_with_words(spark):
    pages = spark.createDataFrame([("http://free-bets.example.com/x",), ("http://alphabets.com/",), ("http://a.CASINO.org",), (None,), ("http://a.com/casino",)], "url string")
    assert sorted(r.host for r in uc.hosts_with_words(pages, uc.WORDS).collect()) == ["a.casino.org", "free-bets.example.com"]
