"""The thin queries of the operators in this folder, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.media import describe_media

    return describe_media(documents(spark, sf_dir))


@query
def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilgrid.llm.bpe_tree import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.common import scratch
    from veilgrid.llm.token_files import encode_documents, positions, read_tokens, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(encode_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2), path)
    return positions(read_tokens(spark, path))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.common import id_crc
    from veilgrid.llm.quality import fit_quality, score_quality

    docs, held = documents(spark, sf_dir), id_crc("doc_id") % 3 == 1
    model = fit_quality(docs, labels(spark, sf_dir), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.common import scratch
    from veilgrid.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_bytes=0)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_warc(spark, path, columns)


#: base32 of the SHA-1: the digest's bits, five for each of the 32 letters.
ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
  1 + 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * cast(substr(bits, 5 * i + 1, 1) AS INT) + 8 * cast(substr(bits, 5 * i + 2, 1) AS INT) + 4 * cast(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * cast(substr(bits, 5 * i + 4, 1) AS INT) + cast(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.common import id_crc
    from veilgrid.llm.toxicity import fit_toxicity, score_toxicity

    docs, held = documents(spark, sf_dir), id_crc("doc_id") % 5 == 0
    model = fit_toxicity(docs, labels(spark, sf_dir), ~held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.winnow import compare_edited

    return compare_edited(documents(spark, sf_dir))


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.surrogates import replace

    return replace(documents(spark, sf_dir)).select("doc_id", "text", "n_entities", F.transform("entities", lambda e: e["kind"]).alias("kinds"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.jaccard_join import near_components

    return near_components(documents(spark, sf_dir))


#: Shingles as texts, links by counting common ones, components by following links.
ORACLES["op2_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON s.doc_id = c.x
"""


@query
def op13_heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.heavy_keys import shop_heavy_keys

    return shop_heavy_keys(spark, sf_dir)


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.divergence import audit

    return audit(documents(spark, sf_dir))


ORACLES["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v FROM d LEFT JOIN l USING (lang) GROUP BY lang, source),
c AS (SELECT g.lang, g.source, g.v, k.term, k.n AS lang_n, l.total AS lang_total, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang) JOIN l USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
  1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM c),
t AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
u AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(u.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN u ON u.lang = a.lang AND u.source = a.source AND u.other = b.source
  UNION ALL SELECT * FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.url_cascade import RULES, WORDS, hosts_with_words, judge

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), hosts_with_words(pages, WORDS))


ORACLES["op12_url_cascade"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(host, path, verdict)),
j AS (SELECT p.*, regexp_matches(host, '(^|[.-])(adult|bets|casino|pills|spam)([.-]|$)') AS host_listed,
  (SELECT max(row(length(r.host || r.path), r.host || r.path, r.verdict)) FROM r WHERE (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)) AS best FROM p)
SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], CASE WHEN host_listed THEN 'block' ELSE 'allow' END) AS verdict, host_listed FROM j
"""
