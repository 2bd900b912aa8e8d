"""Queries that run small rules (check digits, gates, claims, versions, actions) over whole tables, with SQL that says the same
by other means. Their texts and cases are derived from each row's key."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import checksums, text as T
from veilgrid.operators import access, detect, envelopes, events as E, metrics, policy as P, seams, signatures, vault
from veilgrid.plans.catalog import EMAIL_SQL, KEY, query, table
from veilgrid.sources.shared import scratch, spread, written
from veilgrid.streaming import rewriter

# -- check digits: an identifier of each kind for each order --
_N = "lpad(CAST((o_orderkey * 2654435761 + 40503) % 1000000000000000 AS STRING), 15, '0')"
_LETTER = lambda n: f"chr(CAST(65 + {n} % 26 AS INT))"


def _texts(div: str) -> dict[str, str]:
    """Expressions that Spark and DuckDB read alike, but for the sign of whole division."""
    k, by = "o_orderkey", lambda n: f"(o_orderkey {div} {n})"
    digit = lambda i: f"substr({_N}, {i}, 1)"
    return {
        "luhn": f"substr({_N}, 2, 13)", "kr_rrn": f"substr({_N}, 1, 13)", "jp_mynumber": f"substr({_N}, 3, 12)", "nl_bsn": f"substr({_N}, 5, 9)",
        "us_ssn": f"CASE WHEN {k} % 40 = 1 THEN '000' WHEN {k} % 40 = 2 THEN '666' ELSE substr({_N}, 7, 3) END || '-' || CASE WHEN {k} % 40 = 3 THEN '00' ELSE substr({_N}, 10, 2) END || '-' || CASE WHEN {k} % 40 = 4 THEN '0000' ELSE substr({_N}, 12, 4) END",
        "iban": f"'DE' || lpad(CAST({k} % 97 + 1 AS STRING), 2, '0') || {_N} || '123'",
        "fr_nir": f"CAST(1 + {k} % 2 AS STRING) || substr({_N}, 1, 4) || CASE WHEN {k} % 7 = 1 THEN '2A' WHEN {k} % 7 = 2 THEN '2B' ELSE substr({_N}, 5, 2) END || substr({_N}, 7, 6) || lpad(CAST({by(3)} % 97 + 1 AS STRING), 2, '0')",
        "es_dni": f"CASE {k} % 6 WHEN 1 THEN 'X' WHEN 2 THEN 'Y' WHEN 3 THEN 'Z' ELSE {digit(1)} END || substr({_N}, 2, 7) || {_LETTER(k)}",
        "it_codice_fiscale": " || ".join([*(_LETTER(by(n)) for n in (1, 2, 3, 5, 7, 11)), f"substr({_N}, 1, 2)", _LETTER(by(13)), f"substr({_N}, 3, 2)", _LETTER(by(17)), f"substr({_N}, 5, 3)", _LETTER(by(4))]),
        "sg_nric": f"substr('STFGM', CAST({k} % 5 + 1 AS INT), 1) || substr({_N}, 3, 7) || {_LETTER(by(5))}",
        "in_aadhaar": f"CAST(2 + {k} % 8 AS STRING) || substr({_N}, 5, 11)",
        "de_steuer_id": f"CASE WHEN {k} % 3 = 0 THEN substr({_N}, 1, 10) ELSE substr('01234567890123456789', CAST({by(10)} % 9 + {k} % 10 AS INT) % 10 + 2, 1) || substr('01234567890123456789', CAST({k} % 10 AS INT) + 2, 9) END || CAST({by(7)} % 10 AS STRING)",
        "uk_nino": f"{_LETTER(k)} || {_LETTER(by(26))} || substr({_N}, 1, 6) || chr(CAST(65 + {by(7)} % 5 AS INT))",
        "kr_phone": f"CASE {k} % 4 WHEN 0 THEN '01' WHEN 1 THEN '82' WHEN 2 THEN '+82' ELSE '10-' END || substr({_N}, 1, 8)",
    }


def _check_sql() -> str:
    """The same checks as sums over lists of digits."""
    t = _texts("//")
    at = lambda name, i: f"CAST(substr({name}, {i}, 1) AS INT)"
    weighted = lambda name, weights: "(" + " + ".join(f"{at(name, i + 1)} * {w}" for i, w in enumerate(weights)) + ")"
    digit_of = lambda c: f"(CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 ELSE ascii({c}) - 65 END)"
    it = lambda i: f"substr(it_codice_fiscale, {i}, 1)"
    odd = lambda i: f"CASE WHEN {it(i)} BETWEEN '0' AND '9' THEN {checksums.ITALIAN_ODD_DIGITS}[ascii({it(i)}) - 47] ELSE {checksums.ITALIAN_ODD_LETTERS}[ascii({it(i)}) - 64] END"
    italian = " + ".join([*(f"({odd(i)})" for i in range(1, 16, 2)), *(digit_of(it(i)) for i in range(2, 16, 2))])
    turns = [list(range(10))]
    for _ in range(7):
        turns.append([checksums.VERHOEFF_TURN[d] for d in turns[-1]])
    product = "CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b) % 5 WHEN b < 5 THEN 5 + (a - b + 5) % 5 ELSE (a - b + 5) % 5 END"
    sg_letters = " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in checksums.SINGAPORE_LETTERS.items())
    sg_more = " ".join(f"WHEN '{c}' THEN {v}" for c, v in checksums.SINGAPORE_OFFSET.items())
    luhn = "list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(luhn, i, 1) AS INT) ELSE (CAST(substr(luhn, i, 1) AS INT) * 2) // 10 + (CAST(substr(luhn, i, 1) AS INT) * 2) % 10 END)) % 10 = 0"
    spanish = "CASE left(es_dni, 1) WHEN 'X' THEN '0' WHEN 'Y' THEN '1' WHEN 'Z' THEN '2' ELSE left(es_dni, 1) END || substr(es_dni, 2, 7)"
    french = "CAST(replace(replace(substr(fr_nir, 1, 13), '2A', '19'), '2B', '18') AS BIGINT)"
    counts = "list_filter(list_transform(range(0, 10), lambda d: 10 - length(replace(substr(de_steuer_id, 1, 10), CAST(d AS VARCHAR), ''))), lambda n: n > 1)"
    checks = {
        "luhn": luhn, "kr_rrn": f"(11 - {weighted('kr_rrn', checksums.KOREAN_WEIGHTS)} % 11) % 10 = {at('kr_rrn', 13)}",
        "us_ssn": "us_ssn[1:3] NOT IN ('000', '666') AND us_ssn[1:1] <> '9' AND us_ssn[5:6] <> '00' AND us_ssn[8:11] <> '0000'",
        "iban": "CAST(substr(iban, 5) || '1314' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1",
        "jp_mynumber": f"CASE WHEN {weighted('jp_mynumber', checksums.JAPANESE_WEIGHTS)} % 11 <= 1 THEN 0 ELSE 11 - {weighted('jp_mynumber', checksums.JAPANESE_WEIGHTS)} % 11 END = {at('jp_mynumber', 12)}",
        "fr_nir": f"97 - {french} % 97 = CAST(substr(fr_nir, 14) AS INT)", "es_dni": f"substr('{checksums.SPANISH_LETTERS}', CAST(CAST({spanish} AS BIGINT) % 23 + 1 AS INT), 1) = right(es_dni, 1)",
        "it_codice_fiscale": f"({italian}) % 26 = ascii(right(it_codice_fiscale, 1)) - 65",
        "sg_nric": f"substr(CASE left(sg_nric, 1) {sg_letters} END, CAST(({weighted('substr(sg_nric, 2, 7)', checksums.SINGAPORE_WEIGHTS)} + CASE left(sg_nric, 1) {sg_more} END) % 11 + 1 AS INT), 1) = right(sg_nric, 1)",
        "in_aadhaar": f"list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: {turns}[i % 8 + 1][CAST(substr(in_aadhaar, 12 - i, 1) AS INT) + 1])), lambda a, b: {product}) = 0",
        "de_steuer_id": f"len({counts}) = 1 AND list_max({counts}) <= 3 AND (11 - list_reduce(list_prepend(10, list_transform(range(1, 11), lambda i: CAST(substr(de_steuer_id, i, 1) AS INT))), lambda p, d: (CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END) * 2 % 11)) % 10 = {at('de_steuer_id', 11)}",
        "nl_bsn": f"nl_bsn <> '000000000' AND {weighted('nl_bsn', checksums.DUTCH_WEIGHTS)} % 11 = 0",
        "uk_nino": f"regexp_full_match(uk_nino, '[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{{6}}[A-D]') AND uk_nino[1:2] NOT IN ({', '.join(repr(x) for x in sorted(checksums.BRITISH_BANNED))})",
        "kr_phone": "regexp_matches(kr_phone, '[-.\\s+]') OR starts_with(kr_phone, '0')",
    }
    return f"WITH t AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in t.items())} FROM orders) SELECT o_orderkey, {', '.join(f'{c} AS {n}' for n, c in checks.items())} FROM t"


@query(_check_sql())
def check_digit_vectors(spark, sf_dir):
    """All 14 checks on identifiers of each kind, some of which hold by chance and by design."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", *(F.expr(e).alias(n) for n, e in _texts("div").items()))
    return o.select("o_orderkey", *(checksums.check(n, F.col(n)).alias(n) for n in _texts("div")))


# -- spans, actions, versions --


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS k, i AS rule, o_orderkey * (7 + i) % 20 AS a, o_orderkey * (7 + i) % 20 + 1 + (o_orderkey * (3 + i) + i) % 8 AS b FROM orders, range(0, 6) t(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b DESC, rule) AS n FROM s),
f AS (SELECT DISTINCT o_orderkey AS k, 0::BIGINT AS n, -1::BIGINT AS e, '' AS kept FROM orders UNION ALL
  SELECT f.k, o.n, CASE WHEN o.a >= f.e THEN o.b ELSE f.e END, CASE WHEN o.a >= f.e THEN kept || ' ' || o.a || '-' || o.b || '/' || o.rule ELSE kept END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
SELECT k AS o_orderkey, ltrim(kept) AS kept FROM f WHERE n = 6""")
def resolve_overlaps(spark, sf_dir):
    """Six spans of each order, of which the greedy fold keeps those that no earlier or longer one covers."""
    k = F.col("o_orderkey")

    def span(i: int):
        a = k * (7 + i) % 20
        b = a + 1 + (k * (3 + i) + i) % 8
        as_int = lambda c: c.cast("int")
        return F.struct(F.lit("t").alias("type"), F.lit("r").alias("rule_id"), F.lit(i).alias("rule"), as_int(a).alias("start"), as_int(b).alias("end"), F.lit(1.0).alias("confidence"), F.concat_ws("/", F.concat_ws("-", as_int(a), as_int(b)), F.lit(i)).alias("value"))

    rows = table(spark, sf_dir, "orders").select("o_orderkey", detect.without_overlaps(F.array(*(span(i) for i in range(6)))).alias("f"))
    return rows.select("o_orderkey", F.array_join(F.transform("f", lambda s: s["value"]), " ").alias("kept"))


_TYPES = ["email", "phone", "card", "secret", "api_key", "kr_rrn", "us_ssn", "injection"]


@query(f"""SELECT c_custkey, t AS type, CASE t WHEN 'email' THEN 'tokenize' WHEN 'phone' THEN 'mask' WHEN 'injection' THEN 'allow' WHEN 'us_ssn' THEN 'redact' ELSE 'block' END AS action
FROM (SELECT c_custkey, {_TYPES}[c_custkey % 8 + 1] AS t FROM customer)""")
def policy_actions(spark, sf_dir):
    kind = F.get(F.array(*(F.lit(t) for t in _TYPES)), (F.col("c_custkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("type"), F.lit("r").alias("rule_id"))
    return P.decide(rows, P.build(["korean-pii", "local-inference"], region="eu-gdpr")).select("c_custkey", "type", "action")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 3, c_custkey % 12, c_custkey % 5) >= (1, 2, 3) AND c_custkey % 3 < 2 END AS ok FROM customer""")
def version_ranges(spark, sf_dir):
    k = F.col("c_custkey")
    version = F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), (k % 5).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 == 0, F.concat(F.lit("v"), version)).otherwise(version).alias("v"))
    return rows.select("c_custkey", T.in_range(F.col("v"), "1.2.3", "2.0.0").alias("ok"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '{"a":[1,{"z":"' || c_name || '"}],"b":' || c_custkey || ',"prompt":"p","secret":{"x":1}}' END AS canon,
  CASE WHEN c_custkey % 5 <> 0 THEN '{"b": ' || c_custkey || ', "a": [1, {"z": "' || c_name || '"}]}' END AS stripped FROM customer""")
def json_utilities(spark, sf_dir):
    """JSON of each customer in canonical form, and without its forbidden keys; each fifth is none."""
    whole = F.concat(F.lit('{"b": '), F.col("c_custkey").cast("string"), F.lit(', "prompt": "p", "a": [1, {"z": "'), "c_name", F.lit('"}], "secret": {"x": 1}}'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("{no")).otherwise(whole).alias("t"))
    return rows.select("c_custkey", T.canonical_json(F.col("t")).alias("canon"), E.sanitized(F.col("t")).alias("stripped"))


@query("""WITH x AS (SELECT l.quality, l.toxic, d.source, d.doc_id % 2 AS half FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT source AS type, half, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM x GROUP BY 1, 2),
a AS (SELECT * FROM c UNION ALL SELECT 'all', half, sum(tp), sum(fp), sum(fn) FROM c GROUP BY 2),
s AS (SELECT type, half, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS p, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS r FROM a)
SELECT b.type FROM s b LEFT JOIN s l ON l.type = b.type AND l.half = 0 WHERE b.half = 1 AND (coalesce(l.p, 0) < b.p - 1e-9 OR coalesce(l.r, 0) < b.r - 1e-9)""")
def score_regressions(spark, sf_dir):
    """Sources that score worse in the documents with even ids than in the others."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")

    def scored(half: int) -> DataFrame:
        own = rows.where(F.col("doc_id") % 2 == half)
        expected = own.select(F.col("doc_id").alias("case_id"), F.col("source").alias("type"), (F.col("quality") == 1).alias("present"), F.lit(False).alias("gap"))
        return metrics.scores(metrics.confusion(expected, own.where("toxic = 1").select(F.col("doc_id").alias("case_id"), F.col("source").alias("type"))).drop("gaps"))

    return metrics.regressions(scored(0), scored(1)).select("type")


# -- gates --


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'accept,x-a' WHEN 1 THEN 'accept' ELSE 'accept,x-c' END AS kept, CASE WHEN page_id % 5 = 0 THEN 400 WHEN strlen(html) > 2000 THEN 413 ELSE 200 END AS gate,
  page_id % 2 = 0 AND url IS NOT NULL AND strpos(url, '://') > 0 AS absolute, page_id % 4 IN (0, 2) AS https FROM pages""")
def request_gates(spark, sf_dir):
    """Headers, bodies, targets and first hops of requests that pages make."""
    k = F.col("page_id")
    letter = F.get(F.array(F.lit("X-A"), F.lit("X-B"), F.lit("X-C")), (k % 3).cast("int"))
    headers = F.create_map(F.lit("Accept"), F.lit("a"), letter, F.lit("b"), F.lit("Connection"), F.lit("c"), F.lit("Authorization"), F.lit("d"))
    body = F.when(k % 5 == 0, F.unhex(F.lit("ff"))).otherwise(F.encode("html", "UTF-8"))
    target = F.when(k % 2 == 0, F.coalesce("url", F.lit("/none"))).otherwise(F.concat(F.lit("/p"), k.cast("string")))
    proto = F.get(F.array(*(F.lit(x) for x in ("https", "http, https", "HTTPS , http", "http"))), (k % 4).cast("int"))
    names = F.lower(F.array_join(F.array_sort(F.map_keys(access.kept_headers(headers, deny=["x-b"]))), ","))
    return table(spark, sf_dir, "pages").select("page_id", names.alias("kept"), access.body_gate(body, 2000).alias("gate"), access.absolute_target(target).alias("absolute"), access.first_hop_https(proto).alias("https"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'not_json' WHEN 1 THEN 'compressed' WHEN 2 THEN CASE WHEN page_id % 300 + 8 > 150 THEN 'too_large' END WHEN 3 THEN 'invalid_json' END AS reason FROM pages")
def response_gates(spark, sf_dir):
    k = F.col("page_id")
    kind = F.when(k % 5 == 0, "text/html").when(k % 5 == 4, "application/vnd.x+json; charset=utf-8").otherwise("Application/JSON")
    body = F.when(k % 5 == 3, F.lit('{"n":')).otherwise(F.concat(F.lit('{"n":"'), F.repeat(F.lit("x"), (k % 300).cast("int")), F.lit('"}')))
    rows = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", kind.alias("t"), F.when(k % 5 == 1, "gzip").when(k % 5 == 4, "identity").alias("e"), F.when(k % 5 == 4, F.lit("[1]")).otherwise(body).alias("b"))
    return rows.select("page_id", access.response_gate(F.col("t"), F.col("e"), F.encode("b", "UTF-8"), 150).alias("reason"))


@query(f"""SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 OR coalesce(regexp_matches(text, '{EMAIL_SQL}'), false) THEN CASE WHEN turn % 4 = 3 THEN 'drop' ELSE 'reject' END ELSE 'pass' END AS verdict FROM conversations""")
def rpc_messages(spark, sf_dir):
    """Turns of conversations as JSON-RPC messages: users' are requests, of which each third conversation's has a method that is not
    allowed; each fourth turn is a notification."""
    c = table(spark, sf_dir, "conversations")
    asks = F.col("role") == "user"
    said = F.struct(F.col("text").alias("t"))
    line = F.to_json(F.struct(
        F.lit("2.0").alias("jsonrpc"), F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("id"), F.when(asks, F.when(F.col("conv_id") % 3 == 0, "b").otherwise("a")).alias("method"),
        F.when(asks, said).alias("params"), F.when(~F.coalesce(asks, F.lit(False)), said).alias("result"),
    ))
    rows = c.select("conv_id", "turn", F.when(asks, "request").otherwise("response").alias("direction"), line.alias("line"))
    return rewriter.protect_rpc(rows, P.build(actions={"email": "block"}, default="allow", mode="enforce"), ["a"]).select("conv_id", "turn", "verdict")


# -- tokens and keys --


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'algorithm' WHEN 2 THEN 'expired' WHEN 3 THEN 'audience' WHEN 4 THEN 'malformed' WHEN 5 THEN 'not yet' WHEN 6 THEN 'issuer' END AS verdict FROM customer")
def token_claims(spark, sf_dir):
    """Claims of tokens, whose signatures are another query's."""
    k = F.col("c_custkey") % 7
    head = F.to_json(F.struct(F.when(k == 1, "none").otherwise("RS256").alias("alg"), F.lit("k").alias("kid")))
    claims = F.to_json(F.struct(
        F.when(k == 6, "https://other").otherwise("https://i").alias("iss"), F.when(k == 3, F.array(F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("aud"), F.col("c_name").alias("sub"),
        F.when(k == 2, 900).otherwise(2000).alias("exp"), F.when(k == 5, 5000).otherwise(10).alias("nbf"),
    ))
    enc = lambda c: T.base64url(F.encode(c, "UTF-8"))
    token = F.when(k == 4, F.lit("a.b")).otherwise(F.concat_ws(".", enc(head), enc(claims), F.lit("x")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", token.alias("t"))
    return rows.select("c_custkey", access.claims_verdict(F.col("t"), "https://i", "b", F.lit(1000)).alias("verdict"))


_key = functools.lru_cache(signatures.made_key)


@query("""SELECT client_id, CASE client_id % 9 WHEN 1 THEN 'issuer' WHEN 2 THEN 'audience' WHEN 3 THEN 'expired' WHEN 4 THEN 'signature' WHEN 5 THEN 'unknown key' WHEN 6 THEN 'algorithm' WHEN 7 THEN 'malformed' WHEN 8 THEN 'not yet' END AS verdict,
  CASE WHEN client_id % 9 = 0 THEN CAST(client_id AS VARCHAR) END AS subject FROM clients WHERE client_id IS NOT NULL""")
def verified_tokens(spark, sf_dir):
    """A signed token of each client, each with one of nine faults or none, against a table of keys."""
    import json

    one, two = _key("one"), _key("two")

    def make(ids: pd.Series) -> pd.Series:
        def token(i: int) -> str:
            k = i % 9
            claims = {"iss": "x" if k == 1 else "i", "aud": ["c"] if k == 2 else ["b", "a"], "sub": str(i), "exp": 900 if k == 3 else 2000, "nbf": 1100 if k == 8 else 10}
            t = signatures.sign({"alg": "RS256", "kid": "none" if k == 5 else "k"}, claims, two if k == 4 else one)
            if k == 6:
                t = signatures.to_b64url(b'{"alg":"none","kid":"k"}') + t[t.index(".") :]
            return t[: t.rindex(".")] if k == 7 else t

        return ids.map(token)

    rows = spread(table(spark, sf_dir, "clients").where("client_id IS NOT NULL").select("client_id"))
    rows = rows.withColumn("token", F.pandas_udf(make, "string")("client_id"))
    jwks = [signatures.jwk_of(one, "k", use="sig"), signatures.jwk_of(two, "other")]
    keys = spark.createDataFrame([(j["kid"], json.dumps(j)) for j in jwks], "kid string, jwk string")
    found = signatures.verified(rows, keys, "i", "a", F.lit(1000))
    return found.select("client_id", "verdict", F.get_json_object("claims", "$.sub").alias("subject"))


@query("""SELECT client_id, CASE WHEN nation_id IS NOT NULL THEN email END AS before, CASE WHEN nation_id IS NOT NULL THEN email END AS after, CAST(NULL AS VARCHAR) AS old_key FROM clients""")
def envelope_rotation(spark, sf_dir):
    """Addresses of clients under a data key for each nation, read before and after the wrapping key was changed, and with
    the old one after it."""
    old, new = b"1" * 32, b"2" * 32
    ring = lambda k: {T.short_id(k): k}
    c, aad = table(spark, sf_dir, "clients").select("client_id", "nation_id", "email"), F.concat(F.lit("clients.email/"), F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    keys = written(envelopes.new_data_keys(c.select(F.col("nation_id").alias("key_id")), old), "keys")
    values = envelopes.sealed(c, keys, ring(old), "email", "nation_id", aad)
    rotated = written(envelopes.rewrapped(keys, ring(old), new), "keys")
    rows = envelopes.opened(values, keys, ring(old), aad, out="before")
    rows = envelopes.opened(rows, rotated, ring(new), aad, out="after")
    return envelopes.opened(rows, rotated, ring(old), aad, out="old_key").select("client_id", "before", "after", "old_key")


# -- implementations behind their seams --


@query("SELECT client_id, name, name AS by_ring, name AS by_data_keys, email IS NOT NULL AS has_mac, count(*) AS n FROM clients GROUP BY client_id, name, email")
def seam_ciphers(spark, sf_dir):
    """Clients' names sealed and opened by both ciphers; equal e-mails have equal MACs, in another domain others."""
    keys = written(envelopes.new_data_keys(spark.range(8).select(F.concat(F.lit("k"), "id").alias("key_id")), KEY), "seam-keys")
    ring, by_keys = seams.RingCipher(vault.KeyRing(KEY), KEY), seams.WrappedCipher(keys, {T.short_id(KEY): KEY}, [f"k{i}" for i in range(8)], KEY)
    about = F.concat(F.lit("client "), F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    rows = written(by_keys.sealed(ring.sealed(table(spark, sf_dir, "clients").select("client_id", "name", "email"), "name", about, "one"), "name", about, "two"), "seam-sealed")
    opened = by_keys.opened(ring.opened(rows, about, "one", "by_ring"), about, "two", "by_data_keys")
    mac = ring.hmac(F.col("email"), "clients")
    return opened.withColumn("has_mac", F.coalesce((mac == by_keys.hmac(F.col("email"), "clients")) & (mac != ring.hmac(F.col("email"), "others")), F.lit(False))).groupBy("client_id", "name", "email", "by_ring", "by_data_keys", "has_mac").agg(F.count("*").alias("n")).drop("email")


@query("""WITH r AS (SELECT click_id, client_id, client_id % 4 AS most, ts, row_number() OVER (PARTITION BY client_id, epoch_us(ts) // 3600000000 ORDER BY ts, click_id) AS hit FROM clicks WHERE ts IS NOT NULL)
SELECT click_id, coalesce(hit <= most AND most >= 1, false) AS allowed FROM r UNION ALL SELECT click_id, false FROM clicks WHERE ts IS NULL""")
def seam_limiter(spark, sf_dir):
    """Clicks as requests with a limit of each client's own, by the hour; unfit ones are refused and count for nothing."""
    c = table(spark, sf_dir, "clicks").selectExpr("click_id", "cast(client_id as string) key", "cast(ts as timestamp) at", "client_id % 4 limit")
    return seams.allowed(c, seams.ClockLimiter(), 3600).select("click_id", "allowed")


@query("SELECT vendor_id, upper(name) AS name, 2 AS changes FROM vendors WHERE nation_id IS NOT NULL UNION ALL SELECT vendor_id, name, 3 FROM vendors WHERE nation_id IS NULL")
def seam_store(spark, sf_dir):
    """Vendors in a store that changes three times: all come in, those of a nation get another name, the others come anew."""
    v = table(spark, sf_dir, "vendors").select("vendor_id", "name", "nation_id")
    store = seams.SharedStore(spark, scratch(spark, "seam-store"), "vendor_id long, name string, nation_id long, changes int")
    store.mutate(lambda now: now.unionByName(v.withColumn("changes", F.lit(1))))
    store.mutate(lambda now: now.where("nation_id is not null").withColumns({"name": F.upper("name"), "changes": F.col("changes") + 1}))
    store.mutate(lambda now: now.unionByName(v.where("nation_id is null").withColumn("changes", F.lit(3))))
    return store.read().select("vendor_id", "name", "changes")
