"""The registered queries of the engine's own operators, each over its whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrid.functions import checksums, text as T
from veilgrid.operators import access, detect, events as E, limits, metrics, policy as P, rewrite as R, trees, vault
from veilgrid.operators.rules import custom_rule
from veilgrid.sources import growing, logs, tail
from veilgrid.sources.shared import scratch, spread, written
from veilgrid.streaming import frames, pairing, rewriter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = b"veilgrid-catalog-key-0123456789a"
EMAIL_SQL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
NOW = "timestamp '2024-01-20 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _emails(spark, sf_dir) -> DataFrame:
    """doc_id and each of its e-mail spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", detect.spans(F.col("text"), only=["email"]).alias("found"))
    return docs.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")


EMAILS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS value FROM documents"

# -- detection and rewriting --


@query(f"""SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:email]', 'g') AS masked_text,
  len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n_detections FROM documents""")
def redact_emails(spark, sf_dir):
    done = R.protect(table(spark, sf_dir, "documents"), P.build(["llm-redact"], mode="enforce"), only=["email"])
    return done.select("doc_id", F.col("out").alias("masked_text"), F.col("summary.detection_count").alias("n_detections"))


@query(f"SELECT value, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({EMAILS}) GROUP BY value")
def email_spans(spark, sf_dir):
    return _emails(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query()
def detect_all_types(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.spans(F.col("text"))).alias("s"))
    return found.groupBy("s.type", "s.rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


#: An SSN is a whole run of word characters and dashes, so it needs no look around. Digits of a card are doubled from its end.
_LUHN_SQL = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT) ELSE (CAST(substr(d, i, 1) AS INT) * 2) // 10 + (CAST(substr(d, i, 1) AS INT) * 2) % 10 END)) % 10 = 0"


@query(rf"""WITH m AS (SELECT doc_id, 'email' AS rule_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS v FROM documents
  UNION ALL SELECT doc_id, 'us-ssn', unnest(list_filter(regexp_extract_all(text, '[0-9A-Za-z_-]+'), lambda x: regexp_full_match(x, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'))) FROM documents
  UNION ALL SELECT doc_id, 'card-like', unnest(regexp_extract_all(text, '\b(?:\d[ -]*?){{13,19}}\b')) FROM documents),
d AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM m)
SELECT doc_id, rule_id, count(*) AS n FROM d WHERE rule_id = 'email' OR (rule_id = 'card-like' AND {_LUHN_SQL})
  OR (rule_id = 'us-ssn' AND v[1:3] NOT IN ('000', '666') AND v[1:1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000') GROUP BY 1, 2""")
def detect_common_types(spark, sf_dir):
    """Addresses, social security numbers and cards among what all rules find."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.spans(F.col("text"))).alias("s"))
    return found.where(F.col("s.rule_id").isin("email", "us-ssn", "card-like")).groupBy("doc_id", "s.rule_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{EMAIL_SQL}'), lambda v: '[TOKEN:email:' || substr(sha256(v), 1, 12) || ']'), ', ') AS tokens "
       f"FROM documents WHERE regexp_matches(text, '{EMAIL_SQL}')")
def tokenize_plain(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", detect.spans(F.col("text"), only=["email"]).alias("f")).where(F.size("f") > 0)
    return rows.select("doc_id", F.array_join(F.transform("f", lambda s: T.plain_token(s["type"], s["value"])), ", ").alias("tokens"))


_INNER, _OUTER = (p.hex() for p in T.hmac_pads(KEY))


@query(f"SELECT c_custkey, 'tok_name_' || substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode('name:' || c_name)))), 1, 32) AS token FROM customer")
def tokenize_keyed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.vault_token(KEY, F.lit("name"), F.col("c_name")).alias("token"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE substr(c_name, 1, 2) || repeat('*', greatest(4, length(c_name) - 4)) || right(c_name, 2) END AS masked, "
       "CASE WHEN length(c_mktsegment) <= 8 THEN repeat('*', length(c_mktsegment)) ELSE substr(c_mktsegment, 1, 2) || repeat('*', greatest(4, length(c_mktsegment) - 4)) || right(c_mktsegment, 2) END AS segment FROM customer")
def mask_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask(F.col("c_name")).alias("masked"), T.mask(F.col("c_mktsegment")).alias("segment"))


@query("SELECT c_custkey, c_name AS opened, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def encrypt_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", T.encrypt(F.col("c_name"), KEY, F.col("c_custkey").cast("string")).alias("e"))
    keys = {T.short_id(KEY): KEY}
    return rows.select("c_custkey", T.decrypt(F.col("e"), keys, F.col("c_custkey").cast("string")).alias("opened"), T.decrypt(F.col("e"), keys, F.lit("other")).alias("wrong"))


@query(f"""WITH f AS ({EMAILS} UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bthe [a-z]{{3,8}}\\b')) FROM documents)
SELECT CASE WHEN value LIKE '%@mail1.%' OR value = 'the the' THEN 'suppressed' WHEN value LIKE '%@%' THEN 'kept' ELSE 'dropped' END AS fate, count(*) AS n FROM f GROUP BY 1""")
def precision_dials(spark, sf_dir):
    """Addresses are kept but for allowed ones; a custom rule's hits are less sure than the dial asks, and dropped."""
    rule = custom_rule("noun", "noun", r"\bthe [a-z]{3,8}\b", "gi", 0.4)
    docs = table(spark, sf_dir, "documents")
    each = lambda **o: docs.select(F.explode(detect.spans(F.col("text"), **o)).alias("s")).select("s.type", "s.value", "s.confidence")
    # counted first, so that a frequent value is one row of the join
    found = each(only=["email"]).unionByName(each(custom=[rule], only=["noun"])).groupBy("type", "value", "confidence").agg(F.count("*").alias("n"))
    allowed = found.where(F.col("value").contains("@mail1.") | (F.col("value") == "the the"))
    return R.fates(found, allowed, 0.5).groupBy("fate").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '{EMAIL_SQL}') THEN text END AS out, regexp_matches(text, '{EMAIL_SQL}') AS blocked FROM documents")
def enforce_policy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.protect(docs, P.build(actions={"email": "block"}, default="allow", mode="enforce")).select("doc_id", "out", "blocked")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\bthe [a-z]{3,8}\b')) AS hits FROM documents")
def custom_rules(spark, sf_dir):
    rule = custom_rule("noun", "noun", r"\bthe [a-z]{3,8}\b", "gi")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(detect.spans(F.col("text"), custom=[rule], only=["noun"])).cast("long").alias("hits"))


@query(f"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))) AS n, array_to_string(list_sort(list_transform(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}')), lambda v: '[TOKEN:email:' || substr(sha256(v), 1, 12) || ']')), ',') AS tokens FROM documents")
def issued_tokens(spark, sf_dir):
    policy = P.build(actions={"email": "tokenize"}, default="allow", mode="enforce")
    docs = table(spark, sf_dir, "documents").select("doc_id", R.issued(R.with_actions(detect.spans(F.col("text"), only=["email"]), policy)).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), ",").alias("tokens"))


_ENCODED = "SELECT c_custkey, 'card 4111111111111111 of ' || c_name AS t FROM customer"


@query(f"SELECT c_custkey, t AS plain, t AS percent, CAST(NULL AS VARCHAR) AS neither FROM ({_ENCODED})")
def decode_texts(spark, sf_dir):
    t = F.concat(F.lit("card 4111111111111111 of "), F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.encode(t, "UTF-8")).alias("b"), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")).alias("p"), "c_name")
    return rows.select("c_custkey", T.decode_base64(F.col("b")).alias("plain"), T.decode_percent(F.col("p")).alias("percent"), T.decode_base64(F.col("c_name")).alias("neither"))


@query("SELECT c_custkey, 'card' AS type FROM customer")
def decode_and_rescan(spark, sf_dir):
    t = F.base64(F.encode(F.concat(F.lit("card 4111111111111111 of "), F.col("c_name")), "UTF-8"))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.explode(detect.spans(t, decode=True)).alias("s"))
    return rows.where("s.type = 'card'").select("c_custkey", "s.type")


# -- check digits --
_DIGITS9, _DIGITS13 = "lpad(CAST((c_custkey * 7919 + 10007) % 1000000000 AS VARCHAR), 9, '0')", "lpad(CAST((c_custkey * 99990001 + 9007199254) % 10000000000000 AS VARCHAR), 13, '0')"


@query(f"""WITH d AS (SELECT c_custkey, {_DIGITS9} AS n9, {_DIGITS13} AS n13 FROM customer)
SELECT c_custkey,
  n9 <> '000000000' AND (list_sum(list_transform(range(1, 9), lambda i: CAST(substr(n9, i, 1) AS INT) * (10 - i))) - CAST(substr(n9, 9, 1) AS INT)) % 11 = 0 AS nl_bsn,
  (11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(n13, i, 1) AS INT) * (CASE WHEN i <= 8 THEN i + 1 ELSE i - 7 END))) % 11) % 10 = CAST(substr(n13, 13, 1) AS INT) AS kr_rrn,
  list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(n13, i, 1) AS INT) ELSE (CAST(substr(n13, i, 1) AS INT) * 2) // 10 + (CAST(substr(n13, i, 1) AS INT) * 2) % 10 END)) % 10 = 0 AS luhn,
  list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(n13, i, 1) AS INT) ELSE (CAST(substr(n13, i, 1) AS INT) * 2) // 10 + (CAST(substr(n13, i, 1) AS INT) * 2) % 10 END)) % 10 = 0 AS luhn_native
FROM d""")
def check_digits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_DIGITS9.replace("VARCHAR", "STRING")).alias("n9"), F.expr(_DIGITS13.replace("VARCHAR", "STRING")).alias("n13"))
    return c.select("c_custkey", checksums.check("nl_bsn", F.col("n9")).alias("nl_bsn"), checksums.check("kr_rrn", F.col("n13")).alias("kr_rrn"), checksums.check("luhn", F.col("n13")).alias("luhn"), checksums.luhn_ok(F.col("n13")).alias("luhn_native"))


# -- policies and profiles --
_PROFILES = P.Profiles({"strict": P.build(["strict-block"], models=["m1"]), "team": P.build(["llm-redact"]), "base": P.build()}, "base", {"scope:7": "strict", "scope:3": "team"}, {"seg=BUILDING": "team"})


@query("""SELECT c_custkey, p AS profile, CASE WHEN p = 'strict' THEN c_custkey % 2 = 1 ELSE true END AS allowed FROM (
  SELECT c_custkey, CASE c_nationkey WHEN 7 THEN 'strict' WHEN 3 THEN 'team' ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'team' ELSE 'base' END END AS p FROM customer)""")
def resolve_profiles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    scopes = F.array(F.lit("scope:x"), F.concat(F.lit("scope:"), F.col("c_nationkey").cast("string")))
    rows = rows.select("c_custkey", _PROFILES.resolve(scopes, F.create_map(F.lit("seg"), F.col("c_mktsegment"))).alias("profile"))
    return rows.withColumn("allowed", _PROFILES.allowed_model(F.col("profile"), F.concat(F.lit("m"), (F.col("c_custkey") % 2).cast("string"))))


# -- JSON trees --


@query("SELECT event_id, '[k]' AS kind_path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def flatten_json(spark, sf_dir):
    rows = trees.flatten(table(spark, sf_dir, "events").select("event_id", "props"), "props").where("kind = 'number'")
    return rows.select("event_id", F.concat(F.lit("["), trees.path_text(F.col("path"), safe=False), F.lit("]")).alias("kind_path"), "value")


@query("SELECT 'key_' || substr(sha256('k'), 1, 12) AS path_text, 'key' AS kind, count(*) AS n FROM events WHERE props IS NOT NULL "
       "UNION ALL SELECT 'key_' || substr(sha256('k'), 1, 12), 'number', count(*) FROM events WHERE props IS NOT NULL")
def safe_paths(spark, sf_dir):
    rows = trees.flatten(table(spark, sf_dir, "events").select("props"), "props")
    return rows.groupBy("path_text", "kind").agg(F.count("*").alias("n"))


@query("""SELECT sha256('{"k":{"type":"number"}}') AS shape, count(*) AS n FROM events""")
def payload_shapes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(trees.shape_hash(F.col("props")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS detections,
  regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:email]', 'g') AS content FROM documents""")
def rewrite_json(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))).alias("payload"))
    policy = P.build(actions={"email": "redact"}, default="allow", mode="enforce")
    done = trees.protect_json(docs, "payload", policy)
    return done.select("doc_id", F.size(F.filter("found", lambda s: s["type"] == "email")).cast("long").alias("detections"), F.get_json_object("out", "$.messages[0].content").alias("content"))


# -- the event log --


def _log(spark, sf_dir) -> DataFrame:
    """Events as a log: what happened to each, with counts."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "click", "mask").otherwise("redact")
    n = (F.col("event_id") % 4).cast("long")
    counts = lambda k: F.when(n > 0, F.map_from_entries(F.array(F.struct(k, n)))).otherwise(F.create_map().cast("map<string,bigint>"))
    return e.select(
        F.lit("1").alias("schema_version"), F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("blocked"),
        F.struct(n.alias("detection_count"), counts(F.col("event_type")).alias("by_type"), counts(action).alias("by_action")).alias("summary"),
        F.struct(F.lit("sha256").alias("alg"), F.lit("json-stable-v1").alias("canonicalization"), (F.col("event_id") + 1).alias("sequence"), F.lit(None).cast("string").alias("previous_hash"), F.lit(None).cast("string").alias("event_hash")).alias("audit_integrity"))


_LOG = "SELECT event_id + 1 AS sequence, event_type = 'error' AS blocked, event_type, event_id % 4 AS n, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'mask' ELSE 'redact' END AS action FROM events"


@query(f"""WITH l AS ({_LOG}) SELECT (SELECT count(*) FROM l) AS events, (SELECT count(*) FILTER (blocked) FROM l) AS blocked, CAST((SELECT sum(n) FROM l) AS BIGINT) AS detections,
  (SELECT string_agg(event_type || '=' || s, ',' ORDER BY event_type) FROM (SELECT event_type, CAST(sum(n) AS BIGINT) AS s FROM l WHERE n > 0 GROUP BY 1)) AS by_type,
  (SELECT string_agg(action || '=' || s, ',' ORDER BY action) FROM (SELECT action, CAST(sum(n) AS BIGINT) AS s FROM l WHERE n > 0 GROUP BY 1)) AS by_action""")
def audit_report(spark, sf_dir):
    r = E.report(_log(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.select("events", "blocked", "detections", said("by_type").alias("by_type"), said("by_action").alias("by_action"))


@query(f"SELECT sequence, CAST(sequence - 1 AS VARCHAR) AS id, blocked, n AS detection_count FROM ({_LOG}) WHERE sequence < 900 AND action = 'mask' AND n > 0 ORDER BY sequence DESC LIMIT 25")
def audit_page(spark, sf_dir):
    shown = E.page(_log(spark, sf_dir), 25, cursor=900, decision="mask")
    return shown.select("audit_integrity.sequence", "id", "blocked", "summary.detection_count")


@query(f"SELECT CASE WHEN count(*) = 50 THEN min(sequence) END AS next_cursor, min(sequence) AS low FROM (SELECT sequence FROM ({_LOG}) ORDER BY sequence DESC LIMIT 50)")
def audit_cursor(spark, sf_dir):
    return E.next_cursor(E.page(_log(spark, sf_dir)), 50)


@query(f"SELECT min(sequence) AS low, min(sequence) = 1 AS covered_from_start, min(sequence) > 1 AND 400 <= min(sequence) AS exceeded FROM (SELECT sequence FROM ({_LOG}) WHERE sequence > (SELECT max(event_id) + 1 - 500 FROM events))")
def audit_window(spark, sf_dir):
    return E.window_exceeded(logs.tail(_log(spark, sf_dir), 500), 400)


def _records(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).cast("string").alias("chain"), F.col("event_id").alias("position"), F.to_json(F.struct("event_id", "event_type", "value")).alias("record"))


@query("SELECT CAST(user_id % 16 AS VARCHAR) AS chain, true AS valid, count(*) AS records, CAST(NULL AS VARCHAR) AS reason FROM events GROUP BY 1")
def chain_verify(spark, sf_dir):
    # written, as lines and anchors are both taken from it
    built = written(E.build_chains(_records(spark, sf_dir), "chain", "position", "record"), "chains")
    found = E.verify_chains(built.withColumnRenamed("sequence", "position"), E.anchors_of(built, 10))
    return found.select("chain", "valid", "records", "reason")


@query("""WITH s AS (SELECT user_id % 16 AS c, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS n FROM events)
SELECT CAST(c AS VARCHAR) AS chain, CASE WHEN c % 3 = 0 THEN 4 ELSE count(*) END AS records, c % 3 <> 0 AS valid, CASE WHEN c % 3 = 0 THEN 'wrong hash' END AS reason FROM s GROUP BY c""")
def chain_tampering(spark, sf_dir):
    built = E.build_chains(_records(spark, sf_dir), "chain", "position", "record")
    bad = (F.col("chain").cast("int") % 3 == 0) & (F.col("sequence") == 5)
    lines = built.select("chain", F.col("sequence").alias("position"), F.when(bad, F.regexp_replace("line", '"event_id":', '"event_id":9')).otherwise(F.col("line")).alias("line"))
    return E.verify_chains(lines).select("chain", "records", "valid", "reason")


def _log_records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("record"))


#: Chains of 100 events, and what is done to each eighth one.
_CHAINS = "SELECT (n - 1) // 100 AS c, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) AS n FROM events) GROUP BY 1"


@query(f"""WITH s AS ({_CHAINS}), f AS (SELECT c, n, n // 10 * 10 AS a,
  CASE WHEN c % 8 IN (1, 2, 3, 4, 7) AND n > 5 THEN 4 WHEN c % 8 = 5 AND n >= 10 THEN 9 WHEN c % 8 = 6 AND n >= 10 THEN n // 10 * 10 - 1 ELSE n END AS records FROM s)
SELECT CAST(c AS VARCHAR) AS chain, records, records = n AS valid, CASE WHEN records = n THEN NULL WHEN c % 8 = 1 THEN 'wrong hash' WHEN c % 8 = 2 THEN 'wrong sequence' WHEN c % 8 = 3 THEN 'no integrity block'
  WHEN c % 8 = 4 THEN 'wrong previous hash' WHEN c % 8 = 5 THEN 'not the anchored hash at 10' WHEN c % 8 = 7 THEN 'no JSON' ELSE 'cut short: it has ' || records || ' records and is anchored up to ' || a END AS reason FROM f""")
def chain_faults(spark, sf_dir):
    """One log of all events, in chains of 100, with each kind of fault in an eighth of them."""
    built = written(E.build_log(_log_records(spark, sf_dir), "event_id", "record", 100), "chains")
    kind, n = F.col("chain").cast("long") % 8, F.col("sequence")
    size = F.count("*").over(Window.partitionBy("chain"))
    lines = built.withColumn("n", size)
    line = F.when((n != 5) | (F.col("n") <= 5), F.col("line")).when(kind == 1, F.replace("line", F.lit('"event_id":'), F.lit('"event_id":9'))).when(kind == 3, F.lit('{"event_id":1}'))
    # no hash holds a dot, so that none stays as it is
    line = line.when(kind == 4, F.regexp_replace("line", '"previousHash":"..', '"previousHash":"..')).when(kind == 7, F.lit('{"event_id":')).otherwise(F.col("line"))
    gone = ((kind == 2) & (n == 5) & (F.col("n") > 5)) | ((kind == 6) & (n >= F.floor(F.col("n") / 10) * 10) & (F.col("n") >= 10))
    anchors = E.anchors_of(built, 10)
    anchors = anchors.withColumn("event_hash", F.when((F.col("chain").cast("long") % 8 == 5) & (F.col("sequence") == 10), "x").otherwise(F.col("event_hash")))
    found = E.verify_chains(lines.where(~gone).select("chain", n.alias("position"), line.alias("line")), anchors)
    return found.select("chain", "records", "valid", "reason")


#: The log's chains anew: each record's hash holds the one before, so SQL goes along all chains at once, step by step.
_TREE_SQL = """WITH RECURSIVE r AS (SELECT (n - 1) // 200 AS c, (n - 1) % 200 + 1 AS s, event_id, event_type FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id, event_type FROM events)),
h AS (SELECT 0::BIGINT AS s, c, NULL::VARCHAR AS own FROM (SELECT DISTINCT c FROM r) UNION ALL
  SELECT r.s, r.c, rtrim(translate(to_base64(unhex(sha256('{"auditIntegrity":{"alg":"sha256","canonicalization":"json-stable-v1","previousHash":' || coalesce('"' || h.own || '"', 'null') || ',"sequence":' || r.s || '},"event_id":' || r.event_id || ',"event_type":"' || r.event_type || '"}'))), '+/', '-_'), '=')
  FROM h JOIN r ON r.c = h.c AND r.s = h.s + 1),
l0 AS (SELECT c AS place, sha256(c || ':' || max(s) || ':' || max_by(own, s)) AS hash FROM h WHERE s > 0 GROUP BY c),
l1 AS (SELECT place // 16 AS place, sha256(string_agg(hash, '' ORDER BY place)) AS hash FROM l0 WHERE (SELECT count(*) FROM l0) > 1 GROUP BY 1),
l2 AS (SELECT place // 16 AS place, sha256(string_agg(hash, '' ORDER BY place)) AS hash FROM l1 WHERE (SELECT count(*) FROM l1) > 1 GROUP BY 1),
l3 AS (SELECT place // 16 AS place, sha256(string_agg(hash, '' ORDER BY place)) AS hash FROM l2 WHERE (SELECT count(*) FROM l2) > 1 GROUP BY 1)
SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3"""


@query(_TREE_SQL)
def log_tree(spark, sf_dir):
    """The hash tree over one log of all events, in chains of 200."""
    return E.hash_tree(E.chain_heads(E.build_log(_log_records(spark, sf_dir), "event_id", "record", 200)))


@query(f"""WITH l AS (SELECT * FROM ({_LOG}) ORDER BY sequence DESC LIMIT 500) SELECT count(*) AS events, count(*) FILTER (blocked) AS blocked, CAST(sum(n) AS BIGINT) AS detections,
  min(sequence) AS low, max(sequence) AS high, (SELECT count(*) FROM events) <= 500 AS covered FROM l""")
def log_tail(spark, sf_dir):
    """A report over the last 500 events of a log that was written as lines, of which the last bytes alone are read."""
    path = scratch(spark, "log")
    _log(spark, sf_dir).select("audit_integrity.sequence", F.to_json(F.struct("*")).alias("line")).repartitionByRange("sequence").sortWithinPartitions("sequence").select("line").write.text(path)
    kept = written(tail.last_events(spark, path, 500), "tail")
    seen = kept.agg(F.min("audit_integrity.sequence").alias("low"), F.max("audit_integrity.sequence").alias("high"), F.bool_and("covered_from_start").alias("covered"))
    return E.report(kept).select("events", "blocked", "detections").join(seen)


_BOUNDS = (1, 3, 20, 60, 200)


@query(f"""WITH l AS (SELECT event_type, value FROM events) SELECT event_type, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in _BOUNDS)}, round(sum(value), 3) AS total, count(value) AS n FROM l GROUP BY 1""")
def value_histogram(spark, sf_dir):
    h = metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], _BOUNDS)
    return h.select("event_type", *(f"le_{b}" for b in _BOUNDS), F.round("sum", 3).alias("total"), F.col("count").alias("n"))


@query("SELECT event_type AS name, CAST(user_id AS VARCHAR) AS who, count(*) AS value FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2")
def counter_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("name", F.col("event_type")).withColumn("who", F.col("user_id"))
    return metrics.counters(e, ["name", "who"], declared=["error", "view"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = greatest(1, ceil(0.5 * n))) AS p50, max(value) FILTER (k = greatest(1, ceil(0.95 * n))) AS p95, max(value) FILTER (k = greatest(1, ceil(0.99 * n))) AS p99, max(value) AS max, count(*) AS n FROM r GROUP BY 1""")
def nearest_rank_percentiles(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)
SELECT max(v) FILTER (k = greatest(1, ceil(0.01 * n))) AS p1, max(v) FILTER (k = greatest(1, ceil(0.5 * n))) AS p50, max(v) FILTER (k = greatest(1, ceil(0.99 * n))) AS p99, max(v) AS max, count(*) AS n FROM r""")
def percentiles_of_all(spark, sf_dir):
    """Percentiles of a whole table that is one group."""
    return metrics.nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99])


@query("""SELECT kind, count(*) AS requests, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 3) AS seconds, round(count(*) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 0), 9) AS per_second
FROM clicks WHERE ts IS NOT NULL GROUP BY kind""")
def request_rates(spark, sf_dir):
    return metrics.throughput(table(spark, sf_dir, "clicks"), "ts", ["kind"]).select("kind", "requests", F.round("seconds", 3).alias("seconds"), F.round("per_second", 9).alias("per_second"))


@query("SELECT '# HELP value_seconds value_seconds' AS line UNION ALL SELECT '# TYPE value_seconds histogram' UNION ALL "
       "SELECT 'value_seconds_count{event_type=\"' || event_type || '\"} ' || count(value) FROM events GROUP BY event_type UNION ALL "
       "SELECT 'value_seconds_bucket{event_type=\"' || event_type || '\",le=\"' || b || '\"} ' || count(*) FILTER (value <= CAST(replace(b, '+Inf', 'inf') AS DOUBLE)) "
       f"FROM events, (SELECT unnest({[str(b) for b in metrics.BUCKETS] + ['+Inf']}) AS b) GROUP BY event_type, b")
def metric_exposition(spark, sf_dir):
    """The lines but for the sums, whose digits depend on the order of addition."""
    h = metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"])
    return metrics.exposition(h, "value_seconds", ["event_type"]).where(~F.col("line").contains("_sum{"))


# -- scores --


@query("""WITH x AS (SELECT l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT lang AS type, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM x GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT 'all', sum(tp), sum(fp), sum(fn) FROM c)
SELECT type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall FROM a""")
def detection_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    expected = rows.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("type"), (F.col("quality") == 1).alias("present"), F.lit(False).alias("gap"))
    found = rows.where("toxic = 1").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("type"))
    return metrics.scores(metrics.confusion(expected, found).drop("gaps"))


# -- rate limits --


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) ORDER BY ts, event_id) AS hit,
  row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_clock_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return limits.clock_windows(e, "user_id", "ts", 2, 3600).select("event_id", "hit", "allowed")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events),
w AS (SELECT user_id, min(t) AS s FROM e GROUP BY 1 UNION ALL SELECT e.user_id, min(e.t) FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s + 3600000000 GROUP BY 1),
h AS (SELECT event_id, row_number() OVER (PARTITION BY e.user_id, w.s ORDER BY e.t, event_id) AS hit FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.t >= w.s)
SELECT event_id, hit, hit <= 2 AS allowed FROM h""")
def rate_first_hit_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return limits.first_hit_windows(e, "user_id", "ts", 2, 3600).select("event_id", "hit", "allowed")


@query("""WITH RECURSIVE e AS (SELECT click_id, epoch_us(ts) AS t FROM clicks WHERE ts IS NOT NULL),
w AS (SELECT min(t) AS s FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t >= w.s + 7200000000) FROM w WHERE w.s IS NOT NULL),
h AS (SELECT click_id, row_number() OVER (PARTITION BY w.s ORDER BY e.t, click_id) AS hit FROM e ASOF JOIN (SELECT s FROM w WHERE s IS NOT NULL) w ON e.t >= w.s)
SELECT click_id, hit, hit <= 20 AS allowed FROM h""")
def rate_one_key(spark, sf_dir):
    """All clicks as requests of one key, in blocks of 2,000 of them."""
    c = table(spark, sf_dir, "clicks").select(F.lit("all").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "click_id")
    return limits.first_hit_windows(c, "key", "ts", 20, 7200, most=2000).select("click_id", "hit", "allowed")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def rate_key_cap(spark, sf_dir):
    return limits.bounded_keys(table(spark, sf_dir, "events"), "user_id", "ts", 20)


def _requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("server"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query()
def rate_capped_limiter(spark, sf_dir):
    """Limiters that forget, held against a plain fold in the tests."""
    return limits.capped_limiter(_requests(spark, sf_dir), "server", "user_id", "ts", 2, 86400, 8).select("event_id", "hit", "allowed")


@query()
def pending_logins(spark, sf_dir):
    """Stores of entries that are taken once, held against a plain fold in the tests."""
    steps = _requests(spark, sf_dir).withColumn("action", F.when(F.col("event_id") % 3 == 0, "take").otherwise("set"))
    return limits.pending_store(steps, "server", "user_id", "action", "ts", 86400, 4).select("event_id", "action", "ok")


# -- the vault --


def _vault(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("name").alias("type"), F.col("c_name").alias("value"), "c_custkey")
    token = T.vault_token(KEY, F.col("type"), F.col("value"))
    ends = F.expr("timestamp '2024-01-10 00:00:00'") + F.make_dt_interval((F.col("c_custkey") % 30).cast("int"))
    meta = F.map_from_entries(F.array(F.struct(F.lit("note"), F.lit("n")), F.struct(F.lit("value"), F.lit("secret"))))
    return c.select(token.alias("token"), "type", F.expr("timestamp '2024-01-01 00:00:00'").alias("created_at"), ends.alias("expires_at"), meta.alias("metadata"), T.encrypt(F.col("value"), KEY, token).alias("envelope"))


_TOKEN = f"'tok_name_' || substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode('name:' || c_name)))), 1, 32)"


@query(f"""SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL OR o_custkey % 30 < 10 THEN NULL ELSE c_name END AS value,
  CASE WHEN c.c_custkey IS NULL THEN 'unknown_token' WHEN o_custkey % 30 < 10 THEN 'token_expired' END AS reason FROM orders LEFT JOIN customer c ON o_custkey = c_custkey AND o_orderkey % 50 <> 0""")
def vault_reveal(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", T.vault_token(KEY, F.lit("name"), F.col("c_name")).alias("token"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    asked = o.select("o_orderkey", F.when((F.col("o_orderkey") % 50 == 0) | F.col("token").isNull(), "tok_name_none").otherwise(F.col("token")).alias("token"))
    return vault.reveal(asked, _vault(spark, sf_dir), {T.short_id(KEY): KEY}, F.expr(NOW)).select("o_orderkey", "value", "reason")


@query(f"SELECT {_TOKEN} AS token, c_custkey % 30 >= 10 AS reused, CASE WHEN c_custkey % 30 >= 10 THEN '2024-01-01' ELSE '2024-01-20' END AS created FROM customer")
def vault_upsert(spark, sf_dir):
    now = F.expr(NOW)
    new = vault.issue(table(spark, sf_dir, "customer").select(F.lit("name").alias("type"), F.col("c_name").alias("value")), KEY, KEY, now)
    return vault.upsert(_vault(spark, sf_dir), new, now).select("token", "reused", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("SELECT count(*) FILTER (c_custkey % 30 < 10) AS expired, count(*) FILTER (c_custkey % 30 >= 10) AS alive, count(*) FILTER (c_custkey % 30 >= 10 AND c_custkey % 7 <> 0) AS kept FROM customer")
def vault_purge(spark, sf_dir):
    now, v = F.expr(NOW), _vault(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(T.vault_token(KEY, F.lit("name"), F.col("c_name")).alias("token"))
    left = vault.purge_expired(v, now)
    return vault.expired_count(v, now).join(left.agg(F.count("*").alias("alive"))).join(vault.purge(left, gone).agg(F.count("*").alias("kept")))


@query(f"SELECT {_TOKEN} AS token, 'name' AS type, 'note' AS keys FROM customer")
def vault_export(spark, sf_dir):
    return vault.exported(_vault(spark, sf_dir), "name").select("token", "type", F.array_join(F.map_keys("metadata"), ",").alias("keys"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', again ' || c_name AS text FROM customer")
def restore_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", T.vault_token(KEY, F.lit("name"), F.col("c_name")).alias("t"))
    said = F.concat(F.lit("Dear "), F.col("t"), F.lit(", again "), F.col("t"))
    return c.select("c_custkey", trees.restore_tokens(said, F.create_map("t", "c_name")).alias("text"))


# -- access --


@query(r"""SELECT page_id, url, CASE WHEN p = '/' THEN 'home' WHEN p = '/en/25' THEN 'exact' WHEN ends_with(p, ':stream') THEN 'gen' WHEN ends_with(p, ':batch') THEN 'many' END AS route_id, p AS path FROM
  (SELECT page_id, url, CASE WHEN q = '' THEN '/' WHEN page_id % 5 = 1 THEN q || ':stream' WHEN page_id % 5 = 2 THEN q || ':batch' WHEN page_id % 5 = 3 THEN q || ':stream/x' ELSE q END AS p FROM
    (SELECT page_id, url, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '') AS q FROM pages))""")
def match_routes(spark, sf_dir):
    """Routes of pages' paths, exact ones and those told by what follows the last colon."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1), F.lit(""))
    ends = F.element_at(F.array(*(F.lit(x) for x in ("", ":stream", ":batch", ":stream/x", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = rows.withColumn("path", F.when(path == "", "/").otherwise(F.concat(path, ends)))
    routes = spark.createDataFrame([("home", 0, "/", None), ("exact", 1, "/en/25", None), ("gen", 2, None, ":stream"), ("later", 4, None, ":stream"), ("many", 3, None, ":batch")], "route_id string, position int, path string, suffix string")
    return access.routed(rows, routes).select("page_id", "url", "route_id", "path")


@query("""WITH a AS (SELECT c_custkey, c_custkey * 2654435761 % 4294967296 AS n FROM customer), o AS (SELECT c_custkey, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM a)
SELECT c_custkey, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) AS blocked,
  a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) AS blocked_any FROM o""")
def blocked_addresses(spark, sf_dir):
    n = F.pmod(F.col("c_custkey") * F.lit(2654435761), F.lit(4294967296))
    octet = lambda k: F.floor(n / k) % 256
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(".", *(octet(k).cast("string") for k in (16777216, 65536, 256, 1))).alias("ip"))
    return rows.select("c_custkey", access.blocked_ipv4(F.col("ip")).alias("blocked"), access.blocked_address(F.concat(F.lit("::ffff:"), F.col("ip"))).alias("blocked_any"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN 'u' || (o_custkey % 100) END AS id FROM orders")
def authenticate(spark, sf_dir):
    ids = [(f"t{k}", f"u{k}", "user", ["s"], {}, k % 5 == 0) for k in range(100)]
    known = spark.createDataFrame(ids, "token string, id string, type string, scopes array<string>, labels map<string,string>, disabled boolean")
    records = known.select(F.sha2("token", 256).alias("token_hash"), "id", "type", "scopes", "labels", "disabled", F.substring("id", 2, 9).cast("int").alias("position"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Bearer t"), (F.col("o_custkey") % 100).cast("string")).alias("authorization"))
    return access.authenticated(asked, records).select("o_orderkey", "id")


@query(r"SELECT c_custkey, regexp_replace(substr(c_name, 1, 64), '[^A-Za-z0-9_.:/-]', '_', 'g') AS label, 'p:' || substr(sha256(c_name), 1, 16) AS external FROM customer")
def labels_and_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.label_value(F.col("c_name")).alias("label"), T.external_id(F.lit("p"), F.sha2("c_name", 256)).alias("external"))


# -- streams --


def _frames(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    data = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    return c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), data).alias("frame"))


#: Characters of a frame of a document's stream: addresses are split over frames.
_PIECE = 300


def _pieces(spark, sf_dir) -> DataFrame:
    """Each document as a stream: frames of pieces of its text. No frame ends it."""
    d = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    cut = d.select(F.col("doc_id").cast("string").alias("stream_id"), F.posexplode(pieces).alias("seq", "piece"))
    data = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices")))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.concat(F.lit("data: "), data).alias("frame"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:email]', 'g') AS text FROM documents WHERE text IS NOT NULL")
def stream_rewrite(spark, sf_dir):
    """The text of each stream after its frames went through the buffer: addresses are gone, those split over frames too."""
    return _said(rewriter.rewrite_batch(_pieces(spark, sf_dir), P.build(actions={"email": "redact"}, mode="enforce", default="allow")))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents WHERE regexp_matches(text, '{EMAIL_SQL}')")
def stream_tallies(spark, sf_dir):
    found = rewriter.tallies(_pieces(spark, sf_dir), P.build(actions={"email": "redact"}, mode="enforce", default="allow"))
    return found.where("field = 'type' and name = 'email'").select(F.col("stream_id").cast("long").alias("doc_id"), "n")


def _said(out: DataFrame) -> DataFrame:
    """doc_id and text of each stream of a document, its frames in order."""
    text = F.get_json_object(frames.frame_data(F.col("frame")), "$.choices[0].delta.content")
    found = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place", text.alias("t")))).alias("x"))
    return found.select(F.col("stream_id").cast("long").alias("doc_id"), F.array_join(F.transform("x", lambda x: x["t"]), "").alias("text"))


@query(f"""SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[SEALED]', 'g') AS text, array_to_string(regexp_extract_all(text, '{EMAIL_SQL}'), ' ') AS opened, 0 AS opened_elsewhere
  FROM documents WHERE text IS NOT NULL""")
def stream_sealed(spark, sf_dir):
    """Addresses in streams under envelopes, which open with what they are bound to, the stream among it, and not otherwise."""
    keys = rewriter.Keys(KEY)
    out = rewriter.rewrite_batch(_pieces(spark, sf_dir), P.build(actions={"email": "encrypt"}, mode="enforce", default="allow"), keys=keys, aad=F.col("stream_id"))
    said = written(_said(out), "sealed")
    bound = lambda stream: trees.seal_aad(stream, F.lit(trees.safe_path(())), F.lit("email"), F.lit("email"))
    values, other = (trees.opened(F.col("text"), {T.short_id(KEY): KEY}, bound(x)) for x in (F.col("doc_id").cast("string"), F.lit("other")))
    return said.select("doc_id", F.regexp_replace("text", r"\[SEALED:[A-Za-z0-9_-]+\]", "[SEALED]").alias("text"), F.array_join(values, " ").alias("opened"), F.size(F.filter(other, F.isnotnull)).alias("opened_elsewhere"))


_EMAIL_TOKEN = f"'tok_email_' || substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode('email:' || v)))), 1, 32)"


@query(f"""SELECT doc_id, array_to_string(flatten(list_transform(list_zip(regexp_split_to_array(text, '{EMAIL_SQL}'), list_transform(regexp_extract_all(text, '{EMAIL_SQL}'), lambda v: '[TOKEN:' || {_EMAIL_TOKEN} || ']')), lambda x: [x[1], x[2]])), '') AS text,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))), ' ') AS revealed FROM documents WHERE text IS NOT NULL""")
def stream_vault(spark, sf_dir):
    """Tokens of the vault in streams, and what the vault that comes of them reveals for each document."""
    out = written(rewriter.rewrite_batch(_pieces(spark, sf_dir), P.build(actions={"email": "tokenize"}, mode="enforce", default="allow"), keys=rewriter.Keys(KEY, KEY)), "tokens")
    now = F.expr(NOW)
    used = out.select(F.col("stream_id").cast("long").alias("doc_id"), F.explode("issued.token").alias("token")).distinct()
    told = vault.reveal(used, vault.records(out, now), {T.short_id(KEY): KEY}, now).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("value")), " ").alias("revealed"))
    return _said(out).join(told, "doc_id", "left").select("doc_id", "text", F.coalesce("revealed", F.lit("")).alias("revealed"))


@query("SELECT conv_id, count(*) AS frames, count(*) AS json FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def split_frames(spark, sf_dir):
    joined = _frames(spark, sf_dir).groupBy("stream_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]), "\n\n"), F.lit("\n\n")).alias("raw"))
    found = frames.split_frames(joined, "raw", "sse")
    kind = frames.frame_kind(frames.frame_data(F.col("frame")))
    return found.groupBy(F.col("stream_id").cast("long").alias("conv_id")).agg(F.count("*").alias("frames"), F.count_if(kind == "json").alias("json"))


@query("SELECT conv_id, turn, text FROM conversations")
def frames_of_files(spark, sf_dir):
    """Turns of conversations as events in files, read back by the source that also reads files while they grow."""
    path, c = scratch(spark, "frames"), table(spark, sf_dir, "conversations")
    said = F.to_json(F.struct("conv_id", "turn", "text"))
    c.select(F.concat(F.lit("event: turn\ndata: "), said, F.lit("\n")).alias("value")).write.text(path)
    one = F.from_json(frames.frame_data(F.col("frame")), "conv_id long, turn long, text string")
    return growing.frames_of(spark, path).select(one.alias("r")).select("r.*")


_PAIRS = """WITH f AS (SELECT CAST(client_id AS VARCHAR) AS session, CAST(json_extract(CASE WHEN json_valid(props) THEN props END, '$.k') AS VARCHAR) AS rpc_id, kind = 'view' AS asks, kind, epoch_us(ts) AS t, click_id
  FROM clicks WHERE kind IN ('view', 'click') AND ts IS NOT NULL),
n AS (SELECT *, lead(asks) OVER w AS nx, lag(asks) OVER w AS bf, lead(t) OVER w - t < 86400000000 AS soon, t - lag(t) OVER w < 86400000000 AS just, lead(t) OVER w AS nt FROM f WHERE rpc_id <> 'null'
  WINDOW w AS (PARTITION BY session, rpc_id ORDER BY t, asks DESC, click_id)),
o AS (SELECT *, CASE WHEN NOT asks THEN CASE WHEN NOT coalesce(bf AND just, false) THEN 'unasked' END WHEN soon AND NOT nx THEN 'answered' WHEN soon THEN 'repeated' ELSE 'unanswered' END AS outcome FROM n)
SELECT session, rpc_id, outcome, CASE WHEN asks THEN kind END AS method, CASE WHEN asks THEN t END AS asked_us, CASE WHEN outcome = 'answered' THEN nt WHEN NOT asks THEN t END AS answered_us FROM o WHERE outcome IS NOT NULL"""


@query(_PAIRS)
def rpc_pairing(spark, sf_dir):
    """Views as requests and clicks as responses of a client's session, in JSON-RPC lines, with a day to answer."""
    c = table(spark, sf_dir, "clicks").where("kind IN ('view', 'click')")
    k = F.to_json(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    line = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(k, F.lit("null")), F.lit(',"method":"'), "kind", F.lit('"}'))
    rows = c.select(F.col("client_id").alias("session"), F.when(F.col("kind") == "view", "request").otherwise("response").alias("direction"), F.col("ts").alias("at"), F.col("click_id").alias("seq"), line.alias("line"))
    found = pairing.paired(rows, 86400)
    return found.select("session", "rpc_id", "outcome", "method", F.unix_micros("asked_at").alias("asked_us"), F.unix_micros("answered_at").alias("answered_us"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their e-mail addresses redacted."""
    return redact_emails(spark, sf_dir)


@query("""WITH s AS (SELECT conv_id, turn, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
SELECT conv_id, turn, upto > 1000 AS truncated FROM s WHERE upto - n <= 1000""")
def pass_through_cap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return frames.capped(c, 1000, "conv_id", "turn", "text").select("conv_id", "turn", "truncated")


from veilgrid.plans import table_checks  # noqa: E402, F401  registers its own
