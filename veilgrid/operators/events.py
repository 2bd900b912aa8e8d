"""The event log: building events, hash chains and their verification, reports, paging, projections."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.operators.trees import shape_hash
from veilgrid.plans.ranks import ranked
from veilgrid.sources.shared import written

# -- fixed values --
FORBIDDEN = frozenset(
    "value plaintext payload content message prompt secret access_token id_token refresh_token code code_verifier client_secret state nonce "
    "claims subject issuer credential authorization signature entry scopes labels".split())
DECISIONS = ("redact", "mask", "tokenize", "encrypt", "block", "allow", "pass", "deny")
EVENT_FIELDS = "schema_version id correlation_id timestamp protocol operation mode enforced blocked direction payload_shape_hash".split()
# -- end of fixed values --
PAGE_DEFAULT, PAGE_MOST = 50, 200
DETECTION = "struct<type:string,rule_id:string,path:string,kind:string,confidence:double,action:string,enforced:boolean>"
IDENTITY = "struct<id:string,type:string,subject_hash:string,issuer_hash:string,provider:string>"
SUMMARY = "struct<detection_count:bigint,by_type:map<string,bigint>,by_action:map<string,bigint>>"
INTEGRITY = "struct<alg:string,canonicalization:string,sequence:bigint,previous_hash:string,event_hash:string>"
EVENT = (
    f"schema_version string, id string, correlation_id string, timestamp string, protocol string, operation string, identity {IDENTITY}, profile string, "
    f"mode string, enforced boolean, blocked boolean, direction string, payload_shape_hash string, detections array<{DETECTION}>, summary {SUMMARY}, "
    f"decision string, reason string, route_id string, path_hash string, audit_integrity {INTEGRITY}"
)
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def event_columns(policy, protocol: str, operation: str, timestamp: Column, event_id: Column, payload: Column | None = None, decided: str = "decided", located: bool = False) -> dict[str, Column]:
    """Columns of an event for rows that ``protect`` made, or, with ``located``, those of ``found`` that ``protect_json``
    made, which say where in the payload they are; no text of the payload is among them."""
    path, kind = (lambda s: s["path"], lambda s: s["kind"]) if located else (lambda s: F.lit("$"), lambda s: F.lit("value"))
    found = F.transform(decided, lambda s: F.struct(s["type"].alias("type"), s["rule_id"].alias("rule_id"), path(s).alias("path"), kind(s).alias("kind"), s["confidence"].alias("confidence"), s["action"].alias("action"), F.lit(policy.enforced).alias("enforced")))
    return {
        "schema_version": F.lit("1"), "id": event_id, "timestamp": F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "protocol": F.lit(protocol), "operation": F.lit(operation),
        "mode": F.lit(policy.mode), "enforced": F.lit(policy.enforced), "detections": found, "payload_shape_hash": shape_hash(payload) if payload is not None else F.lit(None).cast("string"),
    }


def sanitized(text: Column) -> Column:
    """JSON without the forbidden keys, at any depth; null for what is no JSON. In a vectorised function."""

    def strip(v):
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in FORBIDDEN}
        return [strip(x) for x in v] if isinstance(v, list) else v

    def one(t):
        try:
            return json.dumps(strip(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(text)


def projected(events: DataFrame) -> DataFrame:
    """Events with the fields that may be shown, and no others; fields that a log lacks are null."""
    has = set(events.columns)
    pick = [(F.col(c) if c in has else F.lit(None).cast("string")).alias(c) for c in EVENT_FIELDS]
    ident = F.when(F.col("identity").isNotNull(), F.struct(*(F.col(f"identity.{c}").alias(c) for c in ("id", "type", "subject_hash", "issuer_hash", "provider")))) if "identity" in has else F.lit(None).cast(IDENTITY)
    none = F.create_map().cast("map<string,bigint>")
    count = lambda c: F.coalesce(F.map_filter(F.col(f"summary.{c}"), lambda k, v: v.isNotNull()), none)
    summary = F.struct(F.coalesce("summary.detection_count", F.lit(0).cast("long")).alias("detection_count"), count("by_type").alias("by_type"), count("by_action").alias("by_action"))
    integrity = F.struct(*(F.col(f"audit_integrity.{c}").alias(c) for c in ("sequence", "previous_hash", "event_hash"))) if "audit_integrity" in has else F.lit(None).cast("struct<sequence:bigint,previous_hash:string,event_hash:string>")
    found = F.coalesce("detections", F.array().cast(f"array<{DETECTION}>")) if "detections" in has else F.array().cast(f"array<{DETECTION}>")
    return events.select(*pick, ident.alias("identity"), found.alias("detections"), summary.alias("summary"), integrity.alias("audit_integrity"))


def report(events: DataFrame) -> DataFrame:
    """One row: events, blocked, detections, by_type, by_action."""
    totals = events.agg(F.count("*").alias("events"), F.count_if("blocked").alias("blocked"), F.coalesce(F.sum("summary.detection_count"), F.lit(0)).alias("detections"))

    def merged(name: str) -> DataFrame:
        sums = events.select(F.explode(f"summary.{name}")).groupBy("key").agg(F.sum("value").alias("value"))
        return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))

    return totals.join(F.broadcast(merged("by_type"))).join(F.broadcast(merged("by_action")))


def page(events: DataFrame, limit: int = PAGE_DEFAULT, cursor: int | None = None, correlation_id: str | None = None, decision: str | None = None) -> DataFrame:
    """The newest events before a cursor, filtered, newest first. Only the top of a sort leaves each task."""
    import re

    if not 1 <= limit <= PAGE_MOST:
        raise ValueError(f"limit must be from 1 to {PAGE_MOST}")
    if correlation_id is not None and not re.match(UUID, correlation_id):
        raise ValueError("correlation_id must be a UUID")
    if decision is not None and decision not in DECISIONS:
        raise ValueError("unknown decision")
    rows = projected(events).where(F.col("audit_integrity.sequence").isNotNull())
    if cursor is not None:
        rows = rows.where(F.col("audit_integrity.sequence") < cursor)
    if correlation_id is not None:
        rows = rows.where(F.lower("correlation_id") == correlation_id.lower())
    if decision is not None:
        rows = rows.where(F.map_contains_key("summary.by_action", F.lit(decision)))
    return rows.orderBy(F.desc("audit_integrity.sequence")).limit(limit)


def next_cursor(shown: DataFrame, limit: int) -> DataFrame:
    """One row: the cursor of the next page, null on the last one, and the smallest sequence shown."""
    low = shown.agg(F.min("audit_integrity.sequence").alias("low"), F.count("*").alias("n"))
    return low.select(F.when(F.col("n") == limit, F.col("low")).alias("next_cursor"), "low")


def window_exceeded(kept: DataFrame, cursor: int) -> DataFrame:
    """One row: low, the smallest sequence of a log's last records (with covered_from_start), and exceeded, whether what
    comes before the cursor lies before them. An empty tail reaches back to the start."""
    low = kept.agg(F.min("audit_integrity.sequence").alias("low"), F.coalesce(F.bool_and("covered_from_start"), F.lit(True)).alias("covered_from_start"))
    return low.withColumn("exceeded", ~F.col("covered_from_start") & (F.lit(cursor) <= F.col("low")))


# -- chains --


#: ``canonical`` and a line's form, without a new encoder for each record.
_CANONICAL, _LINE = (json.JSONEncoder(sort_keys=s, separators=(",", ":"), ensure_ascii=False).encode for s in (True, False))


def _hash(value: dict) -> str:
    return base64.urlsafe_b64encode(hashlib.sha256(_CANONICAL(value).encode()).digest()).decode().rstrip("=")


def chained(records: Iterator[dict], previous: dict | None = None) -> Iterator[dict]:
    """Records with integrity blocks: each holds its number, the hash before it and its own."""
    for r in records:
        block = {"alg": "sha256", "canonicalization": "json-stable-v1", "sequence": previous["sequence"] + 1 if previous else 1, "previousHash": previous["eventHash"] if previous else None}
        block["eventHash"] = _hash({**r, "auditIntegrity": block})
        previous = block
        yield {**r, "auditIntegrity": block}


def build_chains(records: DataFrame, chain: str, position: str, record: str) -> DataFrame:
    """chain, sequence, line: the JSON lines of a chain for each value of ``chain``. A chain is sequential by its nature, so
    many chains (one for each source, day or writer) are what runs in parallel; within one, rows stream in order."""

    def run(batches):
        import pyarrow as pa

        last: dict = {}
        for batch in batches:
            out = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in last:
                    last = {c: None}  # rows come sorted by chain
                done = next(chained(iter([json.loads(text)]), last[c]))
                last[c] = done["auditIntegrity"]
                out.append((c, last[c]["sequence"], _LINE(done)))
            c, n, t = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.string())], ["chain", "sequence", "line"])

    rows = records.select(F.col(chain).cast("string").alias("chain"), F.col(position).alias("_p"), F.col(record).alias("line"))
    return rows.repartition("chain").sortWithinPartitions("chain", "_p").select("chain", "line").mapInArrow(run, "chain string, sequence long, line string")


def chain_after(rows: DataFrame, previous: dict | None, more: dict) -> DataFrame:
    """sequence, line: records (``line`` in the order of ``_p``) as the next ones of a chain, each with the fields of ``more``."""

    def run(batches):
        import pyarrow as pa

        last = previous
        for batch in batches:
            done = list(chained(({**json.loads(t), **more} for t in batch.column("line").to_pylist()), last))
            if done:
                last = done[-1]["auditIntegrity"]
            lines = [_LINE(r) for r in done]
            yield pa.RecordBatch.from_arrays([pa.array([r["auditIntegrity"]["sequence"] for r in done], pa.int64()), pa.array(lines, pa.string())], ["sequence", "line"])

    return rows.repartition(1).sortWithinPartitions("_p").mapInArrow(run, "sequence long, line string")


def _checked(lines: Column) -> Column:
    """sequence, previous, own hash and the hash that the record should have, all null without an integrity block; and
    whether the line is a JSON object at all."""

    @F.pandas_udf("struct<sequence:bigint,previous:string,own:string,right:string,whole:boolean>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                r = json.loads(t)
                block = r.get("auditIntegrity") or {}
                unsigned = {k: v for k, v in block.items() if k != "eventHash"}
                number = block.get("sequence")
                rows.append((number if isinstance(number, int) else None, block.get("previousHash"), block.get("eventHash"), _hash({**r, "auditIntegrity": unsigned}) if block else None, True))
            except (ValueError, AttributeError, RecursionError):
                rows.append((None, None, None, None, False))
        out = pd.DataFrame(rows, columns=["sequence", "previous", "own", "right", "whole"])
        return out.astype({"sequence": "Int64"})

    return run(lines)


def verify_chains(lines: DataFrame, anchors: DataFrame | None = None, chain: str = "chain", position: str = "position", line: str = "line") -> DataFrame:
    """chain, valid, records, reason, head_hash, truncated: the first fault of each chain, found in parallel. Each row's
    hash is worked out by itself; numbers come from ranges of rows and predecessors from a join on chain and number, so a
    chain that is the whole log is verified by many tasks. A line that is no JSON is a fault of its chain alone.
    ``anchors`` has chain, sequence and event_hash; of several for a sequence the last counts by its ``position``."""
    rows = lines.where(F.trim(F.col(line)) != "").select(F.col(chain).cast("string").alias("chain"), F.col(position).alias("position"), _checked(F.col(line)).alias("c"))
    rows = rows.select("chain", "position", "c.sequence", "c.previous", "c.own", "c.whole", F.col("c.own").eqNullSafe(F.col("c.right")).alias("fits"))
    # written, as cutting rows into ranges looks at them twice
    rows = written(rows, "checked")
    rows = ranked(rows, ["chain"], [F.col("position"), F.col("sequence"), F.col("own")], "expected")
    before = rows.select(F.col("chain").alias("_chain"), (F.col("expected") + 1).alias("_next"), F.col("own").alias("before"))
    rows = rows.join(before, F.col("chain").eqNullSafe(F.col("_chain")) & (F.col("expected") == F.col("_next")), "left").drop("_chain", "_next")
    if anchors is not None:
        held = anchors.groupBy(F.col("chain").cast("string").alias("chain"), F.col("sequence").alias("expected")).agg(F.max_by("event_hash", "position").alias("anchor"))
        rows = rows.join(held, ["chain", "expected"], "left")
    else:
        rows = rows.withColumn("anchor", F.lit(None).cast("string"))
    fault = (
        F.when(~F.col("whole"), "no JSON")
        .when(F.col("own").isNull() & F.col("sequence").isNull(), "no integrity block")
        .when(~F.col("sequence").eqNullSafe(F.col("expected")), "wrong sequence")
        .when(~F.col("previous").eqNullSafe(F.col("before")), "wrong previous hash")
        .when(~F.col("fits"), "wrong hash")
        .when(F.col("anchor") != F.col("own"), F.concat(F.lit("not the anchored hash at "), F.col("expected").cast("string")))
    )
    rows = rows.withColumn("fault", fault)
    bad = F.min(F.when(F.col("fault").isNotNull(), F.struct("expected", "fault")))
    out = rows.groupBy("chain").agg(F.count("*").alias("n"), bad.alias("bad"), F.max_by("own", "expected").alias("head"))
    if anchors is not None:
        out = out.join(anchors.groupBy(F.col("chain").cast("string").alias("chain")).agg(F.max("sequence").alias("attested")), "chain", "left")
    else:
        out = out.withColumn("attested", F.lit(None).cast("long"))
    cut = F.col("bad").isNull() & (F.col("attested") > F.col("n"))
    short = F.concat(F.lit("cut short: it has "), F.col("n").cast("string"), F.lit(" records and is anchored up to "), F.col("attested").cast("string"))
    valid = F.col("bad").isNull() & ~F.coalesce(cut, F.lit(False))
    return out.select(
        "chain", valid.alias("valid"), F.coalesce(F.col("bad.expected") - 1, "n").alias("records"), F.coalesce("bad.fault", F.when(cut, short)).alias("reason"),
        F.when(valid, F.col("head")).alias("head_hash"), F.startswith(F.coalesce("bad.fault", F.when(cut, short), F.lit("")), F.lit("cut short")).alias("truncated"))


def build_log(records: DataFrame, position: str, record: str, most: int = 10_000) -> DataFrame:
    """chain, sequence, line: one log, in the order of ``position``, as chains of ``most`` records. Each chain is a task's
    work; :func:`hash_tree` binds their ends together."""
    rows = ranked(records.select(F.col(position).alias("_p"), F.col(record).alias("_t")), [], [F.col("_p"), F.col("_t")], "_n")
    return build_chains(rows.withColumn("_c", F.floor((F.col("_n") - 1) / most)), "_c", "_n", "_t")


#: Children of a node of a log's hash tree.
TREE_FAN = 16


def chain_heads(chains: DataFrame) -> DataFrame:
    """chain, records, head: the last hash of each of built chains."""
    own = F.get_json_object("line", "$.auditIntegrity.eventHash")
    return chains.groupBy("chain").agg(F.count("*").alias("records"), F.max_by(own, "sequence").alias("head"))


def hash_tree(heads: DataFrame) -> DataFrame:
    """level, place, hash: the tree over the heads of a log's chains, numbered from 0. A leaf is the SHA-256 of its chain, number of
    records and head, a node that of its children's hashes in a row; the top has place 0 and no neighbour. Each
    level is a sixteenth of the one below, written before the next is made."""
    leaf = F.sha2(F.concat_ws(":", "chain", F.col("records").cast("string"), "head"), 256)
    level = written(heads.select(F.lit(0).alias("level"), F.col("chain").cast("long").alias("place"), leaf.alias("hash")), "tree")
    tree, k, most = level, 0, level.agg(F.max("place")).first()[0] or 0
    while most > 0:
        k, most = k + 1, most // TREE_FAN
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"]), "")
        level = level.groupBy(F.floor(F.col("place") / TREE_FAN).alias("above")).agg(F.sha2(children, 256).alias("hash"))
        level = written(level.select(F.lit(k).alias("level"), F.col("above").alias("place"), "hash"), "tree")
        tree = tree.unionByName(level)
    return tree


def inclusion_proofs(tree: DataFrame, chains: DataFrame) -> DataFrame:
    """chain, proof: for each chain of ``chains`` the hashes of its group at each level of the tree (level, at, hashes)."""
    groups = tree.groupBy("level", F.floor(F.col("place") / TREE_FAN).alias("above")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"]).alias("hashes"))
    levels = tree.groupBy("level").agg(F.count("*").alias("n")).where("n > 1").select("level")
    asked = chains.select(F.col("chain").cast("long").alias("chain")).distinct().join(levels)
    step = F.expr(f"cast(power({TREE_FAN}, level) AS BIGINT)")
    asked = asked.withColumn("place", F.floor(F.col("chain") / step)).withColumn("above", F.floor(F.col("place") / TREE_FAN))
    found = asked.join(groups, ["level", "above"])
    proof = F.array_sort(F.collect_list(F.struct("level", (F.col("place") % TREE_FAN).cast("int").alias("at"), "hashes")))
    return found.groupBy("chain").agg(proof.alias("proof"))


def proves(chain: int, records: int, head: str, proof: list[dict], root: str) -> bool:
    """Whether a chain's end belongs to the log with a tree's top."""
    now = hashlib.sha256(f"{chain}:{records}:{head}".encode()).hexdigest()
    for step in sorted(proof, key=lambda s: s["level"]):
        if not step["at"] < len(step["hashes"]) or step["hashes"][step["at"]] != now:
            return False
        now = hashlib.sha256("".join(step["hashes"]).encode()).hexdigest()
    return now == root


def anchors_of(chains: DataFrame, every: int) -> DataFrame:
    """chain, sequence, event_hash, position: each ``every``-th record of built chains."""
    rows = chains.where(F.col("sequence") % every == 0)
    return rows.select("chain", "sequence", F.get_json_object("line", "$.auditIntegrity.eventHash").alias("event_hash"), F.col("sequence").alias("position"))


def last_records(events: DataFrame, chain: str = "chain") -> DataFrame:
    """The integrity block of each chain's last record."""
    return events.groupBy(chain).agg(F.max_by("audit_integrity", "audit_integrity.sequence").alias("audit_integrity"))
