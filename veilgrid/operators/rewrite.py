"""Precision dials, decisions and the rewriting of texts, natively over arrays of spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators.policy import Policy
from veilgrid.operators.rules import HARD_TYPES


def precise(found: Column, min_confidence: float | None = None, allow: Iterable[dict] = (), path: Column | None = None) -> Column:
    """kept, suppressed, dropped: spans after the dials. ``allow`` has entries with a value, a path or both; what they name
    is suppressed, what is less sure than ``min_confidence`` is dropped, and neither touches hard types."""
    hard = lambda s: s["type"].isin(sorted(HARD_TYPES))
    entries = [e if isinstance(e, dict) else {"value": e} for e in allow]
    values = sorted({e["value"] for e in entries if "value" in e and "path" not in e})
    paths = sorted({e["path"] for e in entries if "path" in e and "value" not in e})
    pairs = sorted({(e["value"], e["path"]) for e in entries if "value" in e and "path" in e})
    if any("value" not in e and "path" not in e for e in entries):
        raise ValueError("an allowed entry needs a value or a path")
    at = F.lit("") if path is None else path

    def named(s: Column) -> Column:
        out = s["value"].isin(values) if values else F.lit(False)
        if paths:
            out = out | at.isin(paths)
        for v, p in pairs:
            out = out | ((s["value"] == v) & (at == p))
        return out & ~hard(s)

    unsure = lambda s: (s["confidence"] < min_confidence) & ~hard(s) if min_confidence is not None else F.lit(False)
    return F.struct(
        F.filter(found, lambda s: ~named(s) & ~unsure(s)).alias("kept"),
        F.filter(found, named).alias("suppressed"),
        F.filter(found, lambda s: ~named(s) & unsure(s)).alias("dropped"),
    )


def fates(found: DataFrame, allowed: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Rows of spans with fate added: kept, suppressed or dropped, as ``precise`` has them, for an allow list that is a
    table of values of any size."""
    hard = F.col("type").isin(sorted(HARD_TYPES))
    values = allowed.select(F.col("value").alias("_allowed")).distinct()
    unsure = F.col("confidence") < min_confidence if min_confidence is not None else F.lit(False)
    fate = F.when(hard, "kept").when(F.col("_allowed").isNotNull(), "suppressed").when(unsure, "dropped").otherwise("kept")
    return found.join(values, F.col("value") == F.col("_allowed"), "left").withColumn("fate", fate).drop("_allowed")


def with_actions(found: Column, policy: Policy) -> Column:
    """Spans with action, reason and mode."""
    return F.transform(found, lambda s: s.withField("action", policy.action(s["type"])).withField("reason", F.concat(F.lit("matched:"), s["rule_id"])).withField("mode", F.lit(policy.mode)))


def blocked(decided: Column, policy: Policy) -> Column:
    return F.exists(decided, lambda s: s["action"] == "block") if policy.enforced else F.lit(False)


def replacement(span: Column, key: bytes | None = None, sealing_key: bytes | None = None, aad: Column | None = None) -> Column:
    """What takes a span's place. With ``key`` tokens are those of the vault, else they are plain; without
    ``sealing_key`` what should be encrypted is redacted."""
    kind, value = span["type"], span["value"]
    token = F.concat(F.lit("[TOKEN:"), T.vault_token(key, kind, value), F.lit("]")) if key else T.plain_token(kind, value)
    sealed = T.redacted(kind)
    if sealing_key:
        sealed = F.concat(F.lit("[SEALED:"), T.base64url(F.encode(F.to_json(T.encrypt(value, sealing_key, F.lit("") if aad is None else aad)), "UTF-8")), F.lit("]"))
    return F.when(span["action"] == "mask", T.mask(value)).when(span["action"] == "tokenize", token).when(span["action"] == "encrypt", sealed).otherwise(T.redacted(kind))


def rewritten(text: Column, decided: Column, **how) -> Column:
    """The text with its spans replaced, from the left; allowed and blocked ones stay, overlapping ones are passed over."""
    used = F.array_sort(F.filter(decided, lambda s: ~s["action"].isin("allow", "block")), lambda a, b: a["start"] - b["start"])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), replacement(s, **how)).alias("out"), s["end"].alias("at")))
    return F.when(F.size(used) == 0, text).otherwise(F.aggregate(used, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))))


def issued(decided: Column, key: bytes | None = None) -> Column:
    """The distinct tokens that a text's rewriting gives out, in the order in which they first stand."""
    given = F.filter(F.array_sort(decided, lambda a, b: a["start"] - b["start"]), lambda s: s["action"] == "tokenize")
    return F.array_distinct(F.transform(given, lambda s: T.vault_token(key, s["type"], s["value"]) if key else T.plain_token(s["type"], s["value"])))


def counts(found: Column, field: str) -> Column:
    """A map from a field's values to how often spans have them."""
    values = F.transform(found, lambda s: s[field])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).cast("long"))))


def summary(decided: Column, suppressed: Column | None = None, dropped: Column | None = None) -> Column:
    extra = [counts(c, "type").alias(n) for n, c in (("suppressed", suppressed), ("dropped", dropped)) if c is not None]
    return F.struct(F.size(decided).cast("long").alias("detection_count"), counts(decided, "type").alias("by_type"), counts(decided, "action").alias("by_action"), *extra)


def protect(rows: DataFrame, policy: Policy, text: str = "text", direction: str = "request", min_confidence: float | None = None, allow: Iterable[dict] = (), custom=(), only=None, decode: bool = False, **how) -> DataFrame:
    """Rows with out (the text as the policy wants it; null if blocked), blocked, and summary. Dry runs change nothing."""
    from veilgrid.operators.detect import spans

    found = rows.withColumn("_found", spans(F.coalesce(F.col(text), F.lit("")), direction, custom, only, decode=decode))
    dialled = found.withColumn("_dialled", precise(F.col("_found"), min_confidence, allow)).withColumn("decided", with_actions(F.col("_dialled.kept"), policy))
    stop = blocked(F.col("decided"), policy)
    new = rewritten(F.col(text), F.col("decided"), **how) if policy.enforced else F.col(text)
    return dialled.withColumns({"blocked": stop, "out": F.when(~stop, new), "summary": summary(F.col("decided"), F.col("_dialled.suppressed"), F.col("_dialled.dropped"))}).drop("_found", "_dialled")
