"""The token vault as a table: token, type, created_at, expires_at, metadata, envelope. Every change is a new table made
from the old one by joins on the token, so any table format or a rename of folders can commit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T

REASONS = ("reveal_policy_disabled", "unknown_token", "token_expired", "decrypt_failed", "reveal_error")
RECORD = "token string, type string, created_at timestamp, expires_at timestamp, metadata map<string,string>, envelope struct<v:int,alg:string,kid:string,iv:string,ct:string,tag:string,aad_hash:string,aad_encoding:string>"


def alive(vault: DataFrame, now: Column) -> DataFrame:
    """Records that have not expired; one expires after its time, not at it."""
    return vault.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def issue(values: DataFrame, key: bytes, sealing_key: bytes, now: Column, days: int = 30) -> DataFrame:
    """Records for distinct (type, value) pairs; equal pairs get equal tokens."""
    rows = values.select("type", "value").where(F.col("value").isNotNull()).distinct()
    token = T.vault_token(key, F.col("type"), F.col("value"))
    return rows.select(
        token.alias("token"), "type", now.alias("created_at"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"),
        F.create_map().cast("map<string,string>").alias("metadata"), T.encrypt(F.col("value"), sealing_key, token).alias("envelope"))


def records(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Records of the tokens that rewriting issued (issued: token, type, path, rule_id, envelope), each once, with where
    one of its values was found."""
    found = rows.select(F.explode("issued").alias("i")).groupBy("i.token").agg(F.min_by("i", F.struct("i.path", "i.rule_id")).alias("i"))
    meta = F.map_from_arrays(F.array(F.lit("path"), F.lit("ruleId")), F.array("i.path", "i.rule_id"))
    return found.select("token", "i.type", now.alias("created_at"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"), meta.alias("metadata"), "i.envelope")


def upsert(vault: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The vault after records are issued: expired ones are gone; one that exists stays as it is but lives on until the
    later end, and counts as ``reused``."""
    old, issued = alive(vault, now), new.groupBy("token").agg(*(F.first(c).alias(c) for c in new.columns if c != "token"))
    both = old.alias("o").join(issued.alias("n"), "token", "full")
    later = F.greatest("o.expires_at", "n.expires_at")
    known = F.col("o.created_at").isNotNull()
    pick = lambda c: F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    ends = F.when(known & F.col("n.created_at").isNotNull(), F.when(F.col("o.expires_at").isNull() | F.col("n.expires_at").isNull(), None).otherwise(later)).otherwise(F.coalesce("o.expires_at", "n.expires_at"))
    return both.select("token", pick("type"), pick("created_at"), ends.alias("expires_at"), pick("metadata"), pick("envelope"), (known & F.col("n.created_at").isNotNull()).alias("reused"))


def reveal(requests: DataFrame, vault: DataFrame, keys: dict[str, bytes], now: Column, enabled: bool = True) -> DataFrame:
    """Requests (token) with value and reason, one of REASONS where there is no value."""
    held = requests.join(vault.select("token", "expires_at", "envelope", F.lit(True).alias("_known")), "token", "left")
    value = T.decrypt(F.col("envelope").withField("expires_at", F.lit(None).cast("timestamp")), keys, F.col("token"))
    reason = (
        F.when(F.lit(not enabled), REASONS[0]).when(F.col("_known").isNull(), REASONS[1]).when(F.col("expires_at") < now, REASONS[2])
        .when(F.col("envelope").isNull(), REASONS[4]).when(F.col("_value").isNull(), REASONS[3])
    )
    return held.withColumn("_value", value).withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("_value"))).drop("_value", "_known", "expires_at", "envelope")


def detokenize(tokens: DataFrame, vault: DataFrame, keys: dict[str, bytes], now: Column) -> DataFrame:
    """One row: restored (a map from tokens to values) is for one request; here token and value of what could be revealed,
    and skipped for what could not."""
    return reveal(tokens.distinct(), vault, keys, now).select("token", "value", F.col("reason").isNotNull().alias("skipped"))


def purge(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    return vault.join(tokens.select("token"), "token", "left_anti")


def purge_expired(vault: DataFrame, now: Column) -> DataFrame:
    """The vault without expired records."""
    return alive(vault, now)


def expired_count(vault: DataFrame, now: Column) -> DataFrame:
    return vault.agg(F.count_if(F.col("expires_at") < now).alias("expired"))


def exported(vault: DataFrame, kind: str | None = None) -> DataFrame:
    """Records without what could reveal a value."""
    rows = vault if kind is None else vault.where(F.col("type") == kind)
    safe = F.map_filter("metadata", lambda k, v: ~k.isin("value", "plaintext", "payload"))
    return rows.select("token", "type", "created_at", "expires_at", safe.alias("metadata"))


def audit_rows(done: DataFrame, operation: str, key: bytes, now: Column) -> DataFrame:
    """An event for each vault operation; tokens that are not shaped like one are replaced by an HMAC."""
    token = T.safe_token(key, F.col("token")) if "token" in done.columns else F.lit(None).cast("string")
    reason = F.col("reason") if "reason" in done.columns else F.lit(None).cast("string")
    return done.select(F.lit(operation).alias("operation"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), token.alias("token"), reason.alias("reason"))


class KeyRing:
    """An active key for new envelopes and retired ones that still open old ones."""

    def __init__(self, active: bytes, retired: list[bytes] = ()):  # noqa: B006
        self.active, self.retired = active, list(retired)

    def rotated(self, new: bytes) -> KeyRing:
        return KeyRing(new, [*self.retired, self.active])

    @property
    def keys(self) -> dict[str, bytes]:
        return {T.short_id(k): k for k in (*self.retired, self.active)}
