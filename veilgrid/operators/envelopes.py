"""Two levels of keys: data keys encrypt values, and a wrapping key encrypts data keys.

A table holds the data keys in wrapped form only. A data key is unwrapped once, in that small table, and joined to the
values that it encrypts; another wrapping key takes effect by wrapping the data keys anew, without touching a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T

KEY = "key_id string, kid string, wrapped binary"


def _wrap(data_key: Column, key_id: Column, wrapping: bytes) -> Column:
    return F.aes_encrypt(data_key, F.lit(wrapping), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), key_id)


def _unwrapped(wrapping: dict[str, bytes]) -> Column:
    """The data key of a row of the table; null if its wrapping key is not there or does not open it."""
    out = F.lit(None).cast("binary")
    for kid, key in wrapping.items():
        out = F.when(F.col("kid") == kid, F.try_aes_decrypt("wrapped", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col("key_id"))).otherwise(out)
    return out


def new_data_keys(ids: DataFrame, wrapping: bytes) -> DataFrame:
    """A wrapped data key for each key_id. They are drawn when they are computed, so the table must be written before it is used."""
    drawn = F.unhex(F.sha2(F.concat(F.uuid(), F.uuid(), F.uuid()), 256))
    once = ids.select(F.col("key_id").cast("string").alias("key_id")).where("key_id IS NOT NULL").distinct()
    return once.select("key_id", F.lit(T.short_id(wrapping)).alias("kid"), _wrap(drawn, F.col("key_id"), wrapping).alias("wrapped"))


def rewrapped(keys: DataFrame, wrapping: dict[str, bytes], new: bytes) -> DataFrame:
    """The same data keys under another wrapping key; those that none of ``wrapping`` opens stay as they are."""
    opened = keys.withColumn("_key", _unwrapped(wrapping))
    done = F.col("_key").isNotNull()
    return opened.select("key_id", F.when(done, F.lit(T.short_id(new))).otherwise(F.col("kid")).alias("kid"), F.when(done, _wrap(F.col("_key"), F.col("key_id"), new)).otherwise(F.col("wrapped")).alias("wrapped"))


def _with_key(rows: DataFrame, keys: DataFrame, wrapping: dict[str, bytes], key_id: str) -> DataFrame:
    opened = keys.select(F.col("key_id").alias("_id"), _unwrapped(wrapping).alias("_key"))
    return rows.join(opened, F.col(key_id).cast("string") == F.col("_id"), "left").drop("_id")


def sealed(rows: DataFrame, keys: DataFrame, wrapping: dict[str, bytes], value: str, key_id: str, aad: Column, out: str = "envelope") -> DataFrame:
    """``rows`` with an envelope of a value; null for null and where there is no data key."""
    rows = _with_key(rows.withColumn("_aad", aad), keys, wrapping, key_id)
    data = F.aes_encrypt(F.col(value), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("_aad"))
    head = F.lit(2).alias("v"), F.lit("AES-256-GCM").alias("alg"), F.col(key_id).cast("string").alias("key_id")
    made = T.once(data, lambda s: F.struct(*head, *T.parts_of_sealed(s).values(), T.sha256_base64url(F.col("_aad")).alias("aad_hash")))
    return rows.withColumn(out, F.when(F.col("_key").isNotNull() & F.col(value).isNotNull(), made)).drop("_key", "_aad")


def opened(rows: DataFrame, keys: DataFrame, wrapping: dict[str, bytes], aad: Column, envelope: str = "envelope", out: str = "value") -> DataFrame:
    """``rows`` with the text of an envelope; null with another algorithm or associated data, and without the data key."""
    e = F.col(envelope)
    rows = _with_key(rows.withColumns({"_aad": aad, "_of": e["key_id"]}), keys, wrapping, "_of")
    data = F.concat(*(T.from_base64url(e[c]) for c in ("iv", "ct", "tag")))
    ok = (e["alg"] == "AES-256-GCM") & (e["aad_hash"] == T.sha256_base64url(F.col("_aad"))) & F.col("_key").isNotNull()
    text = F.try_aes_decrypt(data, F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("_aad")).cast("string")
    return rows.withColumn(out, F.when(ok, text)).drop("_key", "_aad", "_of")
