"""Scalar functions on texts and bytes, all within Spark's own expressions unless their docstring says otherwise."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_SHORT = 8


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def base64(data: Column) -> Column:
    """Base64 on one line; Spark's own breaks it after 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def base64url(data: Column) -> Column:
    return F.translate(F.rtrim(base64(data), F.lit("=")), "+/", "-_")


def sha256_base64url(text: Column) -> Column:
    return base64url(F.unhex(F.sha2(text, 256)))


def mask(text: Column) -> Column:
    """Up to eight characters become stars; of longer texts the first and last two stay around at least four stars."""
    n = F.char_length(text)
    long = F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), F.greatest(F.lit(4), n - 4)), F.substring(text, -2, 2))
    return F.when(n <= MASK_SHORT, F.repeat(F.lit("*"), n)).otherwise(long)


def redacted(kind: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), kind, F.lit("]"))


def plain_token(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("[TOKEN:"), kind, F.lit(":"), short_hash(text), F.lit("]"))


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer pad of HMAC-SHA256 for a key of up to 64 bytes."""
    if len(key) > 64:
        raise ValueError("at most 64 bytes")
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 in hex, composed of two SHA-256."""
    inner, outer = hmac_pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def vault_token(key: bytes, kind: Column, text: Column) -> Column:
    """The token that a kind and a text always get under a key."""
    return F.concat(F.lit("tok_"), kind, F.lit("_"), F.substring(hmac_sha256(key, F.concat(kind, F.lit(":"), text)), 1, 32))


def vault_token_of(key: bytes, kind: str, text: str) -> str:
    """The same for one value, within a task."""
    import hmac

    return f"tok_{kind}_{hmac.new(key, f'{kind}:{text}'.encode(), 'sha256').hexdigest()[:32]}"


def safe_token(key: bytes, token: Column) -> Column:
    """A token as it may be logged: what is not shaped like one is replaced by its HMAC."""
    shaped = token.rlike("^tok_[a-z0-9_]+_[a-f0-9]{16,}$")
    return F.when(shaped, token).otherwise(F.concat(F.lit("nontoken_"), F.substring(hmac_sha256(key, token), 1, 32)))


def decode_base64(text: Column, low: int = 16, high: int = 8192) -> Column:
    """The text behind base64 or base64url, null unless it is canonical, within the lengths and valid UTF-8."""
    n = F.length(text)
    plain = text.rlike("^[A-Za-z0-9+/]+={0,2}$") & (n % 4 == 0)
    url = ~plain & text.rlike("^[A-Za-z0-9_-]+$") & (n % 4 != 1)
    std = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(n / 4) * 4).cast("int"), F.lit("="))
    data = F.try_to_binary(F.when(plain, text).when(url, std), F.lit("base64"))
    again = F.when(plain, base64(data) == text).otherwise(base64url(data) == text)
    ok = n.between(low, high) & (F.octet_length(data) > 0) & again & F.is_valid_utf8(data.cast("string"))
    return F.when(ok, data.cast("string"))


def decode_percent(text: Column, low: int = 16, high: int = 8192) -> Column:
    """The text behind percent escapes, null if there are none, if they are malformed or change nothing."""
    out = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    bad = text.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(F.length(text).between(low, high) & text.rlike("%[0-9A-Fa-f]{2}") & ~bad & F.is_valid_utf8(out) & (out != text), out)


def label_value(text: Column) -> Column:
    """A metric's label: 64 characters, others than ``A-Za-z0-9_.:/-`` as underscores, null as none."""
    return F.coalesce(F.regexp_replace(F.substring(text, 1, 64), "[^A-Za-z0-9_.:/-]", "_"), F.lit("none"))


def bearer(header: Column) -> Column:
    """The token of an authorization header, null without one."""
    found = F.regexp_extract(header, r"^(?i:bearer)\s+(\S+)\s*$", 1)
    return F.when(found != "", found)


def external_id(provider: Column, digest: Column) -> Column:
    return F.concat(provider, F.lit(":"), F.substring(digest, 1, 16))


def url_path(url: Column) -> Column:
    return F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("/"))


def version_key(text: Column) -> Column:
    """major.minor.patch as an array that compares as versions do; null for other texts."""
    ok = text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")
    return F.when(ok, F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form, in a vectorised Python function; Spark has none of its own."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)


def canonical(value) -> str:
    """JSON with sorted keys and without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: Column, fold: bool = False) -> Column:
    """Canonical JSON of a JSON text, null where it is none; with ``fold`` keys and strings are in NFKC first, and keys
    that then collide make it null. In a vectorised Python function."""

    def folded(v):
        if isinstance(v, str):
            return unicodedata.normalize("NFKC", v)
        if isinstance(v, list):
            return [folded(x) for x in v]
        if isinstance(v, dict):
            out = {unicodedata.normalize("NFKC", k): folded(x) for k, x in v.items()}
            if len(out) < len(v):
                raise ValueError("keys collide")
            return out
        return v

    def one(t: str) -> str | None:
        try:
            v = json.loads(t)
            return canonical(folded(v) if fold else v)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(text)


def once(made: Column, use) -> Column:
    """``use(x)`` for a value that is drawn anew whenever it is worked out: a variable of a lambda is worked out once, while
    several mentions of an expression may not be."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def parts_of_sealed(sealed: Column) -> dict[str, Column]:
    """iv, ct and tag of what ``aes_encrypt`` gives in GCM, as base64url texts."""
    n = F.octet_length(sealed)
    cut = {"iv": (F.lit(1), F.lit(12)), "ct": (F.lit(13), n - 28), "tag": (n - 15, F.lit(16))}
    return {name: base64url(F.substring(sealed, at, size)).alias(name) for name, (at, size) in cut.items()}


def encrypt(text: Column, key: bytes, aad: Column, iv: Column | None = None) -> Column:
    """AES-256-GCM; an envelope of base64url texts. ``iv`` is for tests, else it is drawn anew for each value."""
    sealed = F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), *([iv, aad] if iv is not None else [F.lit(b""), aad]))
    head = F.lit(2).alias("v"), F.lit("AES-256-GCM").alias("alg"), F.lit(short_id(key)).alias("kid")
    tail = sha256_base64url(aad).alias("aad_hash"), F.lit("json-nfkc-v2").alias("aad_encoding")
    return once(sealed, lambda s: F.struct(*head, *parts_of_sealed(s).values(), *tail))


def short_id(key: bytes) -> str:
    import hashlib

    return hashlib.sha256(key).hexdigest()[:16]


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")))


def decrypt(envelope: Column, keys: dict[str, bytes], aad: Column, now: Column | None = None) -> Column:
    """The text of an envelope; null with a wrong algorithm, key id, associated data or tag, or past ``expires_at``."""
    sealed = F.concat(from_base64url(envelope["iv"]), from_base64url(envelope["ct"]), from_base64url(envelope["tag"]))
    key = F.lit(None).cast("binary")
    for kid, k in keys.items():
        key = F.when(envelope["kid"] == kid, F.lit(k)).otherwise(key)
    ok = (envelope["alg"] == "AES-256-GCM") & (envelope["aad_hash"] == sha256_base64url(aad)) & key.isNotNull()
    if now is not None:
        ok &= envelope["expires_at"].isNull() | (now < envelope["expires_at"])
    return F.when(ok, F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))


def in_range(version: Column, low: str | None = None, below: str | None = None) -> Column:
    """Whether a version is at least one and below another; null for other texts."""
    key = version_key(version)
    number = lambda v: F.lit([int(x) for x in v.split(".")]).cast("array<int>")
    out = key.isNotNull()
    if low is not None:
        out = out & (key >= number(low))
    if below is not None:
        out = out & (key < number(below))
    return F.when(key.isNotNull(), out)
