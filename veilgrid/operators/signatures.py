"""Signed tokens: RSA signatures (PKCS #1 v1.5) with keys of a table of JWKs, and the claims behind them."""

from __future__ import annotations

import base64
import ctypes
import functools
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: what stands before a digest, by algorithm, and the least bits of a key --
DIGEST_INFO = {
    "RS256": ("sha256", "3031300d060960864801650304020105000420"),
    "RS384": ("sha384", "3041300d060960864801650304020205000430"),
    "RS512": ("sha512", "3051300d060960864801650304020305000440"),
}
LEAST_BITS = 2048
# -- end of fixed values --
TOKEN = r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"


def from_b64url(text: str) -> bytes | None:
    """The bytes of a base64url text without padding; null unless it is the one text for them."""
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError:
        return None
    return raw if base64.urlsafe_b64encode(raw).decode().rstrip("=") == text else None


def to_b64url(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


@functools.lru_cache(maxsize=1)
def _openssl():
    """The functions for large numbers of the OpenSSL that hashlib is built with; null where it shows none."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for name, kinds in {"BN_CTX_new": "", "BN_new": "", "BN_bin2bn": "sip", "BN_mod_exp": "ppppp", "BN_bn2bin": "ps", "BN_num_bits": "p", "BN_clear_free": "p", "BN_CTX_free": "p"}.items():
            f = getattr(lib, name)
            f.argtypes = [{"s": ctypes.c_char_p, "i": ctypes.c_int, "p": ctypes.c_void_p}[k] for k in kinds]
            f.restype = {"BN_mod_exp": ctypes.c_int, "BN_bn2bin": ctypes.c_int, "BN_num_bits": ctypes.c_int, "BN_clear_free": None, "BN_CTX_free": None}.get(name, ctypes.c_void_p)
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def power(base: int, exponent: int, modulus: int) -> int:
    """``pow(base, exponent, modulus)`` of numbers from 0 on, which OpenSSL works out in a small part of Python's time."""
    lib = _openssl()
    if lib is None or modulus < 2 or base < 0 or exponent < 0:
        return pow(base, exponent, modulus)
    whole = [x.to_bytes((x.bit_length() + 7) // 8, "big") for x in (base, exponent, modulus)]
    numbers = [lib.BN_bin2bn(x, len(x), None) for x in whole]
    out, room = lib.BN_new(), lib.BN_CTX_new()
    try:
        if not lib.BN_mod_exp(out, *numbers, room):
            return pow(base, exponent, modulus)
        size = (lib.BN_num_bits(out) + 7) // 8
        raw = ctypes.create_string_buffer(size + 1)
        lib.BN_bn2bin(out, raw)
        return int.from_bytes(raw.raw[:size], "big")
    finally:
        for x in (*numbers, out):
            lib.BN_clear_free(x)
        lib.BN_CTX_free(room)


def padded(message: bytes, algorithm: str, length: int) -> bytes:
    """What a signature must turn into: the digest at the end of a block of ``length`` bytes."""
    name, head = DIGEST_INFO[algorithm]
    tail = bytes.fromhex(head) + hashlib.new(name, message).digest()
    return b"\x00\x01" + b"\xff" * (length - len(tail) - 3) + b"\x00" + tail


def key_fault(jwk: str | None) -> str | None:
    """Why a key can't verify; null if it can."""
    try:
        k = json.loads(jwk)
        n, e = (int.from_bytes(from_b64url(k[x]) or b"", "big") for x in "ne")
    except (TypeError, ValueError, KeyError, AttributeError):
        return "unfit key"
    ops = k.get("key_ops")
    if k.get("kty") != "RSA" or k.get("use") not in (None, "", "sig") or n.bit_length() < LEAST_BITS or e < 3 or e % 2 == 0:
        return "unfit key"
    if isinstance(ops, list) and ({"encrypt", "decrypt"} & set(map(str, ops)) or not {"verify", "sign"} & set(map(str, ops))):
        return "unfit key"
    return None


@functools.lru_cache(maxsize=64)
def _public(jwk: str) -> tuple[int, int]:
    k = json.loads(jwk)
    return tuple(int.from_bytes(from_b64url(k[x]), "big") for x in "ne")


def verifies(token: str, algorithm: str, jwk: str) -> bool:
    """Whether the third part of a token signs the first two."""
    signed, _, last = token.rpartition(".")
    signature, (n, e) = from_b64url(last), _public(jwk)
    length = (n.bit_length() + 7) // 8
    if signature is None or len(signature) != length or algorithm not in DIGEST_INFO:
        return False
    s = int.from_bytes(signature, "big")
    return s < n and power(s, e, n).to_bytes(length, "big") == padded(signed.encode(), algorithm, length)


@functools.lru_cache(maxsize=64)
def _by_primes(p: int, q: int, d: int) -> tuple[int, int, int]:
    return d % (p - 1), d % (q - 1), pow(q, -1, p)


def sign(header: dict, claims: dict, key: dict) -> str:
    """A token of a private key (n, d and its primes), for tests and for data that is made from tables."""
    signed = ".".join(to_b64url(json.dumps(x, separators=(",", ":")).encode()) for x in (header, claims))
    length = (key["n"].bit_length() + 7) // 8
    block = int.from_bytes(padded(signed.encode(), header["alg"], length), "big")
    # by the primes apart, which takes a quarter of the time
    p, q = key["p"], key["q"]
    to_p, to_q, inverse = _by_primes(p, q, key["d"])
    x, y = power(block, to_p, p), power(block, to_q, q)
    return f"{signed}.{to_b64url((y + q * ((x - y) * inverse % p)).to_bytes(length, 'big'))}"


def made_key(seed: str, bits: int = 2048) -> dict:
    """A private key that follows from a text: the next primes from its hash on. No secret at all."""
    e, primes, at = 65537, [], 0
    while len(primes) < 2:
        text = b"".join(hashlib.sha512(f"{seed}:{at}:{i}".encode()).digest() for i in range(bits // 1024 + 1))
        p = int.from_bytes(text, "big") % (1 << bits // 2 - 2) | 3 << bits // 2 - 2 | 1
        at += 1
        while not (_prime(p) and (p - 1) % e):
            p += 2
        primes.append(p)
    p, q = primes
    return {"n": p * q, "e": e, "p": p, "q": q, "d": pow(e, -1, (p - 1) * (q - 1))}


def _prime(n: int) -> bool:
    if any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def jwk_of(key: dict, kid: str, **more) -> dict:
    whole = lambda x: to_b64url(x.to_bytes((x.bit_length() + 7) // 8, "big"))
    return {"kty": "RSA", "kid": kid, "n": whole(key["n"]), "e": whole(key["e"]), **more}


def _signature_fault(token: pd.Series, algorithm: pd.Series, jwk: pd.Series) -> pd.Series:
    faults: dict = {}  # a key is looked at once

    def one(t, a, k):
        if k is None or t is None or a is None:
            return None
        if k not in faults:
            faults[k] = key_fault(k)
        return faults[k] or (None if verifies(t, a, k) else "signature")

    return pd.Series([one(*x) for x in zip(token, algorithm, jwk)], dtype=object)


def verified(tokens: DataFrame, keys: DataFrame, issuer: str, audience: str, now: Column, token: str = "token", algorithms: tuple[str, ...] = ("RS256",), skew: int = 60, nonce: Column | None = None) -> DataFrame:
    """``tokens`` with verdict, why a token is refused, null where it is not; and claims, its JSON where it is not.

    ``keys`` has kid and jwk; of a kid with several keys the last by its text counts. The first fault in this order counts: malformed, type,
    algorithm, key id, claims, unknown key, unfit key, signature, issuer, audience, subject, expired, not yet, issued
    later, nonce. Null tokens are malformed. ``now`` is in seconds."""
    if not set(algorithms) <= set(DIGEST_INFO):
        raise ValueError(f"algorithms must be among {', '.join(DIGEST_INFO)}")
    part = lambda k: F.split_part(token, F.lit("."), F.lit(k))
    raw = lambda k: F.try_to_binary(F.rpad(F.translate(part(k), "-_", "+/"), (F.ceil(F.length(part(k)) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    parsed = lambda k: F.try_parse_json(raw(k).cast("string"))
    whole = F.coalesce(F.col(token).rlike(TOKEN), F.lit(False))
    rows = tokens.withColumns({"_head": F.when(whole, parsed(1)), "_claims": F.when(whole, parsed(2)), "_text": F.when(whole, raw(2).cast("string"))})
    got = lambda c, path, kind: F.try_variant_get(c, path, kind)
    kind = lambda c, path: F.schema_of_variant(got(c, path, "variant"))
    text = lambda c, path: F.when(kind(c, path) == "STRING", got(c, path, "string"))
    number = lambda path: F.when(kind("_claims", path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), got("_claims", path, "double"))
    rows = rows.withColumns({"_alg": text("_head", "$.alg"), "_kid": text("_head", "$.kid")})
    known = keys.groupBy(F.col("kid").alias("_kid")).agg(F.max("jwk").alias("_jwk"))
    # an issuer has few keys and most tokens name the same one, so tokens stay where they are
    rows = rows.join(F.broadcast(known), "_kid", "left")
    rows = rows.withColumn("_fault", F.pandas_udf(_signature_fault, "string")(F.when(F.col("_alg").isin(*algorithms), F.col(token)), "_alg", "_jwk"))
    several = got("_claims", "$.aud", "array<variant>")
    fits = F.when(kind("_claims", "$.aud") == "STRING", got("_claims", "$.aud", "string") == audience).otherwise(
        F.forall(several, lambda a: F.schema_of_variant(a) == "STRING") & F.exists(several, lambda a: F.try_variant_get(a, "$", "string") == audience))
    typ = got("_head", "$.typ", "string")
    verdict = (
        F.when(~whole | F.col("_head").isNull(), "malformed")
        .when(F.coalesce(typ, F.lit("")) != "", F.when(F.upper(typ) != "JWT", "type"))
    )
    none = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), name)
    object_ = F.schema_of_variant("_claims").startswith("OBJECT")
    exp, nbf, iat = number("$.exp"), number("$.nbf"), number("$.iat")
    checks = [
        verdict, none(F.col("_alg").isin(*algorithms), "algorithm"), none(F.col("_kid") != "", "key id"), none(F.col("_claims").isNotNull() & object_, "claims"), none(F.col("_jwk").isNotNull(), "unknown key"), F.col("_fault"),
        none(text("_claims", "$.iss") == issuer, "issuer"), none(fits, "audience"), none(F.trim(text("_claims", "$.sub")) != "", "subject"), none(now <= exp + skew, "expired"), none(now >= nbf - skew, "not yet"),
        F.when(got("_claims", "$.iat", "variant").isNotNull(), none(iat - skew <= now, "issued later")),
    ]
    if nonce is not None:
        checks.append(none(text("_claims", "$.nonce") == nonce, "nonce"))
    rows = rows.withColumn("verdict", F.coalesce(*checks))
    return rows.select(*tokens.columns, "verdict", F.when(F.col("verdict").isNull(), F.col("_text")).alias("claims"))
