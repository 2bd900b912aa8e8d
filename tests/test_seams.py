"""Each implementation passes the checks of its seam, and broken ones are told by what they break."""

import json

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators import access, envelopes, seams, signatures as S
from veilgrid.operators.vault import KeyRing
from veilgrid.sources.shared import written

A, B, MAC = b"a" * 32, b"b" * 32, b"m" * 32


@pytest.fixture(scope="module")
def wrapped(spark):
    keys = written(envelopes.new_data_keys(spark.createDataFrame([("k1",), ("k2",)], "key_id string"), A), "keys")
    return seams.WrappedCipher(keys, {T.short_id(A): A}, ["k1", "k2"], MAC)


def test_both_ciphers_pass(spark, wrapped):
    assert seams.cipher_faults(spark, seams.RingCipher(KeyRing(A, [B]), MAC)) == []
    assert seams.cipher_faults(spark, wrapped) == []


def test_broken_ciphers_are_told(spark):
    class Unbound(seams.RingCipher):
        def sealed(self, rows, value, aad, out="envelope"):
            return super().sealed(rows, value, F.lit("x"), out)

        def opened(self, rows, aad, envelope="envelope", out="value"):
            return super().opened(rows, F.lit("x"), envelope, out)

        def hmac(self, text, domain):
            return T.hmac_sha256(MAC, text)

    class Clear(seams.RingCipher):
        def sealed(self, rows, value, aad, out="envelope"):
            return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("ct"), F.lit("t").alias("tag"), F.lit("h").alias("aad_hash"), F.lit("k").alias("kid"))))

        def opened(self, rows, aad, envelope="envelope", out="value"):
            return rows.withColumn(out, F.col(f"{envelope}.ct"))

    ring = KeyRing(A)
    assert seams.cipher_faults(spark, Unbound(ring, MAC)) == ["bound to what it is about", "hmac of other domains", "hmac without a domain"]
    assert seams.cipher_faults(spark, Clear(ring, MAC), with_hmac=False) == ["value in clear", "drawn anew", "bound to what it is about", "changed text", "changed tag"]

    class Raising(seams.RingCipher):
        def opened(self, rows, aad, envelope="envelope", out="value"):
            raise KeyError

    assert "round trip: raised KeyError" in seams.cipher_faults(spark, Raising(ring, MAC))


def test_callers(spark):
    empty = spark.createDataFrame([], "token_hash string, id string, type string, scopes array<string>, labels map<string,string>, disabled boolean, position long")
    new = spark.createDataFrame([("secret-token", "ann", "user", [], {}), ("gone-token", "bob", "user", [], {})], "token string, id string, type string, scopes array<string>, labels map<string,string>")
    records = access.revoke(access.add_token(empty, new), "bob")
    assert seams.callers_faults(spark, seams.TokenCallers(records, MAC), "Bearer secret-token", ["ann"], {"revoked": "Bearer gone-token"}) == []
    key = S.made_key("one")
    keys = spark.createDataFrame([("k", json.dumps(S.jwk_of(key, "k")))], "kid string, jwk string")
    token = lambda **c: "Bearer " + S.sign({"alg": "RS256", "kid": "k", "typ": "JWT"}, {"iss": "issuer-x", "aud": "a", "sub": "ann-subject", "exp": 2000, "nbf": 500, "iat": 900, **c}, key)
    signed = seams.SignedCallers(keys, "issuer-x", "a", F.lit(1000), MAC)
    assert seams.callers_faults(spark, signed, token(), ["ann-subject", "issuer-x"], {"expired": token(exp=10), "not yet valid": token(nbf=5000)}) == []

    class Telling:
        def authenticated(self, requests):
            return requests.withColumns({"subject_hash": F.lit("ann"), "issuer_hash": F.lit("i")})

    told = seams.callers_faults(spark, Telling(), "Bearer secret-token", ["ann"], {})
    assert "raw values" in told and "refused: missing" in told


def test_limiters(spark):
    assert seams.limiter_faults(spark, seams.ClockLimiter()) == []
    assert seams.limiter_faults(spark, seams.FirstHitLimiter()) == []

    class Nonsense:
        def hits(self, requests, seconds):
            return requests.withColumn("hit", F.lit(None).cast("int"))

    assert seams.limiter_faults(spark, Nonsense()) == ["up to the limit", "a new window"]


def test_stores(spark, tmp_path):
    rows_of = lambda ns: spark.createDataFrame([(n, f"v{n}") for n in ns], "k int, v string")
    assert seams.store_faults(lambda: seams.SharedStore(spark, f"{tmp_path}/s", "k int, v string"), rows_of) == []
    assert seams.store_faults(lambda: seams.SessionStore(spark, "k int, v string"), rows_of) == []

    class Losing(seams.SessionStore):
        def mutate(self, change):
            now = self.now
            try:
                new = written(change(now), "losing")
            except LookupError:
                return
            import time

            time.sleep(0.5)
            self.now = new

    assert seams.store_faults(lambda: Losing(spark, "k int, v string"), rows_of) == ["a failing change is told", "writers at once"]
