"""Tokens with signatures, and values under wrapped data keys."""

import json

import pytest
from pyspark.sql import functions as F

from veilgrid.operators import envelopes as V, signatures as S

# RFC 7515, appendix A.2
N = "ofgWCuLjybRlzo0tZWJjNiuSfb4p4fAkd_wWJcyQoTbji9k0l8W26mPddxHmfHQp-Vaw-4qPCJrcS2mJPMEzP1Pt0Bm4d4QlL-yRT-SFd2lZS-pCgNMsD1W_YpRPEwOWvG6b32690r2jZ47soMZo9wGzjb_7OMg0LOL-bSf63kpaSHSXndS5z5rexMdbBYUsLA9e-KXBdQOS-UTo7WTBEMa2R2CapHg665xsmtdVMTBQY4uDZlxvb3qCo5ZwKh9kG4LT6_I5IhlJH7aGhyxXFvUK-DWNmoudF8NAco9_h9iaGNj8q2ethFkMLs91kzk2PAcDTW9gb54h4FRWyuXpoQ"
TOKEN = (
    "eyJhbGciOiJSUzI1NiJ9.eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ."
    "cC4hiUPoj9Eetdgtv3hF80EGrhuB__dzERat0XF9g2VtQgr9PJbu3XOiZj5RZmh7AAuHIm4Bh-0Qc_lF5YKt_O8W2Fp5jujGbds9uJdbF9CUAr7t1dnZcAcQjbKBYNX4BAynRFdiuB--f_nZLgrnbyTyWzO75vRK5h6xBArLIARNPvkSjtQBMHlb1L07Qe7K0GarZRmB_eSN9383LcOLn6_dO--xi12jzDwusC-eOkHWEsqtFZESc6BfI7noOPqvhJ1phCnvWh6IeYI2w9QOYEUipUTI8np6LbgGY9Fs98rqVt5AXLIhWkWywlVmtVrBp0igcN_IoypGlUPQGe77Rw"
)


def test_a_published_vector():
    jwk = json.dumps({"kty": "RSA", "n": N, "e": "AQAB"})
    assert S.key_fault(jwk) is None and S.verifies(TOKEN, "RS256", jwk)
    for broken in (TOKEN[:-5] + "A" + TOKEN[-4:], "f" + TOKEN[1:], TOKEN + "AA", TOKEN[:-4]):
        assert not S.verifies(broken, "RS256", jwk)
    assert not S.verifies(TOKEN, "RS384", jwk)


KEY, OTHER, SMALL = S.made_key("one"), S.made_key("two"), S.made_key("small", 1024)
HEAD = {"alg": "RS256", "kid": "k", "typ": "JWT"}
CLAIMS = {"iss": "i", "aud": "a", "sub": "s", "exp": 2000, "nbf": 500, "iat": 900}


def token(head=None, claims=None, key=KEY):
    return S.sign({**HEAD, **(head or {})}, {**CLAIMS, **(claims or {})}, key)


def raw(head, claims=None):
    return ".".join((S.to_b64url(json.dumps(head).encode()), S.to_b64url(claims if isinstance(claims, bytes) else json.dumps(claims or CLAIMS).encode()), "c2ln"))


def test_refusals_in_their_order(spark):
    cases = [
        (token(), None), (token(claims={"aud": ["b", "a"]}), None), (token({"typ": "jwt"}), None), (None, "malformed"), ("a.b", "malformed"), ("a.b.c.d", "malformed"), ("e30=.e30.e30", "malformed"), (raw({"typ": "JWE", "alg": "none"}), "type"),
        (raw({"alg": "none", "kid": "k"}), "algorithm"), (raw({"alg": "HS256", "kid": "k"}), "algorithm"), (raw({"alg": 1, "kid": "k"}), "algorithm"), (raw({"alg": "RS256"}), "key id"), (raw({"alg": "RS256", "kid": ""}), "key id"), (raw({"alg": "RS256", "kid": 7}), "key id"),
        (raw(HEAD, b"{no"), "claims"), (raw(HEAD, b"[1]"), "claims"), (token({"kid": "none"}), "unknown key"), (token({"kid": "enc"}), "unfit key"), (token({"kid": "ops"}), "unfit key"), (token({"kid": "ec"}), "unfit key"), (token({"kid": "small"}, key=SMALL), "unfit key"),
        (token(key=OTHER, claims={"iss": "x"}), "signature"), (raw(HEAD), "signature"), (token(claims={"iss": "x", "aud": "x"}), "issuer"), (token(claims={"aud": "x"}), "audience"), (token(claims={"aud": ["a", 1]}), "audience"), (token(claims={"aud": None}), "audience"),
        (token(claims={"sub": " ", "exp": 1}), "subject"), (token(claims={"sub": 5}), "subject"), (token(claims={"exp": 939}), "expired"), (token(claims={"exp": 940}), None), (token(claims={"exp": "2000"}), "expired"), (token(claims={"nbf": 1061}), "not yet"), (token(claims={"nbf": None}), "not yet"),
        (token(claims={"iat": 1061}), "issued later"), (token(claims={"iat": "x"}), "issued later"), (token(claims={"iat": 1060}), None),
    ]
    jwks = [S.jwk_of(KEY, "k", use="sig", key_ops=["verify"]), S.jwk_of(KEY, "enc", use="enc"), S.jwk_of(KEY, "ops", key_ops=["verify", "decrypt"]), {"kty": "EC", "kid": "ec"}, S.jwk_of(SMALL, "small")]
    keys = spark.createDataFrame([(k["kid"], json.dumps(k)) for k in jwks], "kid string, jwk string")
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, token string").withColumn("claims_", F.lit(1))
    got = {r.id: r for r in S.verified(rows, keys, "i", "a", F.lit(1000)).collect()}
    assert len(got) == len(cases)
    for i, (_, want) in enumerate(cases):
        assert got[i].verdict == want, cases[i]
        assert (got[i].claims is None) == (want is not None)
    nonce = spark.createDataFrame([(1, token(claims={"nonce": "n"})), (2, token())], "id int, token string")
    assert {r.id: r.verdict for r in S.verified(nonce, keys, "i", "a", F.lit(1000), nonce=F.lit("n")).collect()} == {1: None, 2: "nonce"}
    assert S.verified(rows.limit(0), keys, "i", "a", F.lit(1000)).count() == 0
    with pytest.raises(ValueError):
        S.verified(rows, keys, "i", "a", F.lit(1), algorithms=("none",))


def test_values_under_wrapped_keys(spark, tmp_path):
    one, two = b"1" * 32, b"2" * 32
    ring = {V.T.short_id(one): one}
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", ""), (3, "b", "ü" * 500), (4, "c", None), (5, None, "no key"), (6, "d", "none")], "id int, k string, v string")
    V.new_data_keys(rows.where("k <> 'd'").select(F.col("k").alias("key_id")), one).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    assert keys.count() == 3
    V.sealed(rows, keys, ring, "v", "k", F.col("id").cast("string")).write.parquet(f"{tmp_path}/values")
    values = spark.read.parquet(f"{tmp_path}/values")
    assert {r.id for r in values.where("envelope IS NULL").collect()} == {4, 5, 6}
    want = {1: "x", 2: "", 3: "ü" * 500, 4: None, 5: None, 6: None}
    said = lambda keys, ring, aad=F.col("id").cast("string"): {r.id: r.value for r in V.opened(values, keys, ring, aad).collect()}
    nothing = dict.fromkeys(want)
    assert said(keys, ring) == want and said(keys, {V.T.short_id(two): two}) == nothing and said(keys, ring, F.lit("other")) == nothing and said(keys, {V.T.short_id(one): two}) == nothing
    V.rewrapped(keys, ring, two).write.parquet(f"{tmp_path}/rotated")
    rotated = spark.read.parquet(f"{tmp_path}/rotated")
    assert said(rotated, {V.T.short_id(two): two}) == want and said(rotated, ring) == nothing
    assert {r.kid for r in V.rewrapped(rotated, ring, one).collect()} == {V.T.short_id(two)}
