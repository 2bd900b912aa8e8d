import json

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators import policy as P, rewrite as R, trees


def test_merging():
    assert P.merge([("a", {"x": "redact"}), ("b", {"x": "mask"})]) == {"x": "mask"}
    assert P.merge([("a", {"x": "block"}), ("b", {"x": "mask"})], weaken=True) == {"x": "block"}
    with pytest.raises(ValueError):
        P.merge([("a", {"x": "block"}), ("b", {"x": "mask"})])
    assert P.strengthened({"email": "encrypt", "phone": "allow"}, "eu-gdpr")["email"] == "encrypt"
    assert P.strengthened({"phone": "allow"}, "eu-gdpr")["phone"] == "mask"
    assert P.build(["strict-block"]).default == "block" and P.build().actions == {"injection": "allow"}
    for bad in (dict(presets=["no"]), dict(mode="x"), dict(actions={"a": "b"}), dict(region="x")):
        with pytest.raises(ValueError):
            P.build(**bad)
    with pytest.raises(ValueError):
        P.Profiles({"a": P.build()}, "b")


def test_profiles(spark):
    p = P.Profiles({"a": P.build(), "b": P.build(), "d": P.build()}, "d", {"s1": "a", "s2": "b"}, {"k=v": "b"})
    rows = spark.createDataFrame([(1, ["x", "s2", "s1"], {}), (2, [], {"k": "v"}), (3, None, None), (4, ["x"], {"k": "w"})], "i int, s array<string>, l map<string,string>")
    got = {r.i: r.p for r in rows.select("i", p.resolve(F.col("s"), F.col("l")).alias("p")).collect()}
    assert got == {1: "b", 2: "b", 3: "d", 4: "d"}


def run(spark, texts, policy, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return sorted(R.protect(df, policy, **more).collect())


def test_protecting(spark):
    rows = run(spark, ["a@b.com x", "sk_" + "a" * 24, None, "", "x"], P.build(["mcp-basic"], mode="enforce"))
    assert [(r.out, r.blocked) for r in rows] == [("[REDACTED:email] x", False), (None, True), (None, False), ("", False), ("x", False)]
    assert rows[0].summary.by_type == {"email": 1} and rows[0].summary.by_action == {"redact": 1}
    dry = run(spark, ["a@b.com"], P.build(["strict-block"]))
    assert (dry[0].out, dry[0].blocked, dry[0].summary.by_action) == ("a@b.com", False, {"block": 1})


def test_dials_spare_hard_types(spark):
    rows = run(spark, ["a@b.com 4111111111111111 (212) 555-1234"], P.build(mode="enforce"), min_confidence=0.99, allow=["4111111111111111", "a@b.com"])
    s = rows[0].summary
    assert s.by_type == {"card": 1} and s.suppressed == {"email": 1} and s.dropped == {"phone": 1}


def test_actions(spark):
    key = b"k" * 32
    rows = run(spark, ["a@b.com"], P.build(actions={"email": "mask"}, mode="enforce"))
    assert rows[0].out == "*" * 7
    rows = run(spark, ["a@b.com a@b.com"], P.build(actions={"email": "tokenize"}, mode="enforce"), key=key)
    a, b = rows[0].out.split()
    assert a == b and a.startswith("[TOKEN:tok_email_")
    sealed = run(spark, ["a@b.com"], P.build(actions={"email": "encrypt"}, mode="enforce"), sealing_key=key)[0].out
    assert sealed.startswith("[SEALED:")
    import base64

    inner = sealed[8:-1]
    e = json.loads(base64.urlsafe_b64decode(inner + "=" * (-len(inner) % 4)))
    assert e["kid"] == T.short_id(key) and "a@b" not in sealed


def test_scalars(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.mask(F.col("t")), T.hmac_sha256(b"key", F.col("t")), T.label_value(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["ab******ij", "***", "", None]
    assert [g[1] for g in got][:3] == [hmac.new(b"key", t.encode(), hashlib.sha256).hexdigest() for t in ("abcdefghij", "abc", "")]
    assert got[3][2] == "none"
    d = spark.createDataFrame([("aGVsbG8gd29ybGQhISEh",), ("aGVsbG8gd29ybGQhISE",), ("not base64 at all!!",), ("a%20b%20c%20d%20e%20",), ("a+b%20c%20d%20e%20fgh",), ("%zz%20aaaaaaaaaaaaaa",)], "t string")
    got = [tuple(r) for r in d.select(T.decode_base64(F.col("t")), T.decode_percent(F.col("t"))).collect()]
    assert got[0][0] == "hello world!!!!" and got[1][0] == "hello world!!!" and got[2] == (None, None)
    assert got[3][1] == "a b c d e " and got[4][1] == "a+b c d e fgh" and got[5][1] is None


def test_long_values(spark):
    import base64

    raw = ("long text, " * 200).encode()
    b = base64.b64encode(raw).decode()
    d = spark.createDataFrame([(b, base64.urlsafe_b64encode(raw).decode().rstrip("="), raw.decode())], "a string, b string, t string")
    got = d.select(T.decode_base64(F.col("a")), T.decode_base64(F.col("b")), T.base64url(F.encode("t", "UTF-8")) == F.col("b"), T.from_base64url(F.col("b")).cast("string")).first()
    assert tuple(got) == (raw.decode(), raw.decode(), True, raw.decode())
    key = b"k" * 32
    e = d.select(T.encrypt(F.col("t"), key, F.lit("x")).alias("e")).select(T.decrypt(F.col("e"), {T.short_id(key): key}, F.lit("x"))).first()[0]
    assert e == raw.decode()


def test_trees(spark):
    deep = json.dumps(__import__("functools").reduce(lambda a, _: [a], range(300), "x"))
    df = spark.createDataFrame([(1, '{"a": [1, "x", true, null, 1e21, 0.1], "b": {"c": ""}}'), (2, "{no"), (3, None), (4, deep)], "id int, t string")
    got = [tuple(r)[0:1] + (r.path_text, r.value, r.kind, r.error) for r in trees.flatten(df, "t").collect()]
    assert [g[2:4] for g in got if g[0] == 1] == [("a", "key"), ("1", "number"), ("x", "value"), ("1e+21", "number"), ("0.1", "number"), ("b", "key"), ("c", "key"), ("", "value")]
    assert [(g[0], g[4]) for g in got if g[4]] == [(2, "invalid_json"), (4, "too_deep")]
    up = lambda t, kind, path: t.upper() if kind == "key" else t
    assert trees.rewrite_tree({"a": 1, "A": 2, "b": {"c": "d"}}, up) == {"A#2": 1, "A": 2, "B": {"C": "d"}}
    assert trees.rewrite_tree({"n": 5}, lambda t, k, p: "x" if k == "number" else t) == {"n": "x"}
    assert trees.get_path({"a": [1, {"b": 2}]}, ("a", 1, "b")) == 2 and trees.get_path({}, ("a",)) is None
    assert trees.built(("a", 1, "b"), "x") == {"a": [None, {"b": "x"}]}
    assert trees.plain_path(("a", 0, "b")) == "a[0].b" and "secret" not in trees.safe_path(("secret", 1))


def test_json_is_protected(spark):
    df = spark.createDataFrame([(1, '{"m": "a@b.com", "a@b.com": 4111111111111111}'), (2, "{no"), (3, None)], "id int, t string")
    got = {r.id: r for r in trees.protect_json(df, "t", P.build(mode="enforce")).collect()}
    assert json.loads(got[1].out) == {"m": "[REDACTED:email]", "[REDACTED:email]": "[REDACTED:card]"}
    assert got[2].error == "invalid_json" and got[2].blocked and got[3].out is None


def test_json_allow_lists_paths_tokens_and_seals(spark):
    import hashlib
    import hmac

    from veilgrid.operators import policy as P, trees

    doc = '{"a": "x@y.com", "b": ["x@y.com", {"c": "z@y.com 4111111111111111"}]}'
    rows = spark.createDataFrame([(1, doc)], "id int, j string")
    policy = P.build(actions={"email": "redact", "card": "redact"}, default="allow", mode="enforce")
    at = {p: trees.safe_path(p) for p in (("a",), ("b", 0), ("b", 1, "c"))}
    out = lambda allow, **how: trees.protect_json(rows, "j", how.pop("policy", policy), allow=allow, **how).first()
    assert out([]).out.count("[REDACTED:email]") == 3
    one = out([{"value": "x@y.com", "path": at["a",]}])
    assert one.out.startswith('{"a": "x@y.com"') and one.out.count("[REDACTED:email]") == 2
    assert [(f.path, f.type) for f in one.found] == [(at["b", 0], "email"), (at["b", 1, "c"], "email"), (at["b", 1, "c"], "card")]
    by_path = out([{"path": at["b", 1, "c"]}])
    assert "z@y.com [REDACTED:card]" in by_path.out and by_path.out.count("[REDACTED:email]") == 2  # a hard type is never spared
    assert out(["x@y.com"]).out.count("x@y.com") == 2 and out(["4111111111111111"]).out.count("REDACTED:card") == 1
    key = b"k" * 32
    tokens = out([], policy=P.build(actions={"email": "tokenize", "card": "redact"}, default="allow", mode="enforce"), key=key)
    want = ["tok_email_" + hmac.new(key, f"email:{v}".encode(), hashlib.sha256).hexdigest()[:32] for v in ("x@y.com", "z@y.com")]
    assert tokens.issued == want and tokens.out.count(f"[TOKEN:{want[0]}]") == 2
    sealed = out([], policy=P.build(actions={"email": "encrypt", "card": "encrypt"}, default="allow", mode="enforce"), sealing_key=key)
    assert sealed.out.count("[SEALED:") == 4 and "@y.com" not in sealed.out and "" not in sealed.out
    from veilgrid.operators import detect

    import json

    inner = json.loads(sealed.out)["a"]
    assert detect.marker_spans(inner, detect.rules_for("response")) == [(0, len(inner))]


def test_marks_cannot_be_forged_and_envelopes_are_bound(spark):
    """What a payload holds of private-use characters stays; a sealed value opens with its own path, type and rule alone."""
    import base64

    from veilgrid.functions import text as T

    key, policy = b"k" * 32, P.build(actions={"email": "encrypt"}, default="allow", mode="enforce")
    forged = json.dumps({"a": "\ue0000\ue001 and \ue000\ue001", "b": "x@y.com"}, ensure_ascii=False)
    out = json.loads(trees.protect_json(spark.createDataFrame([(forged,)], "t string"), "t", policy, sealing_key=key, aad=F.lit("ctx")).first().out)
    assert out["a"] == json.loads(forged)["a"] and out["b"].startswith("[SEALED:")
    raw = out["b"][8:-1]
    envelope = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    rows = spark.createDataFrame([(envelope,)], "e struct<v:int,alg:string,kid:string,iv:string,ct:string,tag:string,aad_hash:string,aad_encoding:string>")
    path = trees.safe_path(("b",))
    aads = {n: trees.seal_aad(*(F.lit(x) for x in p)) for n, p in {"right": ("ctx", path, "email", "email"), "path": ("ctx", trees.safe_path(("a",)), "email", "email"), "type": ("ctx", path, "card", "email"), "rule": ("ctx", path, "email", "x"), "context": ("", path, "email", "email")}.items()}
    got = rows.select(*(T.decrypt(F.col("e"), {T.short_id(key): key}, a).alias(n) for n, a in aads.items())).first().asDict()
    assert got == {"right": "x@y.com", "path": None, "type": None, "rule": None, "context": None}
