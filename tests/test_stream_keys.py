"""Streams whose values are sealed or get tokens of the vault."""

import datetime
import json

from pyspark.sql import functions as F

from tests.test_stream_ends import Files, frame, text_of, wait_for
from veilgrid.functions import text as T
from veilgrid.operators import policy as P, trees, vault
from veilgrid.streaming import rewriter as W

KEY, OTHER = b"k" * 32, b"o" * 32
SEAL = P.build(actions={"email": "encrypt"}, default="allow", mode="enforce")
TOKEN = P.build(actions={"email": "tokenize"}, default="allow", mode="enforce")


def now():
    return F.lit(datetime.datetime(2024, 1, 20))


def opened(spark, text, context, path=(), key=KEY):
    bound = trees.seal_aad(F.lit(context), F.lit(trees.safe_path(path)), F.lit("email"), F.lit("email"))
    return spark.range(1).select(trees.opened(F.lit(text), {T.short_id(key): key}, bound).alias("v")).first().v


def test_sealed_values_open_only_with_what_they_are_bound_to(spark):
    extra = json.loads(frame("one")[6:])
    extra["note"] = "to c@d.org"
    rows = [("a", 1, frame("hello a@b.c")), ("a", 2, frame("om and a@b.com, forged ")), ("a", 3, "data: " + json.dumps(extra)), ("b", 1, frame("none"))]
    got = W.rewrite_batch(spark.createDataFrame(rows, "stream_id string, seq long, frame string"), SEAL, keys=W.Keys(KEY), aad=F.col("stream_id")).collect()
    text = text_of([r for r in got if r.stream_id == "a"])
    assert "forged" in text and text.count("\ue000") == 1 and "a@b.com" not in text and text.count("[SEALED:") == 2
    assert opened(spark, text, "a") == ["a@b.com", "a@b.com"]
    assert opened(spark, text, "b") == [None, None] and opened(spark, text, "a", ("x",)) == [None, None] and opened(spark, text, "a", key=OTHER) == [None, None]
    # the frame that is made for the tail repeats the last delta's other texts, under envelopes of their own
    notes = [json.loads(r.frame[6:])["note"] for r in got if r.stream_id == "a" and "note" in r.frame]
    assert len(notes) == 2 and all(opened(spark, n, "a", ("note",)) == ["c@d.org"] for n in notes)
    assert text_of([r for r in got if r.stream_id == "b"]) == "none"


def test_a_frame_made_after_other_frames_has_its_own_marks(spark):
    """A tail that goes out before a later delta repeats the earlier delta's texts, not the later one's."""
    first, second = (json.loads(frame(t)[6:]) for t in ("early ", "late "))
    first["note"], second["note"], second["type"] = "to c@d.org", "to e@f.org", "done"
    rows = [("a", 1, "data: " + json.dumps(first)), ("a", 2, "data: " + json.dumps(second))]
    got = W.rewrite_batch(spark.createDataFrame(rows, "stream_id string, seq long, frame string"), SEAL, flush_types=("done",), keys=W.Keys(KEY)).collect()
    notes = [opened(spark, json.loads(r.frame[6:])["note"], "", ("note",)) for r in sorted(got, key=lambda r: (r.seq, r.place))]
    assert notes == [["c@d.org"], ["c@d.org"], ["e@f.org"], ["e@f.org"]] and not any("\ue000" in r.frame for r in got)


def test_tokens_of_streams_are_records_of_a_vault(spark):
    rows = [("a", 1, frame("hello a@b.c")), ("a", 2, frame("om and x@y.org")), ("b", 1, frame("a@b.com a@b.com"))]
    got = W.rewrite_batch(spark.createDataFrame(rows, "stream_id string, seq long, frame string"), TOKEN, keys=W.Keys(KEY, OTHER))
    token = {v: T.vault_token_of(OTHER, "email", v) for v in ("a@b.com", "x@y.org")}
    assert text_of([r for r in got.collect() if r.stream_id == "a"]) == f"hello [TOKEN:{token['a@b.com']}] and [TOKEN:{token['x@y.org']}]"
    held = vault.records(got, now())
    assert {(r.token, r.type, r.metadata["ruleId"]) for r in held.collect()} == {(t, "email", "email") for t in token.values()}
    told = vault.reveal(spark.createDataFrame([(t,) for t in token.values()], "token string"), held, {T.short_id(KEY): KEY}, now()).collect()
    assert {r.token: r.value for r in told} == {t: v for v, t in token.items()}
    # records go into a vault by upsert like others
    assert {r.reused for r in vault.upsert(held, vault.records(got, now()), now()).collect()} == {True}


def test_without_keys_values_are_redacted_as_before(spark):
    got = W.rewrite_batch(spark.createDataFrame([("a", 1, frame("so a@b.com"))], "stream_id string, seq long, frame string"), SEAL)
    assert got.columns == ["stream_id", "seq", "place", "frame", "stopped"] and text_of(got.collect()) == "so [REDACTED:email]"


def test_blocked_and_empty_streams_issue_nothing(spark):
    block = P.build(actions={"email": "tokenize", "us_ssn": "block"}, default="allow", mode="enforce")
    rows = [("a", 1, frame("a@b.com 536-90-4399")), ("b", 1, None)]
    got = W.rewrite_batch(spark.createDataFrame(rows, "stream_id string, seq long, frame string"), block, keys=W.Keys(KEY, OTHER))
    assert vault.records(got, now()).count() == 0 and any(r.stopped for r in got.collect())
    assert vault.records(got.where("false"), now()).count() == 0


def test_a_streaming_query_seals_and_issues(spark, tmp_path):
    files = Files(spark, tmp_path, "stream_id string, seq long, frame string")
    files.add([("a", 1, frame("hello a@b.c"))])
    both = P.build(actions={"email": "encrypt", "us_ssn": "tokenize"}, default="allow", mode="enforce")
    out = W.rewrite_stream(files.read(), both, keys=W.Keys(KEY, OTHER), aad=F.col("stream_id"))
    q = out.writeStream.format("memory").queryName("keyed").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
        files.add([("a", 2, frame("om, 536-90-4399")), ("a", 3, None)])
        found = lambda: spark.sql("SELECT * FROM keyed").collect()
        wait_for(lambda: "[SEALED:" in text_of(found()))
        text = text_of(found())
        assert opened(spark, text, "a") == ["a@b.com"] and text.endswith(f"[TOKEN:{T.vault_token_of(OTHER, 'us_ssn', '536-90-4399')}]")
        assert [r.token for r in vault.records(spark.table("keyed"), now()).collect()] == [T.vault_token_of(OTHER, "us_ssn", "536-90-4399")]
    finally:
        q.stop()
