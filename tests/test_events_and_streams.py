import json

import pytest
from pyspark.sql import functions as F

from veilgrid.operators import events as E, policy as P
from veilgrid.sources import logs
from veilgrid.streaming import frames, rewriter as W


def chain(n=6):
    return [json.dumps(r) for r in E.chained({"i": i} for i in range(n))]


def verify(spark, lines, anchors=None):
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chain string, position long, line string")
    a = spark.createDataFrame([("c", s, h, i) for i, (s, h) in enumerate(anchors)], "chain string, sequence long, event_hash string, position long") if anchors else None
    r = E.verify_chains(df, a).collect()[0]
    return r.valid, r.records, r.reason


def test_chains(spark):
    good = chain()
    hashes = [json.loads(x)["auditIntegrity"]["eventHash"] for x in good]
    assert verify(spark, [*good[:3], " ", *good[3:]]) == (True, 6, None)
    edit = lambda i, f: [f(x) if k == i else x for k, x in enumerate(good)]
    assert verify(spark, edit(2, lambda x: x.replace('"i": 2', '"i": 9'))) == (False, 2, "wrong hash")
    assert verify(spark, good[:2] + good[3:]) == (False, 2, "wrong sequence")
    assert verify(spark, edit(3, lambda x: json.dumps({"i": 3}))) == (False, 3, "no integrity block")
    other = [json.dumps(r) for r in E.chained({"i": i + 5} for i in range(6))]
    assert verify(spark, good[:2] + other[2:]) == (False, 2, "wrong previous hash")
    assert verify(spark, good, [(2, hashes[1]), (4, "x")]) == (False, 3, "not the anchored hash at 4")
    assert verify(spark, good[:4], [(6, hashes[5])])[2].startswith("cut short")
    assert verify(spark, good, [(4, "x"), (4, hashes[3])]) == (True, 6, None)


def test_log_sources(spark, tmp_path):
    p = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(json.dumps({"event": i}), i) for i in range(5)], "record string, position long")
    assert logs.append_chained(spark, rows, p) == 5 and logs.append_chained(spark, rows, p) == 10
    lines = logs.chained_log(spark, p).read().select(F.lit("c").alias("chain"), F.col("sequence").alias("position"), "line")
    assert E.verify_chains(lines).first().valid
    assert logs.event_log(spark, f"{p}-none").count() == 0 and logs.anchors(spark, f"{p}-none").count() == 0
    (tmp_path / "a.jsonl").write_text('{"sequence": 1, "event_hash": "x"}\nnot json\n\n{"sequence": 2, "event_hash": "y"}\n')
    assert logs.anchors(spark, f"file://{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "e.jsonl").write_text('{"id": "1", "blocked": true, "audit_integrity": {"sequence": 1}}\n{bad\n{"id": "2", "audit_integrity": {"sequence": 2}}\n')
    log = logs.event_log(spark, f"file://{tmp_path}/e.jsonl")
    assert log.count() == 2 and [r.covered_from_start for r in logs.tail(log, 1).collect()] == [False]
    logs.replace_table(spark.range(3), f"{tmp_path}/t")
    logs.replace_table(spark.range(5), f"{tmp_path}/t")
    assert logs.replace_table(spark.range(5), f"{tmp_path}/t").read().count() == 5
    assert logs.json_lines(spark, f"file://{tmp_path}/a.jsonl").count() == 3


def test_pages_are_checked(spark):
    log = spark.createDataFrame([], E.EVENT)
    for bad in (dict(limit=0), dict(limit=201), dict(correlation_id="x"), dict(decision="x")):
        with pytest.raises(ValueError):
            E.page(log, **bad)
    assert E.page(log).count() == 0 and E.report(log).first().events == 0


POLICY = P.build(actions={"email": "redact", "secret": "block"}, default="redact", mode="enforce")
PATH = ("choices", 0, "delta", "content")


def sse(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def run(pieces, end=True, policy=POLICY):
    s = W.StreamRewriter(policy, "sse", PATH)
    out = [f for p in pieces for f in s.frame(sse(p))] + (s.end() if end else [])
    texts = [json.loads(f[6:])["choices"][0]["delta"]["content"] for f in out if f != "data: [DONE]"]
    return "".join(texts), s


def test_values_across_frames():
    text = "write to someone@mail.example.com today. " * 20
    want = text.replace("someone@mail.example.com", "[REDACTED:email]")
    for size in (1, 3, 7, 50, 10_000):
        got, s = run([text[i : i + size] for i in range(0, len(text), size)])
        assert got == want
    assert s.texts.by_type["email"] >= 20


def test_a_block_ends_the_stream():
    got, s = run(["x" * 300, " ghp_" + "a" * 20, "a" * 16 + " rest"])
    assert s.stopped and "ghp_" not in got


def test_done_comes_after_the_tail():
    s = W.StreamRewriter(POLICY, "sse", PATH)
    assert s.frame(sse("short"))[0] == sse("").replace(": ", ":").replace("data:", "data: ").replace(", ", ",")
    out = s.frame("data: [DONE]")
    assert "short" in out[0] and out[1] == "data: [DONE]"


def test_frames():
    s = frames.Splitter("sse")
    assert s.push("data: a\n\nda") == ["data: a"] and s.push("ta: b\n\n") == ["data: b"] and s.flush() == []
    assert frames.parsed("event: x\ndata: {\"a\":\ndata: 1}", "sse") == ("json", {"a": 1})
    assert frames.serialized("event: x\ndata: 1\nid: 3", "sse", {"a": 1}) == 'event: x\ndata: {"a":1}\nid: 3'
    assert frames.parsed(": comment", "sse")[0] == "control" and frames.parsed("hello", "ndjson") == ("text", "hello")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k}", i, sse(f"mail a{k}@b.com part {i} " * 9)) for k in range(3) for i in range(4)] + [(f"s{k}", 4, None) for k in range(3)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, frame string")
    df.where("seq < 2").coalesce(1).write.json(f"{tmp_path}/in")
    want = sorted(map(tuple, W.rewrite_batch(df, POLICY).collect()))
    stream = spark.readStream.schema(df.schema).json(f"{tmp_path}/in")
    q = W.rewrite_stream(stream, POLICY).writeStream.format("memory").queryName("rewritten").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
        df.where("seq >= 2").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("rewritten").collect()))
    finally:
        q.stop()
    assert got == want and "[REDACTED:email]" in "".join(x[3] for x in got)
