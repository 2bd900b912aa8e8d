"""Streams that no frame ends, and pairs of requests and responses, in batch and in streaming queries."""

import datetime
import json
import time

import pytest

from veilgrid.operators import policy as P
from veilgrid.streaming import pairing, rewriter as W

POLICY = P.build(actions={"email": "redact"}, default="allow", mode="enforce")


def frame(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def text_of(rows):
    return "".join(json.loads(r.frame[6:])["choices"][0]["delta"]["content"] for r in sorted(rows, key=lambda r: (r.seq, r.place)) if r.frame and r.frame.startswith("data: {"))


def test_batch_streams_keep_their_tails(spark):
    rows = [("a", 1, frame("hello a@b.c")), ("a", 2, frame("om world ")), ("a", 3, frame("tail of a")), (None, 1, frame("x@y.org of none")), (None, 2, frame(" and more")), ("b", 1, None), ("c", 1, frame("")), ("d", None, frame("no seq"))]
    got = W.rewrite_batch(spark.createDataFrame(rows, "stream_id string, seq long, frame string").repartition(3), POLICY).collect()
    assert {k: text_of([r for r in got if r.stream_id == k]) for k in ("a", None, "b", "c", "d")} == {"a": "hello [REDACTED:email] world tail of a", None: "[REDACTED:email] of none and more", "b": "", "c": "", "d": ""}
    tallied = W.tallies(spark.createDataFrame(rows, "stream_id string, seq long, frame string"), POLICY).where("field = 'type'").collect()
    assert {(r.stream_id, r.name, r.n) for r in tallied} == {("a", "email", 1), (None, "email", 1)}


def test_a_block_in_the_tail_ends_the_stream(spark):
    block = P.build(actions={"email": "block"}, default="allow", mode="enforce")
    got = W.rewrite_batch(spark.createDataFrame([("a", 1, frame("so a@b.com"))], "stream_id string, seq long, frame string"), block).collect()
    assert [(r.stopped, text_of([r])) for r in sorted(got, key=lambda r: r.place)] == [(False, ""), (True, "")]


class Files:
    """A folder that a streaming query reads; rows are added as files."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, f"{path}/in", schema, 0
        self.frame([]).write.mode("append").json(self.path)

    def frame(self, rows):
        return self.spark.createDataFrame(rows, self.schema)

    def add(self, rows):
        self.frame(rows).coalesce(1).write.mode("append").json(self.path)

    def read(self):
        return self.spark.readStream.schema(self.schema).json(self.path)


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end
        time.sleep(0.3)


def test_a_silent_stream_ends_by_a_timer_and_keeps_no_state(spark, tmp_path):
    files = Files(spark, tmp_path, "stream_id string, seq long, frame string")
    files.add([("a", 1, frame("hello a@b.c")), ("a", 2, frame("om, held back")), ("e", 1, frame("ended ")), ("e", 2, None)])
    q = W.rewrite_stream(files.read(), POLICY, idle_seconds=2).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(processingTime="1 second").start()
    try:
        found = lambda k: [r for r in spark.sql("SELECT * FROM silent").collect() if r.stream_id == k]
        wait_for(lambda: text_of(found("e")) == "ended ")
        assert "held back" not in text_of(found("a")) or len(found("a")) > 2
        # no frame of it comes any more; the timer alone ends it
        wait_for(lambda: text_of(found("a")) == "hello [REDACTED:email], held back")
        files.add([("a", 2, frame("om, held back")), ("b", 1, frame("b"))])
        wait_for(lambda: text_of(found("b")) == "b")
        assert text_of(found("a")) == "hello [REDACTED:email], held back"  # a frame that comes again is passed over
    finally:
        q.stop()
    state = spark.read.format("statestore").option("stateVarName", "stream").load(f"{tmp_path}/cp")
    assert state.where("key.stream_id IN ('a', 'e')").count() == 0


PAIRED = "session string, direction string, at timestamp, seq long, line string"


def rpc(session, direction, second, seq, id_, method="m"):
    line = id_ if isinstance(id_, bytes) else json.dumps({"jsonrpc": "2.0", "id": id_, "method": method})
    return session, direction, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second), seq, line if isinstance(line, str) else line.decode()


MESSAGES = [
    rpc("s", "request", 0, 1, 1, "a"), rpc("s", "response", 5, 2, 1), rpc("s", "request", 0, 3, "1", "b"), rpc("s", "request", 3, 4, "1", "c"), rpc("s", "response", 4, 5, "1"),
    rpc("s", "request", 1, 6, 2, "d"), rpc("s", "response", 99, 7, 2), rpc("s", "response", 7, 8, 3), rpc("s", "request", 7, 9, 4, "e"), rpc("s", "response", 7, 10, 4), rpc("t", "response", 5, 11, 1),
    rpc("s", "request", 2, 12, None, "notice"), rpc("s", "request", 2, 13, b"{no"), rpc("s", "request", 2, 14, b'{"id": 9}'), rpc(None, "request", 2, 15, 5, "f"), rpc("s", "response", 10, 16, 6), rpc("s", "request", 0, 17, 6, "g"),
]
WANT = {("s", "1", "answered", "a"), ("s", '"1"', "repeated", "b"), ("s", '"1"', "answered", "c"), ("s", "2", "unanswered", "d"), ("s", "2", "unasked", None), ("s", "3", "unasked", None), ("s", "4", "answered", "e"), ("t", "1", "unasked", None), (None, "5", "unanswered", "f"), ("s", "6", "unanswered", "g"), ("s", "6", "unasked", None)}


def said(rows):
    return {(r.session, r.rpc_id, r.outcome, r.method) for r in rows}


def test_pairs_in_batch(spark):
    got = pairing.paired(spark.createDataFrame(MESSAGES, PAIRED), 10).collect()
    assert said(got) == WANT and len(got) == len(WANT)
    assert all((r.answered_at is not None) == (r.outcome in ("answered", "unasked")) and (r.asked_at is None) == (r.outcome == "unasked") for r in got)
    assert pairing.paired(spark.createDataFrame([], PAIRED), 10).count() == 0


@pytest.mark.parametrize("batches", [1, 3])
def test_pairs_of_a_stream_end_by_timers(spark, tmp_path, batches):
    files, rows = Files(spark, tmp_path, PAIRED), sorted(MESSAGES, key=lambda m: m[2])
    name = f"pairs{batches}"
    q = pairing.pair_stream(files.read(), 10, "2 seconds").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        for i in range(batches):
            files.add(rows[len(rows) * i // batches : len(rows) * (i + 1) // batches])
            q.processAllAvailable()
        # requests that nothing answers end when time has passed them, though their session stays silent
        files.add([rpc("clock", "response", 500, 99, 1)])
        q.processAllAvailable()
        wait_for(lambda: said(spark.sql(f"SELECT * FROM {name}").collect()) >= WANT, 30)
        assert said(spark.sql(f"SELECT * FROM {name} WHERE session IS NULL OR session <> 'clock'").collect()) == WANT
    finally:
        q.stop()
