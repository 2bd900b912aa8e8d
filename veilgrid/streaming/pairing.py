"""Requests and responses of a session's two directions, paired by their JSON-RPC id.

A request is ``answered`` by the next message of its session and id if that is a response that comes within the time limit,
``repeated`` if it is another request within it, else ``unanswered``; a response that no request waits for is ``unasked``.
Messages without an id ask for no answer and are passed over, as are lines that are no JSON-RPC messages. Of messages at
the same time requests come first, then those with the smaller ``seq``. Null sessions are one session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRED = "session string, rpc_id string, outcome string, method string, asked_at timestamp, answered_at timestamp"


def messages(rows: DataFrame) -> DataFrame:
    """session, rpc_id (as JSON, so 1 and "1" differ), asks, method, at, seq of lines (session, direction, at, seq, line)."""
    v = F.try_parse_json("line")
    rows = rows.select(F.col("session").cast("string").alias("session"), (F.col("direction") == "request").alias("asks"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), v.alias("v"))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    kept = rows.where((got("$.jsonrpc", "string") == "2.0") & F.col("at").isNotNull() & F.col("asks").isNotNull())
    found = kept.select("session", F.to_json(got("$.id", "variant")).alias("rpc_id"), "asks", got("$.method", "string").alias("method"), "at", "seq")
    return found.where("rpc_id IS NOT NULL AND rpc_id <> 'null'")


def paired(rows: DataFrame, limit_seconds: int) -> DataFrame:
    """The outcomes of lines that are all there, one for each request and each response that is not asked for. Only neighbours within a session and id
    matter, so a window does it."""
    order = Window.partitionBy("session", "rpc_id").orderBy("at", F.desc("asks"), "seq")
    late = lambda a, b: F.unix_micros(b) - F.unix_micros(a) >= limit_seconds * 1_000_000
    near = messages(rows).withColumns({c: f("asks").over(order) for c, f in (("next", F.lead), ("before", F.lag))})
    near = near.withColumns({"next_at": F.lead("at").over(order), "before_at": F.lag("at").over(order)})
    waits = F.col("next").isNotNull() & ~late(F.col("at"), F.col("next_at"))
    asked = F.coalesce(F.col("before") & ~late(F.col("before_at"), F.col("at")), F.lit(False))
    outcome = F.when(~F.col("asks"), F.when(~asked, "unasked")).when(waits & ~F.col("next"), "answered").when(waits, "repeated").otherwise("unanswered")
    found = near.withColumn("outcome", outcome).where("outcome IS NOT NULL")
    return found.select("session", "rpc_id", "outcome", *(F.when(F.col("asks"), F.col(c)).alias(d) for c, d in (("method", "method"), ("at", "asked_at"))), F.when(F.col("outcome") == "answered", F.col("next_at")).when(~F.col("asks"), F.col("at")).alias("answered_at"))


def pair_stream(rows: DataFrame, limit_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """The same of a stream. A waiting request is the only state of a session and id; a timer of event time ends it when
    the watermark, ``delay`` behind the newest message, has passed its limit. Messages are taken as they come, in their order within a micro-batch."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    limit = limit_seconds * 1_000_000
    columns = [c.split()[0] for c in PAIRED.split(", ")]

    def micros(t: pd.Timestamp) -> int:
        return t.value // 1000

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "at timestamp, method string")

        def _out(self, key, outcome: str, method, asked, answered) -> tuple:
            return key[0], key[1], outcome, method, asked, answered

        def _take(self) -> tuple | None:
            """The waiting request, which waits no longer."""
            if not self.waiting.exists():
                return None
            at, method = self.waiting.get()
            self.waiting.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            return pd.Timestamp(at), method

        def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            out = []
            rows = pd.concat(list(batches)).sort_values(["at", "asks", "seq"], ascending=[True, False, True])
            for at, asks, method in zip(rows["at"], rows["asks"], rows["method"]):
                method = None if method != method else method
                held = self._take()
                if held and micros(at) - micros(held[0]) >= limit:
                    out.append(self._out(key, "unanswered", held[1], held[0], None))
                    held = None
                if held:
                    out.append(self._out(key, "repeated" if asks else "answered", held[1], held[0], None if asks else at))
                elif not asks:
                    out.append(self._out(key, "unasked", None, None, at))
                if asks:
                    self.waiting.update((at.to_pydatetime(), method))
                    self.handle.registerTimer((micros(at) + limit) // 1000)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self._take()
            if held:
                yield pd.DataFrame([self._out(key, "unanswered", held[1], held[0], None)], columns=columns)

        def close(self) -> None:
            pass

    kept = messages(rows).withWatermark("at", delay)
    return kept.groupBy("session", "rpc_id").transformWithStateInPandas(Processor(), PAIRED, "append", "EventTime")
