"""Rewriting of streams: sensitive values are found even where they are split over frames.

The text of a stream's delta channel runs through a buffer that holds back the last HELD characters, and more where a
detection reaches into them; what leaves it is rewritten. Other texts of a frame are rewritten in place. Before a frame
that ends a run of deltas, and at the end, what is held back goes out in a frame made after the last delta. A block ends a
stream. Frames carry a growing ``seq`` for each stream; a lower one than before is passed over. State is a key's own and
bounded by what is held back.

With keys, values get tokens of the vault or are sealed. The rewriting puts marks that it draws itself where sealed values
belong; what encrypts them, and the vault's records, is native and follows in the same plan, so it is alike in batch and in
a streaming query, and values leave a stream in envelopes only."""

from __future__ import annotations

import copy
import hashlib
import json
import secrets
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators import detect
from veilgrid.operators.policy import Policy
from veilgrid.operators.trees import built, get_path, rewrite_tree, safe_path, sealed_mark, sealed_text
from veilgrid.streaming.frames import parsed, serialized

HELD = 256
#: Characters of a text, and texts, that are remembered to have no spans.
SHORT, MOST_PLAIN = 32, 1024


@dataclass(frozen=True)
class Keys:
    """``sealing`` encrypts what should be encrypted, and the records of tokens; ``token`` makes tokens of the vault."""

    sealing: bytes
    token: bytes | None = None


class TextRewriter:
    """The policy on single texts, with counts. Precision dials do not apply to streams. ``made`` has, for each value that
    was sealed or got a token of the vault, its mark or token, the value, safe path, type and rule."""

    def __init__(self, policy: Policy, direction: str = "response", keys: Keys | None = None):
        self.policy, self.rules, self.direction, self.keys = policy, detect.rules_for(direction), direction, keys
        self.made: list[tuple[str, str, str, str, str]] = []
        self.by_type: Counter[str] = Counter()
        self.by_action: Counter[str] = Counter()
        self.plain: set[tuple[str, str]] = set()

    def spans(self, text: str, kind: str = "value") -> list[tuple]:
        return detect.scan(text, kind, self.rules, self.direction)

    def _instead(self, type_: str, rule: str, action: str, value: str, path: tuple) -> str:
        if self.keys and action == "encrypt":
            mark = sealed_mark()
            self.made.append((mark, value, safe_path(path), type_, rule))
            return mark
        if self.keys and self.keys.token and action == "tokenize":
            token = T.vault_token_of(self.keys.token, type_, value)
            self.made.append((token, value, safe_path(path), type_, rule))
            return f"[TOKEN:{token}]"
        return _replaced(type_, action, value)

    def rewrite(self, text: str, kind: str = "value", path: tuple = ()) -> tuple[str, bool]:
        """The text as the policy wants it, and whether it is blocked. Short texts without spans, as keys of frames are, are
        looked at once."""
        if (text, kind) in self.plain:
            return text, False
        out, at, found, spans = [], 0, [], self.spans(text, kind)
        if not spans and len(text) <= SHORT and len(self.plain) < MOST_PLAIN:
            self.plain.add((text, kind))
        for type_, rule, _n, a, b, _c, value in spans:
            action = self.policy.actions.get(type_, self.policy.default)
            self.by_type[type_] += 1
            self.by_action[action] += 1
            found.append(action)
            if action not in ("allow", "block"):
                out += [text[at:a], self._instead(type_, rule, action, value, path)]
                at = b
        if not self.policy.enforced:
            return text, False
        return ("", True) if "block" in found else ("".join([*out, text[at:]]), False)


def _replaced(kind: str, action: str, value: str) -> str:
    if action == "mask":
        return "*" * len(value) if len(value) <= 8 else value[:2] + "*" * max(4, len(value) - 4) + value[-2:]
    if action == "tokenize":
        return f"[TOKEN:{kind}:{hashlib.sha256(value.encode()).hexdigest()[:12]}]"
    return f"[REDACTED:{kind}]"


class Buffer:
    """The sliding buffer over a text that comes in pieces."""

    def __init__(self, rewriter: TextRewriter, held: int = HELD, pending: str = ""):
        self.rewriter, self.held, self.pending = rewriter, held, pending

    def push(self, text: str) -> tuple[str, bool]:
        self.pending += text
        cut = max(0, len(self.pending) - self.held)
        if cut and self._fits_nothing():
            head, self.pending = self.pending[:cut], self.pending[cut:]
            return head, False
        cut = min([cut, *(s[3] for s in self.rewriter.spans(self.pending) if s[4] > cut)])
        if cut <= 0:
            return "", False
        head, self.pending = self.pending[:cut], self.pending[cut:]
        return self.rewriter.rewrite(head)

    def _fits_nothing(self) -> bool:
        """Whether no rule can match in any part of what is held: what a rule needs to be there, a part has only if the whole
        has it. Parts of a text that NFKC leaves alone are left alone, too."""
        text = self.pending
        if not (text.isascii() or unicodedata.is_normalized("NFKC", text)):
            return False
        return next(detect.able(self.rewriter.rules, text), None) is None

    def flush(self) -> tuple[str, bool]:
        text, self.pending = self.pending, ""
        return self.rewriter.rewrite(text) if text else ("", False)


class StreamRewriter:
    """The frames of one stream, one after another."""

    def __init__(self, policy: Policy, form: str, delta: tuple | None, flush_types: tuple[str, ...] = (), state: dict | None = None, held: int = HELD, keys: Keys | None = None):
        state = state or {}
        self.texts = TextRewriter(policy, keys=keys)
        # what the last delta's other texts had made, which a frame made after it has as well
        self.around = [tuple(m) for m in state.get("around", ())]
        self.form, self.delta, self.flush_types = form, delta, flush_types
        self.buffer = Buffer(self.texts, held, state.get("pending", ""))
        self.template, self.stopped, self.seq = state.get("template") and json.loads(state["template"]), state.get("stopped", False), state.get("seq", -1)

    @property
    def state(self) -> dict:
        return {"pending": self.buffer.pending, "template": self.template and json.dumps(self.template), "stopped": self.stopped, "seq": self.seq, **({"around": self.around} if self.around else {})}

    def made_in(self, frame: str) -> list[tuple]:
        """What was sealed or got a token and is in a frame that goes out, each once."""
        return list({m[0]: m for m in (*self.around, *self.texts.made) if m[0] in frame}.values())

    def _tail(self) -> list[str]:
        text, self.stopped = self.buffer.flush()
        if self.stopped or not text:
            return []
        frame, value = self.template if self.template else ("data: {}" if self.form == "sse" else "{}", built(self.delta or ("text",), ""))
        return [serialized(frame, self.form, _with(value, self.delta or ("text",), text))]

    def frame(self, frame: str) -> list[str]:
        """What goes out for a frame."""
        if self.stopped:
            return []
        kind, value = parsed(frame, self.form)
        if kind == "control":
            return [*self._tail(), *([] if self.stopped else [frame])]
        if kind == "text":
            text, self.stopped = self.texts.rewrite(value)
            return [] if self.stopped else [serialized(frame, self.form, text)]
        out = []
        if isinstance(value, dict) and value.get("type") in self.flush_types:
            out = self._tail()
            if self.stopped:
                return out
        piece = get_path(value, self.delta) if self.delta else None
        is_delta = isinstance(piece, str)
        rest = _with(value, self.delta, "") if is_delta else value
        stop = False

        def change(text, kind_, path):
            nonlocal stop
            new, blocked = self.texts.rewrite(text, kind_, path)
            stop = stop or blocked
            return text if blocked else new

        before = len(self.texts.made)
        rest = rewrite_tree(rest, change)
        if not stop and is_delta:
            self.template, around = [frame, rest], self.texts.made[before:]
            self.texts.made += self.around  # of a frame that has gone out before this one
            self.around = around
            text, stop = self.buffer.push(piece)
            rest = _with(rest, self.delta, text)
        self.stopped = stop
        return out if stop else [*out, serialized(frame, self.form, rest)]

    def end(self) -> list[str]:
        return [] if self.stopped else self._tail()


def _with(value, path: tuple, leaf):
    """The tree with another leaf at a path that exists; what holds it is copied, the rest is shared."""
    out = copy.copy(value)
    out[path[0]] = _with(value[path[0]], path[1:], leaf) if len(path) > 1 else leaf
    return out


OUTPUT = "stream_id string, seq long, place int, frame string, stopped boolean"


def rewrite_stream(
    frames: DataFrame, policy: Policy, form: str = "sse", delta: tuple | None = ("choices", 0, "delta", "content"), flush_types: tuple[str, ...] = (), held: int = HELD,
    idle_seconds: float | None = None, remember_seconds: float = 86_400, keys: Keys | None = None, aad: Column | None = None,
) -> DataFrame:
    """Frames (stream_id, seq, frame; a null frame ends a stream) as a streaming query with state for each stream.

    With ``idle_seconds`` a stream that brings nothing for so long is ended by a timer: what it holds back goes out. An
    ended or blocked stream keeps no state but its last seq and whether it was blocked, so that a frame that comes again is
    passed over; with ``idle_seconds`` that goes as well after ``remember_seconds``. Frames of a null stream_id are one stream.

    With ``keys`` a column ``issued`` follows: token, type, path, rule_id and envelope of each token of the vault in a frame;
    sealed values are bound by ``seal_aad`` to ``aad``, a column of the output's. A frame that is worked on again after a
    failure has other envelopes, of the same values."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    timed = idle_seconds is not None

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("stream", "state string")
            self.ended = handle.getValueState("ended", "state string", int(remember_seconds * 1000) if timed else None)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = next((json.loads(k.get()[0]) for k in (self.kept, self.ended) if k.exists()), {})
            s = StreamRewriter(policy, form, delta, flush_types, before, held, keys)
            found = pd.concat(list(rows)).sort_values("seq")
            out = list(_run(s, key[0], found))
            for t in list(self.handle.listTimers()) if timed else ():
                self.handle.deleteTimer(t)
            last = found["frame"].iloc[-1]
            if s.stopped or last is None or last != last:
                self._forget(s)
            else:
                self.kept.update((json.dumps(s.state),))
                if timed:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(idle_seconds * 1000))
            yield _frame_of(out, keys)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.kept.exists():
                s = StreamRewriter(policy, form, delta, flush_types, json.loads(self.kept.get()[0]), held, keys)
                out = _ended(s, key[0])
                self._forget(s)
                yield _frame_of(out, keys)

        def _forget(self, s: StreamRewriter) -> None:
            self.kept.clear()
            self.ended.update((json.dumps({"seq": s.seq, "stopped": s.stopped}),))

        def close(self) -> None:
            pass

    return _finished(frames.groupBy("stream_id").transformWithStateInPandas(Processor(), _schema(keys), "append", "ProcessingTime" if timed else "None"), keys, aad)


_COLUMNS = ["stream_id", "seq", "place", "frame", "stopped"]
_MADE = ["mark", "value", "path", "type", "rule_id"]


def _schema(keys: Keys | None) -> str:
    return OUTPUT + (f", made array<struct<{','.join(f'{c}:string' for c in _MADE)}>>" if keys else "")


def _frame_of(rows: list[tuple], keys: Keys | None) -> pd.DataFrame:
    out = pd.DataFrame([r[:5] for r in rows], columns=_COLUMNS)
    if keys:
        out["made"] = pd.Series([[dict(zip(_MADE, m)) for m in r[5]] for r in rows], dtype=object)
    return out


def _finished(rows: DataFrame, keys: Keys | None, aad: Column | None) -> DataFrame:
    """Rows with envelopes where the marks are, and records of tokens; natively."""
    if not keys:
        return rows
    is_mark = lambda x: x["mark"].startswith(sealed_mark("")[0])
    frame = F.aggregate(F.filter("made", is_mark), F.col("frame"), lambda t, x: F.replace(t, x["mark"], sealed_text(x, keys.sealing, aad)))
    record = lambda x: F.struct(x["mark"].alias("token"), x["type"].alias("type"), x["path"].alias("path"), x["rule_id"].alias("rule_id"), T.encrypt(x["value"], keys.sealing, x["mark"]).alias("envelope"))
    return rows.select("stream_id", "seq", "place", frame.alias("frame"), "stopped", F.transform(F.filter("made", lambda x: ~is_mark(x)), record).alias("issued"))
#: The place of what goes out after a stream's last frame.
_TAIL = 1 << 20


def _run(s: StreamRewriter, key, rows: pd.DataFrame) -> Iterator[tuple]:
    for seq, frame in zip(rows["seq"], rows["frame"]):
        if seq <= s.seq:
            continue
        was = s.stopped
        found = s.end() if frame is None or frame != frame else s.frame(frame)
        s.seq = int(seq)
        for place, f in enumerate(found):
            yield key, int(seq), place, f, False, s.made_in(f)
        s.texts.made.clear()
        if s.stopped and not was:
            yield key, int(seq), len(found), None, True, []


def _ended(s: StreamRewriter, key) -> list[tuple]:
    """What goes out at the end of a stream that no frame ended."""
    was = s.stopped
    out = [(key, s.seq, _TAIL + i, f, False, s.made_in(f)) for i, f in enumerate(s.end())]
    return [*out, (key, s.seq, _TAIL + len(out), None, True, [])] if s.stopped and not was else out


def _streams(batches: Iterator[pd.DataFrame], new, done, took: bool = True) -> Iterator[list[tuple]]:
    """The output of sorted rows, a list for each batch: each stream's own, and what ``done`` makes of it at its end."""
    nothing = object()
    now, s = nothing, None
    for batch in batches:
        out = []
        for key, rows in batch.groupby("stream_id", sort=False, dropna=False):
            key = None if key != key else key
            if key != now or now is nothing:
                out += done(s, now) if s else []
                now, s = key, new()
            found = list(_run(s, key, rows))
            out += found if took else []
        yield out
    yield done(s, now) if s else []


def rewrite_batch(frames: DataFrame, policy: Policy, form: str = "sse", delta: tuple | None = ("choices", 0, "delta", "content"), flush_types: tuple[str, ...] = (), held: int = HELD, keys: Keys | None = None, aad: Column | None = None) -> DataFrame:
    """The same for frames that are all there: rows are sorted by stream and seq and stream through a task, which holds one
    stream's state. A stream ends with its last row, whether or not a frame says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _streams(batches, lambda: StreamRewriter(policy, form, delta, flush_types, None, held, keys), _ended):
            yield _frame_of(out, keys)

    return _finished(_sorted(frames).mapInPandas(run, _schema(keys)), keys, aad)


def _sorted(frames: DataFrame) -> DataFrame:
    rows = frames.selectExpr("cast(stream_id as string) stream_id", "cast(seq as long) seq", "frame").where("seq is not null")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq")


def tallies(frames: DataFrame, policy: Policy, form: str = "sse", delta: tuple | None = ("choices", 0, "delta", "content"), flush_types: tuple[str, ...] = (), held: int = HELD) -> DataFrame:
    """stream_id, field (type or action), name, n: what was found in each stream up to its end, or to where a block ended
    it. Streams in which nothing was found have no row."""

    def of(s: StreamRewriter, key) -> list[tuple]:
        s.end()
        both = (("type", s.texts.by_type), ("action", s.texts.by_action))
        return [(key, field, name, n) for field, counts in both for name, n in sorted(counts.items())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _streams(batches, lambda: StreamRewriter(policy, form, delta, flush_types, None, held), of, took=False):
            yield pd.DataFrame(out, columns=["stream_id", "field", "name", "n"])

    return _sorted(frames).mapInPandas(run, "stream_id string, field string, name string, n long")


def protect_rpc(rows: DataFrame, policy: Policy, methods: list[str]) -> DataFrame:
    """JSON-RPC lines (direction, line): params of requests and results of responses as the policy wants them. Requests
    with another method or that are blocked are refused, notifications among them dropped. out, verdict (pass, reject,
    drop)."""
    from pyspark.sql import functions as F

    def one(direction: str, line: str) -> tuple[str | None, str]:
        try:
            m = json.loads(line)
        except ValueError:
            return None, "reject"
        refuse = "reject" if isinstance(m, dict) and "id" in m else "drop"
        if not isinstance(m, dict) or m.get("jsonrpc") != "2.0":
            return None, refuse
        field = "params" if direction == "request" else "result"
        if direction == "request" and "*" not in methods and m.get("method") not in methods:
            return None, refuse
        texts, stop = TextRewriter(policy, direction), False

        def change(t, kind, _):
            nonlocal stop
            new, b = texts.rewrite(t, kind)
            stop = stop or b
            return t if b else new

        if field in m:
            m = {**m, field: rewrite_tree(m[field], change)}
        return (None, refuse) if stop else (json.dumps(m, ensure_ascii=False), "pass")

    @F.pandas_udf("struct<out:string,verdict:string>")
    def run(d: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x, y) for x, y in zip(d, s)], columns=["out", "verdict"])

    return rows.withColumn("_r", run("direction", "line")).select("*", "_r.*").drop("_r")
