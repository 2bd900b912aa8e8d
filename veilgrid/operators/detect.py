"""Detection: spans of sensitive values in texts, as an array column.

One vectorised function runs all rules with ASCII word classes, which neither Java's nor a plan of 37 native expressions
gives at this cost; what follows it (overlaps, precision, policy, rewriting, counts) is native. Rules are chosen when the
plan is built, so rules of the other direction cost nothing. Offsets count code points."""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgrid.operators.factors import Prefilter
from veilgrid.operators.rules import RULES, Rule, validated

SPAN = "struct<type:string,rule_id:string,rule:int,start:int,end:int,confidence:double,value:string>"
_NAMES = ["type", "rule_id", "rule", "start", "end", "confidence", "value"]
_SPANS = pa.list_(pa.field("element", pa.struct(list(zip(_NAMES, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()])))))
#: Texts, or spans from which on, that are Python objects at once.
PART_TEXTS, PART_SPANS = 1024, 4096
DECODE_LENGTHS = (16, 8192)
#: Markers that the engine's own rewriting leaves; [SEALED:...] holds an encrypted value's envelope.
_MARKER = re.compile(r"\[(TOKEN|SEALED|REDACTED):([^\]]*)\]")
_SPACE = "[\t\n\x0b\x0c\r    -     　﻿]"


@lru_cache(maxsize=None)
def _compiled(rule: Rule) -> tuple[re.Pattern, re.Pattern | None]:
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0) | (re.MULTILINE if rule.multiline else 0) | (re.DOTALL if rule.dotall else 0)
    spaced = lambda p: p.replace(r"[-\s]", f"[-{_SPACE[1:]}").replace(r"[-.\s]", f"[-.{_SPACE[1:]}").replace(r"\s", _SPACE)
    return re.compile(spaced(rule.pattern), flags), re.compile(spaced(rule.after), flags) if rule.after else None


def matches(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    """Places of a rule's matches, left to right without overlap, not yet checked."""
    pattern, after = _compiled(rule)
    if rule.sticky:
        at = 0
        while (m := pattern.match(text, at)) and m.end() > at:
            yield m.span()
            at = m.end()
        return
    if after is None:
        for m in pattern.finditer(text):
            yield m.span()
        return
    # where keys end, overlapping keys included; then the values there
    ends, at = set(), 0
    while m := after.search(text, at):
        ends.add(m.end())
        if m.group()[-1] in "'\"":
            ends.add(m.end() - 1)
        stop = m.end()
        while stop > m.start() and text[stop - 1].isspace():
            stop -= 1
            ends.add(stop)
        at = m.start() + 1
    done = 0
    for e in sorted(ends):
        if e >= done and (m := pattern.match(text, e)):
            yield m.span()
            done = m.end()


@lru_cache(maxsize=64)
def _prefilter(rules: tuple[Rule, ...]) -> Prefilter:
    return Prefilter([[p for p in _compiled(r) if p is not None] for r in rules])


#: What was worked out for the last tuples of rules, by the tuple itself, as looking at all rules again for each text would take longer.
_LAST: dict[int, tuple] = {}


def _of(rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], Prefilter, tuple[Rule, ...], dict[str, int]]:
    """The rules, their prefilter, those that look into decoded text, and all these rules' numbers."""
    found = _LAST.get(id(rules))
    if found is None:
        if len(_LAST) >= 64:
            _LAST.clear()
        inside = [(k, r) for k, r in enumerate(rules) if r.decodes]
        found = _LAST[id(rules)] = rules, _prefilter(rules), tuple(r for _, r in inside), {r.id: k for k, r in inside}
    return found


def able(rules: Iterable[Rule], text: str) -> Iterator[tuple[int, Rule]]:
    """The rules, with their numbers, that could match a text."""
    rules = rules if isinstance(rules, tuple) else tuple(rules)
    for k in _of(rules)[1].able(text):
        yield k, rules[k]


def _first(rules: Iterable[Rule], text: str) -> Iterator[tuple[int, Rule]]:
    for k, rule in able(rules, text):
        if any(validated(rule, text[a:b]) for a, b in matches(rule, text)):
            yield k, rule


def position_stable(text: str, folded: str) -> bool:
    """Whether folding leaves every character at its place."""
    return len(text) == len(folded) and all(len(unicodedata.normalize("NFKC", c)) == 1 for c in text) and "".join(unicodedata.normalize("NFKC", c) for c in text) == folded


def decoded(text: str) -> str | None:
    """The text behind base64, base64url or percent escapes; null unless it is canonical and valid."""
    if not DECODE_LENGTHS[0] <= len(text) <= DECODE_LENGTHS[1]:
        return None
    data = None
    if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", text) and len(text) % 4 == 0:
        data, again = text, base64.b64encode
    elif re.fullmatch(r"[A-Za-z0-9_-]+", text) and len(text) % 4 != 1:
        data, again = text + "=" * (-len(text) % 4), base64.urlsafe_b64encode
    if data is not None:
        try:
            raw = base64.b64decode(data.translate(str.maketrans("-_", "+/")))
            if raw and again(raw).decode().rstrip("=") == text.rstrip("="):
                return raw.decode()
        except (binascii.Error, ValueError):
            pass
    if re.search(r"%[0-9A-Fa-f]{2}", text) and not re.search(r"%(?![0-9A-Fa-f]{2})", text):
        try:
            out = unquote_to_bytes(text).decode()
        except UnicodeDecodeError:
            return None
        return out if out != text else None
    return None


def _own_envelope(inner: str) -> bool:
    try:
        raw = base64.b64decode(inner.translate(str.maketrans("-_", "+/")) + "=" * (-len(inner) % 4))
        value = json.loads(raw.decode())
        return base64.urlsafe_b64encode(raw).decode().rstrip("=") == inner and isinstance(value.get("kid"), str) and isinstance(value.get("aad_hash"), str)
    except (ValueError, AttributeError, binascii.Error):
        return False


def marker_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int]]:
    """Places of markers that this engine wrote and that hide no detection themselves."""
    out = []
    for m in _MARKER.finditer(text) if "[" in text else ():
        kind, inner = m.groups()
        if kind == "SEALED":
            own = _own_envelope(inner)
        else:
            shapes = (r"tok_([a-z0-9_]+)_[a-f0-9]{16,}", r"([a-z][a-z0-9_]*):[a-f0-9]{8,}") if kind == "TOKEN" else (r"([a-z][a-z0-9_]*)",)
            found = next((f for s in shapes if (f := re.fullmatch(s, inner))), None)
            # the part that could be chosen freely is looked at by itself, too
            own = found is not None and not any(True for t in {inner, found[1]} for _ in _first(rules, t))
        if own:
            out.append(m.span())
    return out


def scan(text: str, kind: str, rules: tuple[Rule, ...], direction: str, numbers: bool = False, decode: bool = False) -> list[tuple]:
    """Spans (type, rule id, rule number, start, end, confidence, value) of a text. Text that NFKC changes is scanned as
    folded; where folding moves characters, a type that it has is one span over the whole."""
    if kind == "number" and direction == "response" and not numbers:
        return []
    folded = text if text.isascii() else unicodedata.normalize("NFKC", text)
    whole = lambda found: [(r.type, r.id, k, 0, len(text), r.confidence, text) for k, r in found]

    def first_of_type(found):
        seen = set()
        for k, r in found:
            if r.type not in seen:
                seen.add(r.type)
                yield k, r

    if folded != text and not position_stable(text, folded):
        out = whole(first_of_type(_first(rules, folded)))
    else:
        spared = marker_spans(text, rules) if direction == "response" else []
        out = []
        for k, rule in able(rules, folded):
            for a, b in matches(rule, folded):
                if b > a and validated(rule, folded[a:b]) and not any(a < y and b > x for x, y in spared):
                    out.append((rule.type, rule.id, k, a, b, rule.confidence, text[a:b]))
        out = greedy(out)
    if decode and kind != "number" and (inner := decoded(text)) is not None:
        inside, numbers_ = _of(rules)[2:]
        out += whole(first_of_type((numbers_[r.id], r) for _, r in _first(inside, inner)))
    return out


def greedy(spans: list[tuple]) -> list[tuple]:
    """From the left the longest, of equal ones the first rule's; what overlaps an accepted one goes."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[3], s[3] - s[4], s[2])):
        if s[3] >= end:
            out.append(s)
            end = s[4]
    return out


def rules_for(direction: str = "request", custom: Iterable[Rule] = (), only: Iterable[str] | None = None) -> tuple[Rule, ...]:
    """Rules of a direction, custom ones last; ``only`` limits them to some types."""
    types = None if only is None else set(only)
    return tuple(r for r in (*RULES, *custom) if r.direction in (None, direction) and (types is None or r.type in types))


def arrays(texts: pa.Array, kinds: pa.Array, find: Callable[[str, str], list[tuple]]) -> pa.Array:
    """The spans that ``find`` gives of each text; null for null. Texts are taken out of a batch one by one, and spans go
    into Arrow in parts, so a batch costs a worker little more than its bytes, however many texts and spans it has."""
    parts, held, size = [], [], 0
    for t, x in zip(texts, kinds):
        found = None if (t := t.as_py()) is None else [dict(zip(_NAMES, d)) for d in find(t, x.as_py())]
        held.append(found)
        size += len(found or ())
        if len(held) >= PART_TEXTS or size >= PART_SPANS:
            parts.append(pa.array(held, _SPANS))
            held, size = [], 0
    parts.append(pa.array(held, _SPANS))
    return pa.concat_arrays(parts)


def spans(text: Column, direction: str = "request", custom: Iterable[Rule] = (), only: Iterable[str] | None = None, kind: Column | None = None, numbers: bool = False, decode: bool = False) -> Column:
    """The spans of a text column; null for null, an empty array where there are none."""
    rules = rules_for(direction, custom, only)

    @F.arrow_udf(f"array<{SPAN}>")
    def run(s: pa.Array, k: pa.Array) -> pa.Array:
        return arrays(s, k, lambda t, x: scan(t, x, rules, direction, numbers, decode))

    return run(text, F.lit("value") if kind is None else kind)


def without_overlaps(found: Column) -> Column:
    """``greedy`` as a native fold over an array of spans."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["rule"] - b["rule"]))
    start = F.struct(F.filter(found, lambda _: F.lit(False)).alias("kept"), F.lit(-1).alias("end"))
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), x["end"].alias("end"))).otherwise(s)
    return F.aggregate(ordered, start, step, lambda s: s["kept"])
