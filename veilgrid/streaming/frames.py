"""Frames of streams: server-sent events (ended by a blank line) and lines of JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = "[DONE]"


def split_frames(rows: DataFrame, column: str, form: str) -> DataFrame:
    """Rows with frame and frame_no for each frame of a text; blank ones are passed over."""
    parts = F.split(F.regexp_replace(F.col(column), "\r\n", "\n"), "\n\n+" if form == "sse" else "\n")
    full = F.filter(parts, lambda p: F.trim(p) != "")
    return rows.select("*", F.posexplode(full).alias("frame_no", "frame"))


def frame_data(frame: Column) -> Column:
    """The data lines of an event, joined by line feeds; null without any."""
    lines = F.filter(F.split(frame, "\n"), lambda x: x.startswith("data:"))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))


def frame_kind(data: Column) -> Column:
    """control, json or text."""
    return F.when(data.isNull() | (F.trim(data) == CONTROL), "control").when(F.try_parse_json(data).isNotNull(), "json").otherwise("text")


class Splitter:
    """Frames of a text that comes in pieces; what is not ended yet is kept."""

    def __init__(self, form: str, rest: str = ""):
        self.form, self.rest = form, rest

    def push(self, piece: str) -> list[str]:
        text = (self.rest + piece).replace("\r\n", "\n")
        *done, self.rest = re.split(r"\n\n" if self.form == "sse" else r"\n", text)
        return [x for x in done if x.strip()]

    def flush(self) -> list[str]:
        rest, self.rest = self.rest, ""
        return [rest] if rest.strip() else []


def parsed(frame: str, form: str) -> tuple[str, object]:
    """(kind, value) of a frame."""
    data = frame
    if form == "sse":
        lines = [x[5:].removeprefix(" ") for x in frame.split("\n") if x.startswith("data:")]
        if not lines:
            return "control", None
        data = "\n".join(lines)
    if data.strip() == CONTROL:
        return "control", None
    try:
        return "json", json.loads(data)
    except ValueError:
        return "text", data


def serialized(frame: str, form: str, value) -> str:
    """A frame with another value; lines that are no data stay where they are."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if form != "sse":
        return text
    out, done = [], False
    for line in frame.split("\n"):
        if not line.startswith("data:"):
            out.append(line)
        elif not done:
            out += [f"data: {x}" for x in text.split("\n")]
            done = True
    return "\n".join(out if done else [*out, *(f"data: {x}" for x in text.split("\n"))])


def capped(rows: DataFrame, most: int, stream: str = "stream_id", seq: str = "seq", frame: str = "frame") -> DataFrame:
    """Frames that are passed on as they are, up to a number of bytes a stream; truncated marks the first that is not."""
    from pyspark.sql import Window

    over = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_sum", F.sum(F.octet_length(frame)).over(over))
    return sums.where(F.col("_sum") - F.octet_length(frame) <= most).withColumn("truncated", F.col("_sum") > most).drop("_sum")
