"""A streaming source of frames in files that grow: server-sent events, ended by a blank line, or lines of JSON.

A file is a stream. How far it has been read is its offset, always the end of a whole frame: half a frame at a file's end
waits until the rest is there, and is read with it from the file, so nothing has to be kept of it. A micro-batch is a set of byte ranges, read
by tasks; a frame belongs to the range it begins in. After a restart reading goes on from the offsets in the checkpoint. Read
as a batch, files are complete, and what stands after the last end is a frame as well."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from veilgrid.sources.tail import FIRST, RANGE, Range, _store

FRAMES = "stream_id string, seq long, frame string"
#: What ends a frame of each form: all line ends in a row, if there are two at least, or one.
ENDS = {"sse": re.compile(rb"(?:\r?\n){2,}"), "lines": re.compile(rb"\n")}


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a folder, or one file, with their sizes; those whose names begin with a dot or an underscore are none."""
    from pyarrow import fs

    store, root = _store(path)
    one = store.get_file_info(root)
    if one.type == fs.FileType.NotFound:
        return []
    found = [one] if one.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


def whole_until(f, start: int, size: int, form: str) -> int:
    """Where the last whole frame between ``start`` and ``size`` ends; ``start`` if none does. Read from the end backwards."""
    step = FIRST
    while True:
        low = max(start, size - step)
        f.seek(low)
        data = f.read(size - low)
        last = None
        for last in ENDS[form].finditer(data):  # noqa: B007
            pass
        # an end that the window's begin may have cut is found with the next, larger window
        if last is not None and (low == start or last.start() > 3):
            return low + last.end()
        if low == start:
            return start
        step *= 2


def _read(f, n: int) -> bytes:
    """``n`` bytes, and more where they would stop among line ends, so that no run of them is cut."""
    data = f.read(n)
    while data and data[-1] in b"\r\n" and (more := f.read(16)):
        data += more
    return data


def _ranges(file: str, start: int, end: int) -> list[Range]:
    return [Range(file, a, min(end, a + RANGE), a > start) for a in range(start, end, RANGE)]


class GrowingFrames(DataSource):
    """Options: ``path`` and ``form``, sse or lines."""

    @classmethod
    def name(cls) -> str:
        return "growing_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Frames:
    def __init__(self, options: dict):
        self.path, self.form = options["path"], options.get("form", "sse")
        if self.form not in ENDS:
            raise ValueError("form must be sse or lines")

    def read(self, part: Range) -> Iterator[tuple]:
        """The frames that begin in a range. Its begin is a frame's unless ``inside`` says that others come before."""
        if not part.file:
            return
        end, name = ENDS[self.form], part.file.rsplit("/", 1)[1]
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            at = part.start
            if part.inside:
                back = max(0, at - 4)
                f.seek(back)
                data = _read(f, part.end - back)
                found = end.search(data)
                # the first frame that begins here follows the first end that reaches here
                while found is not None and back + found.end() < at:
                    found = end.search(data, found.end())
                if found is None:
                    return
                at = back + found.end()
            f.seek(at)
            data, begin = _read(f, max(0, part.end - at)), at
            place = 0
            while begin + place < part.end:
                found = end.search(data, place)
                while found is None and (more := _read(f, FIRST)):
                    data += more
                    found = end.search(data, max(place, len(data) - len(more) - 3))
                stop = found.start() if found else len(data)
                frame = data[place:stop]
                if frame.strip():
                    # line ends that came after the frame before had been read are none of this one
                    blank = len(frame) - len(frame.lstrip(b"\r\n")) if self.form == "sse" else 0
                    yield name, begin + place + blank, frame[blank:].decode("utf-8", "replace").replace("\r\n", "\n")
                if found is None:
                    return
                place = found.end()


class _Batch(_Frames, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in _files(self.path) for r in _ranges(file, 0, size)] or [Range("", 0, 0, False)]


class _Stream(_Frames, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = _store(self.path)
        for file, size in _files(self.path):
            start = self.known.get(file, 0)
            if size > start:
                with store.open_input_file(file) as f:
                    self.known[file] = whole_until(f, start, size, self.form)
        return {k: v for k, v in self.known.items() if v}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for file, at in end.items():  # after a restart
            self.known[file] = max(at, self.known.get(file, 0))
        return [r for file, to in sorted(end.items()) for r in _ranges(file, start.get(file, 0), to)] or [Range("", 0, 0, False)]

    def commit(self, end: dict) -> None:
        pass


def frames_of(spark: SparkSession, path: str, form: str = "sse", stream: bool = False) -> DataFrame:
    """stream_id (a file's name), seq (where the frame begins in it) and frame."""
    spark.dataSource.register(GrowingFrames)
    return (spark.readStream if stream else spark.read).format("growing_frames").option("path", path).option("form", form).load()
