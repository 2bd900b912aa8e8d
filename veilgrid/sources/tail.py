"""Reading a log of JSON lines from its end.

The files of a log, in the order of their names, are one text. A window of its last bytes is cut into ranges, a task each;
files and ranges before it are never opened. A line belongs to the range it begins in, so each is read once, and the window's
first line is left out where it began before the window. The window doubles from FIRST bytes until it holds as many records as are asked for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilgrid.operators.events import EVENT

#: Bytes of the first window, and of one range at most.
FIRST, RANGE = 64 << 10, 8 << 20
LINES = "file string, start long, bytes long, line string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    #: Whether the byte before belongs to the log as well.
    inside: bool


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def planned(path: str, window: int) -> tuple[list[Range], int]:
    """The ranges of the last ``window`` bytes, the log's last first, and the bytes of the whole log. A log that does not exist
    is empty; files whose names begin with a dot or an underscore are none of it."""
    from pyarrow import fs

    store, root = _store(path)
    one = store.get_file_info(root)
    if one.type == fs.FileType.NotFound:
        return [], 0
    found = [one] if one.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    files = sorted(((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._"), reverse=True)
    out, left = [], window
    for file, size in files:
        low = max(0, size - left)
        for end in range(size, low, -RANGE):
            out.append(Range(file, max(low, end - RANGE), end, True))
        left -= size - low
        if left <= 0:
            break
    return out, sum(size for _, size in files)


class LogTail(DataSource):
    """Lines of the last bytes of a log: options ``path`` and ``window``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["window"]))


class _Reader(DataSourceReader):
    def __init__(self, path: str, window: int):
        self.path, self.window = path, window

    def partitions(self) -> list[Range]:
        return planned(self.path, self.window)[0] or [Range("", 0, 0, False)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            f.seek(part.start - 1 if part.start else 0)
            data = f.read(part.end - f.tell())
            at = part.start - 1 if part.start else 0
            if part.start:
                cut = data.find(b"\n")
                if cut < 0:
                    return  # the line that lies here began before
                data, at = data[cut + 1 :], at + cut + 1
            while data and not data.endswith(b"\n"):  # what begins here is read to its end
                more = f.read(FIRST)
                if not more:
                    break
                end = more.find(b"\n")
                data += more if end < 0 else more[: end + 1]
        for line in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
            if line.strip():
                yield part.file, at, part.end - part.start, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1


def window_lines(spark: SparkSession, path: str, window: int) -> DataFrame:
    """file, start (the place of a line in it), bytes (of the range it was read with), line: whole lines of the last ``window`` bytes."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("path", path).option("window", window).load()


def window_events(spark: SparkSession, path: str, window: int) -> DataFrame:
    """The events among them, those with an integrity block, and whether the window reaches back to the log's begin. Torn
    lines are passed over."""
    whole = planned(path, 0)[1] <= window
    one = F.from_json("line", f"{EVENT}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = window_lines(spark, path, window).select("file", "start", one.alias("r")).where("r._corrupt IS NULL AND r.audit_integrity IS NOT NULL")
    return rows.select("file", "start", "r.*").drop("_corrupt").withColumn("covered_from_start", F.lit(whole))


def last_events(spark: SparkSession, path: str, last: int, first_window: int = FIRST) -> DataFrame:
    """The last ``last`` events of a log, in whichever of its files they are; fewer if there are no more."""
    window, whole = first_window, planned(path, 0)[1]
    while window < whole and window_events(spark, path, window).count() < last:
        window *= 2
    found = window_events(spark, path, window)
    kept = found.orderBy(F.desc("file"), F.desc("start")).limit(last)
    # the rows asked for are a page, and the log's begin is covered if nothing before them was left out
    n = found.count() if window >= whole else last + 1
    return kept.withColumn("covered_from_start", F.lit(n <= last))
