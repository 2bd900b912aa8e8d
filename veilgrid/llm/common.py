"""Shared helpers: the shared folder, written intermediate tables, a bounded labelled sample."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a local session, whose executors are
    threads of the driver, gets a temporary folder where it is unset; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veilgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, through the file system that Spark itself uses."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def erase_table(df: DataFrame) -> None:
    """Deletes what :func:`written` wrote for ``df``, once nothing reads it any more."""
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        erase(df.sparkSession, d)


#: What worker processes remember from row to row, by operator: something to empty it with. Workers are used again for
#: other operators, and together these would fill an executor's memory.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the system, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def remembering(name: str, empty: Callable[[], None]) -> None:
    """Called by a task that begins: what other operators' tasks have remembered in this worker goes."""
    for other in [n for n in _REMEMBERED if n != name]:
        _REMEMBERED.pop(other)()
    if name not in _REMEMBERED:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim()
    _REMEMBERED[name] = empty


class Known(dict):
    """What is known by key; what a key has that is not known yet comes from ``find``."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        self[key] = found = self.find(key)
        return found


def id_crc(id_col: str | Column) -> Column:
    """crc32 of the id's decimal text, the fold of a row."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"))


def fold(doc_id: int) -> int:
    """The same crc32 on the driver."""
    return zlib.crc32(str(doc_id).encode())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_docs: int) -> list[tuple[int, str, int]]:
    """At most ``max_docs`` labelled rows that satisfy ``keep``, chosen by a hash of the id over all labels, with their
    texts. The bound is the only limit; the rows are for fitting a model alone. Of several labels of an id the largest
    counts, of several texts the first in the order of their bytes; ids without a label, or without a text, are left out."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
        .collect()
    )
    if not picked:
        return []
    by_id = {r.doc_id: r.label for r in picked}
    # the ids are at most max_docs, so this broadcast has a fixed bound
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(by_id)], "doc_id long")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
    seen: dict[int, str] = {}
    for r in rows.toLocalIterator():
        seen[r.doc_id] = min(r.text, seen.get(r.doc_id, r.text), key=str.encode)
    return [(i, seen[i], by_id[i]) for i in sorted(seen)]
