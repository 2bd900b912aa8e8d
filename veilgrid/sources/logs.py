"""Sources and sinks of texts and logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.operators.events import EVENT
from veilgrid.sources.versioned import VersionedTable

CORPUS = "text string, direction string, note string, expect array<struct<type:string,present:boolean,gap:boolean>>"
ANCHOR = "sequence bigint, event_hash string, timestamp string"


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, payload: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line: lines that are not blank."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")


def event_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Events by the log's schema, which never is inferred. Lines that are no events fail a strict read and are passed
    over else; a log that does not exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT)
    if strict:
        return spark.read.schema(EVENT).json(path, mode="FAILFAST")
    return _parsed(spark, path, EVENT)


def tail(events: DataFrame, last: int) -> DataFrame:
    """The last records by sequence, those with an integrity block, and whether they reach back to the first."""
    rows = events.where(F.col("audit_integrity.sequence").isNotNull())
    top = rows.agg(F.max("audit_integrity.sequence").alias("_top"))
    kept = rows.join(F.broadcast(top)).where(F.col("audit_integrity.sequence") > F.col("_top") - last)
    return kept.withColumn("covered_from_start", F.col("_top") <= last).drop("_top")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchors; lines that are none are passed over, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], ANCHOR)
    return _parsed(spark, path, ANCHOR).where("sequence is not null and event_hash is not null")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are none are passed over."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    one = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.select(one.alias("r")).where(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON file: a list of objects."""
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_lines(rows: DataFrame, path: str, line: str = "line") -> None:
    """Appends lines as text files; Spark's commit protocol takes the place of a lock."""
    rows.select(line).write.mode("append").text(path)


def replace_table(rows: DataFrame, path: str) -> VersionedTable:
    """Puts a table in the place of the one at ``path``: the next version of it, so there is no moment without a table."""
    table = VersionedTable(rows.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes))
    table.replace(rows)
    return table


CHAINED = "writer string, sequence long, line string"


def chained_log(spark: SparkSession, path: str) -> VersionedTable:
    """A log of chains, one for each writer, with numbered versions."""
    return VersionedTable(spark, path, CHAINED)


def append_chained(spark: SparkSession, batch: DataFrame, path: str, writer: str = "0", record: str = "record", position: str = "position", batch_id: int | None = None) -> int:
    """Appends records as the next ones of a writer's chain, for use in foreachBatch: a batch that comes again, by its
    number, appends nothing, and of two that come at once each follows the other. The chain's last block stands in the
    table's manifest, so no log is read; the batch is chained by one task, through which its rows stream in order. Gives the
    number of the last record."""
    from veilgrid.operators.events import chain_after

    table = chained_log(spark, path)

    def rows_after(note: dict | None):
        rows = chain_after(batch.select(F.col(position).alias("_p"), F.col(record).alias("line")), note, {"writer": writer})
        last = lambda done: done.agg(F.max_by("line", "sequence")).first()[0]
        note_of = lambda done: (lambda line: json.loads(line)["auditIntegrity"] if line else None)(last(done))
        return rows.withColumn("writer", F.lit(writer)).select("writer", "sequence", "line"), note_of

    table.append_after(rows_after, writer, batch_id)
    return (table.head().notes.get(writer) or {}).get("sequence", 0)
