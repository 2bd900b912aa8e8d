"""Token-id output: Parquet files with list columns, and selective reads of them.

Ids are written as ``array<int>`` in dictionary encoding (a vocabulary fits one dictionary page, so an id takes about 16
bits), ids of rows in delta encoding, with row groups and pages of a set size and with page indexes, so that a reader of
some documents or of the metadata alone touches only their pages. Files hold documents in ascending doc_id order.

Cases: a null text counts as empty and gives the end id alone; null doc_ids come first; rows with equal doc_ids are kept,
each with a place of its own; an empty table gives an empty file; very long texts are encoded whole, piece by
piece, and their ids are one row; other columns of the input are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrid.llm.chunks import encoder

#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Distinct pieces of texts that a worker remembers.
PIECES = 1_200_000
_WRITTEN = "doc_id long, row long, n_tokens int, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, shard, row, n_tokens, ids of all documents; shards are ranges of doc_id, row counts within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, row = encoder(tokenizer_path, PIECES).encode, int(end_id).to_bytes(4, "little"), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [x + end for x in encode(part.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in found], dtype=np.int32)
                flat = np.frombuffer(b"".join(found), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + len(n))), pa.array(n), ids], ["doc_id", "row", "n_tokens", "ids"]
                )
                row += len(n)

    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").repartitionByRange("doc_id")
    return dealt.sortWithinPartitions("doc_id").mapInArrow(run, _WRITTEN).withColumn("shard", F.spark_partition_id())


def write_tokens(encoded: DataFrame, path: str) -> None:
    """Writes the files; the settings are those of Parquet's own writer."""
    (
        encoded.write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#row", "false")
        .option("compression", "snappy")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files, or some columns of them: filters on doc_id or n_tokens and the choice of columns reach the scan."""
    df = spark.read.schema(f"{_WRITTEN}, shard int").parquet(path)
    return df.select(*columns) if columns else df


def positions(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back: the ids themselves are counted and summed. start adds
    what the shards before hold, one number a shard, to what the shard holds before the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "row", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "shard", "row", "ids").mapInArrow(run, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    within = rows.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row")) - F.col("n_tokens"))
    totals = tokens.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    first = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("first"))
    # one row a shard: a few bytes for what a task writes
    return within.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
