"""Tables of tokens: the vault's, and the callers'. One that does not exist is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrid.operators.vault import RECORD
from veilgrid.sources.logs import exists
from veilgrid.sources.versioned import VersionedTable

CALLERS = "token_hash string, id string, type string, scopes array<string>, labels map<string,string>, disabled boolean, position long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if exists(spark, f"{path}/versions"):
        return VersionedTable(spark, path, schema).read()
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def vault_table(spark: SparkSession, path: str) -> DataFrame:
    """The records of a vault, by their schema; columns that a file lacks are null."""
    return _table(spark, path, RECORD)


def caller_table(spark: SparkSession, path: str) -> DataFrame:
    """The records of callers' tokens, by their schema."""
    return _table(spark, path, CALLERS)
