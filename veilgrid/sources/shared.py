"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may lack it, and gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veilgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table there, which a lost executor does not take along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over four tasks for each core, for work that costs far more than moving its rows: narrow tables are read
    by a task or two otherwise, however many rows their few row groups have."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def erase(spark: SparkSession, path: str) -> None:
    """Deletes a path, through the file system that Spark itself uses."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def erase_table(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        erase(df.sparkSession, d)
