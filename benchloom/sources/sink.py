"""Sinks that a batch reaches once: staged beside the table, then published by one rename, keyed by the batch.

Tasks write below `_staging`, which readers never look into; when all of them are done, the batch's folder is
renamed to `batch=KEY`, which either happens or does not. A batch that was killed leaves only staging
behind; one that is repeated, also at the same time elsewhere, finds its key taken and changes nothing. So
nothing that is there has to be read to write more.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING = "_staging"


def _paths(spark: SparkSession, *paths: str):
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), made


def published(spark: SparkSession, root: str, batch: str) -> bool:
    fs, (path,) = _paths(spark, f"{root}/batch={batch}")
    return fs.exists(path)


def publish(df: DataFrame, root: str, batch: str, kind: str = "parquet") -> bool:
    """Adds df to the table at root as this batch; False, and nothing done, if the batch is there already."""
    spark = df.sparkSession
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a batch key: {batch!r}")
    if published(spark, root, batch):
        return False
    stage = f"{root}/{STAGING}/{batch}-{uuid.uuid4().hex}"
    options = {"ignoreNullFields": "false"} if kind == "json" else {}
    df.write.format(kind).options(**options).save(stage)
    fs, (source, target) = _paths(spark, stage, f"{root}/batch={batch}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    try:  # unlike FileSystem's, this rename never moves a folder into one that is there
        context.rename(fs.makeQualified(source), fs.makeQualified(target), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(source, True)
        return False
    return True


def read(spark: SparkSession, root: str, schema: str, kind: str = "parquet") -> DataFrame:
    """All published rows, with their batch."""
    return spark.read.schema(f"{schema}, batch string").format(kind).load(root)


def clear_staging(spark: SparkSession, root: str) -> None:
    """What killed batches have left; only while nobody is writing."""
    fs, (path,) = _paths(spark, f"{root}/{STAGING}")
    fs.delete(path, True)


def stream_into(stream: DataFrame, root: str, checkpoint: str, make=lambda batch: batch, kind: str = "parquet"):
    """A streaming writer whose batches are published once each; make: what a batch becomes before it is written.

    The key is the stream's id, which its checkpoint keeps, and the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        if not published(spark, root, key):
            publish(make(batch), root, key, kind)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def append_log(df: DataFrame, root: str, batch: str, **columns) -> bool:
    """A log's rows (prompts and outputs, metrics) of one step, with columns of fixed values; a repeated step changes nothing."""
    return publish(df.withColumns({k: F.lit(v) for k, v in columns.items()}), root, batch)
