"""Written intermediate tables for plans that read one result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A local session without the setting gets a temporary folder of its own; on
    a cluster the setting must be there, since executors have to see the files.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get(_SETTING, None)
        or context.getConf().get(_SETTING)
        or context.getCheckpointDir()
    )
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tamarisk/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    true size of the table instead of a product of estimates.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
