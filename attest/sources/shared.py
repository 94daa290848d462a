"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse; a temporary folder only where all of Spark runs on this machine.
    A warehouse on a local disk is an error elsewhere: executors would write what nobody else reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="attest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith(("file:", "/")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {folder} is local to each machine")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write the rows and read them back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attest-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
