"""Written tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. It may be unset only in local mode, where the driver runs all tasks and a folder of its own serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return os.path.join(tempfile.gettempdir(), f"spark-shared-{spark.sparkContext.applicationId}")
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again, which cuts the lineage; lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
