"""What loops over tables share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share. Where none is set, a new local one in local mode, an error on a cluster."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tideglass-")
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder of checkpoints and read back.

    Like checkpoint(), it cuts the lineage and survives lost executors; but what is read has the size of its files, where
    a checkpoint keeps the estimate of its plan, and estimates multiply from round to round until they fill the driver.
    """
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
