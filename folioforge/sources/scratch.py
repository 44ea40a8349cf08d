"""Tables in between, in the folder that the cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` at which nothing exists yet.

    Without that setting a local folder serves where everything runs in one
    process; on a cluster it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/folioforge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: computed once,
    and a lost executor costs the rereading of files."""
    path = new_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
