"""Tables that operators write between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder, on a
    cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has used; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends there."""
    path = fresh(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
