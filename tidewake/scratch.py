"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where it is unset, a folder of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-tidewake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts lineage, and is not recomputed."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has left in the shared folder; DataFrames that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that are broadcast at most on our word.
SMALL = 10_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, marked for broadcast if it has ``most`` rows or fewer; otherwise Spark decides how to join it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
