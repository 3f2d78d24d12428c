"""Session settings the operators rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Fact tables are joined to lookup tables on keys that can hold a third of all rows; the skew-join rule splits
    # the hot partition of the fact side, also where that costs one more shuffle behind the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a running session; cluster sizing stays with the caller."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # Driver and executors are one process here, so a folder of this machine is shared by all of them.
        root = tempfile.mkdtemp(prefix="turnwise-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{_shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that a later round has replaced; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
