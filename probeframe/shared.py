"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one if the master is local; on a cluster that raises, since
    executors do not see each other's temporary folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="probeframe-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{shared_folder(spark)}/probeframe/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with ``name``: their place in the order, from 0. Rows are sorted over all partitions and written, and a place is that within
    the partition plus the rows of all partitions before it; only a row for each partition meets in one task."""
    path = scratch(rows.sparkSession, "numbered")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", inside).write.parquet(path)
    back = rows.sparkSession.read.parquet(path)
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = back.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(before, F.lit(0)).alias("__s"))
    return back.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a path of any store that Spark reads; False if there was none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> int:
    """Removes every scratch path made by this driver, once its results have been written elsewhere; how many there were."""
    n = sum(delete(spark, p) for p in _made)
    _made.clear()
    return n
