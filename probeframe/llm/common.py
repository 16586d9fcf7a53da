"""Scratch tables in the shared folder, size-checked joins and connected components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import clear_scratch, scratch, shared_folder

__all__ = ["BROADCAST_IDS", "bounded_batches", "clear_scratch", "components", "only_listed", "release", "released", "rest", "saved", "scratch", "shared_folder", "ship_package"]

#: Rows up to which a list of ids may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor never recomputes what is above this cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rest(spark: SparkSession) -> None:
    """Before a stage that reads what the last one has written: the driver's heap is collected. What no plan refers to any more -
    plans themselves, broadcast tables, shuffles - goes, and the heap shrinks instead of growing from stage to stage."""
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """After large work in Python: what Arrow and the C library keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run):
    """run for mapInArrow, after which its worker gives freed memory back: workers wait beside the executor's later, native stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_probeframe_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="probeframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/probeframe.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(f"{folder}/probeframe.zip")
    context._probeframe_sent = True


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Before Python work: keep what one Arrow batch brings to a worker small, also where texts are long.

    Plans are made when results are asked for, so the two limits stay with the session; they only bound memory, change no result,
    and are never raised above what others have set."""
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most or now == _limits.get(name):
            spark.conf.set(name, str(most))
            _limits[name] = str(most)


#: The limits that bounded_batches itself has set last.
_limits: dict[str, str] = {}


def only_listed(big: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of big whose key is in ids (distinct, saved). The list is broadcast only if it has at most limit rows."""
    listed = F.broadcast(ids) if ids.count() <= limit else ids.hint("merge")
    return big.join(listed, key, "left_semi")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; every round is a pre-aggregated minimum and one join, cut by a
    written table, and their number grows with the logarithm of the longest path.
    """
    cur = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(60):
        roots = cur.select(F.col("v").alias("node")).distinct()
        # settled: every node points to one root, and no root points on
        ends = cur.select("u", F.lit(1).alias("n")).union(roots.select("node", F.lit(1))).groupBy("u").agg(F.sum("n").alias("n"))
        if not ends.where("n > 1").take(1):
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
