"""Reports over runs: statistics by mode, kernel and copy breakdowns, rates, profiles, resource series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows up to which each row looks its one up by binary search in a broadcast table; with more, both sides are joined by bucket.
FEW_WINDOWS = 10_000


def in_windows(rows: DataFrame, windows: DataFrame, at: str = "start", lo: str = "lo", hi: str = "hi", width: int = 1 << 20) -> DataFrame:
    """Rows whose ``at`` lies in any window [lo, hi], ends included."""
    if windows.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        # a row lies in a window if the furthest end of all windows that have begun is not before it
        furthest = F.max(hi).over(Window.orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0))
        table = windows.select(F.col(lo).alias("a"), furthest.alias("z")).agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("__w"))
        steps = F.array(*[F.lit(1 << k) for k in range(FEW_WINDOWS.bit_length() - 1, -1, -1)])
        begun = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= F.size("__w")) & (F.try_element_at("__w", i + s)["a"] <= F.col(at)), i + s).otherwise(i))
        found = rows.crossJoin(F.broadcast(table)).withColumn("__i", begun)
        return found.where((F.col("__i") > 0) & (F.try_element_at("__w", F.greatest(F.col("__i"), F.lit(1)))["z"] >= F.col(at))).drop("__w", "__i")
    cut = windows.select(lo, hi, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("__b"))
    return rows.join(cut, (F.floor(F.col(at) / width) == F.col("__b")) & F.col(at).between(F.col(lo), F.col(hi)), "left_semi")


def mode_statistics(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return runs.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n"))


def rate(amount: Column, seconds: Column) -> Column:
    """amount by second; null where no time passed."""
    return F.when(seconds > 0, amount / seconds)


def kernel_breakdown(kernels: DataFrame, windows: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` kernels by time within windows, with their share of all time there (a report of fixed length)."""
    by = in_windows(kernels, windows).groupBy("name").agg(F.sum("duration").alias("total"), F.count("*").alias("calls"))
    total = F.sum("total").over(Window.partitionBy())
    return by.withColumn("share", F.round(100.0 * F.col("total") / total, 9)).orderBy(F.desc("total"), "name").limit(top)


def memcpy_breakdown(copies: DataFrame) -> DataFrame:
    ns = F.greatest(F.sum("duration"), F.lit(1))
    return copies.groupBy("kind").agg(F.sum("duration").alias("total_ns"), F.count("*").alias("ops"), F.round(F.sum("bytes") / 1e6, 9).alias("mb"), F.round(F.sum("bytes") / ns, 9).alias("gb_per_s"))


def overhead(stats: DataFrame, baseline: str) -> DataFrame:
    """Each mode's mean against the baseline's, in per cent."""
    base = F.broadcast(stats.where(F.col("mode") == baseline).select(F.col("mean").alias("base")).limit(1))
    return stats.crossJoin(base).select("mode", "mean", F.round(100 * (F.col("mean") - F.col("base")) / F.col("base"), 9).alias("overhead_pct"))
