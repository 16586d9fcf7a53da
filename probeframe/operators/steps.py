"""Steps to token ranges: group ids, end-of-sequence latches, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_ids(steps: DataFrame, engine: str = "engine", step: str = "step") -> DataFrame:
    """Adds ``grp`` (from 0): a new group at a prefill or where the batch size changes. One window by engine."""
    w = Window.partitionBy(engine).orderBy(step)
    first = F.col("prefill") | F.coalesce(F.col("batch") != F.lag("batch").over(w), F.lit(True))
    return steps.withColumn("__new", first.cast("long")).withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def latched(steps: DataFrame, eos: list[int], by: list[str], step: str = "step", strip: bool = True) -> DataFrame:
    """Adds ``finished``: at a decode step whose fed token ends the sequence, and from there on in the group."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.lit(False) if not strip or not eos else (~F.col("prefill")) & F.col("fed_token").isin(*eos)
    return steps.withColumn("finished", F.coalesce(F.max(ends).over(w), F.lit(False)))


def real_lengths(steps: DataFrame, strip_left: bool = True) -> DataFrame:
    """``real_len`` of a prefill: what its mask counts, or the mask's whole ``width`` where left padding is kept."""
    return steps if strip_left else steps.withColumn("real_len", F.when(F.col("prefill"), F.col("width")).otherwise(F.col("real_len")))


def token_ranges(steps: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Adds half-open ``range_start`` and ``range_end``: each step goes on where the one before ended; finished steps are empty."""
    n = F.when(F.col("finished"), 0).when(F.col("prefill"), F.col("real_len")).otherwise(1)
    w = Window.partitionBy(*by).orderBy(step)
    end = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("__n", n.cast("long")).withColumn("range_end", end).withColumn("range_start", F.col("range_end") - F.col("__n")).drop("__n")


def exclusive_sum(value: str, by: list[str], order: list) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def coverage(ranges: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key: whether its ranges start at 0 and each starts where the one before ended."""
    w = Window.partitionBy(*by).orderBy("range_start", "range_end")
    broken = F.col("range_start") != F.coalesce(F.lag("range_end").over(w), F.lit(0))
    marked = ranges.withColumn("__gap", broken.cast("long"))
    return marked.groupBy(*by).agg(F.sum("__gap").alias("gaps"), F.max("range_end").cast("long").alias("last_end"), F.count("*").alias("chunks")).withColumn("contiguous", F.col("gaps") == 0)


def reservation_class(planned: Column, hooks: Column, free: Column, capacity: int) -> Column:
    """Outcome of one step against the ring: -1 nothing planned, 0 fits, 1 fits after a flush, 2 larger than the ring."""
    return F.when((hooks == 0) | (planned == 0), -1).when(planned > capacity, 2).when(planned <= free, 0).otherwise(1)


def reservations(steps: DataFrame, capacity: int, engine: str = "engine", step: str = "step") -> DataFrame:
    """Adds ``outcome`` and ``level``: the ring's fill is carried from step to step; a flush empties it. What a step meets depends on
    all steps before it, so rows of an engine are streamed in order with the level as the only state. steps: planned, hooks."""

    def run(frames):
        key, level = None, 0
        for f in frames:
            outcomes, levels = [], []
            for e, planned, hooks in zip(f[engine], f["planned"], f["hooks"], strict=True):
                if e != key:
                    key, level = e, 0
                if not hooks or not planned:
                    outcome = -1
                elif planned > capacity:
                    outcome = 2
                elif planned <= capacity - level:
                    outcome, level = 0, level + planned
                else:
                    outcome, level = 1, planned
                outcomes.append(outcome)
                levels.append(level)
            yield f.assign(outcome=outcomes, level=levels)

    kept = steps.select(engine, step, "planned", "hooks")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", outcome int, level long"
    return kept.repartition(engine).sortWithinPartitions(engine, step).mapInPandas(run, schema)
