"""How an engine plugs in: an adapter names the model, the ranks and the steps; planning and reservation are the library's."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalog, shapes
from .operators import steps as rules
from .schema import hook_defs


class CaptureAdapter(ABC):
    """Six methods to implement, three to override; ``plan`` chains selection, ownership, shapes, bytes and ring reservations."""

    capacity = 1 << 30
    element_bytes = 2

    @abstractmethod
    def model_shape(self) -> dict:
        """The model's sizes, as shapes.hook_shape takes them."""

    @abstractmethod
    def ranks(self) -> tuple[int, int, int, int]:
        """(tensor, data, expert, pipeline) rank."""

    @abstractmethod
    def is_first_stage(self) -> bool:
        """Whether this pipeline rank holds the first layers."""

    @abstractmethod
    def is_last_stage(self) -> bool:
        """Whether this pipeline rank holds the last layers."""

    @abstractmethod
    def steps(self, spark: SparkSession) -> DataFrame:
        """engine, step, batch, q, kv, keep, packed: one row for each forward pass that is captured."""

    @abstractmethod
    def on_capacity_exceeded(self, steps: DataFrame) -> None:
        """Told about steps that are larger than the ring."""

    def adapt_oversized(self, steps: DataFrame) -> DataFrame:
        """What is captured of steps that are larger than the ring; all of it, unless overridden."""
        return steps

    def warn(self, message: str) -> None:
        warnings.warn(message, stacklevel=3)

    def needs_eager(self, specs: DataFrame) -> Column:
        """Which hooks keep a step out of compiled graphs; none, unless overridden."""
        return F.lit(False)

    def specs(self, spark: SparkSession, selection: str = "full", config: dict | None = None) -> DataFrame:
        """The catalog's rows that are selected and owned by this rank, with ``eager``. Selected but unavailable hooks are warned of."""
        chosen = catalog.apply_hook_selection(hook_defs(spark), selection, config, "id")
        for r in chosen.where("unavailable").select("short_name").collect():  # of 23 rows at most
            self.warn(f"hook {r.short_name} is not available")
        owned = chosen.where("enabled").where(catalog.belongs_to_pp_rank(self.is_first_stage(), self.is_last_stage()))
        owned = owned.where(catalog.belongs_to_tp_rank(self.ranks()[0]))
        return owned.withColumn("eager", self.needs_eager(owned))

    def plan(self, spark: SparkSession, selection: str = "full", config: dict | None = None) -> DataFrame:
        """(engine, step, planned, hooks, eager): bytes and number of non-empty tensors of each step."""
        both = self.steps(spark).crossJoin(F.broadcast(self.specs(spark, selection, config).select("shape_class", "eager")))
        shape = shapes.hook_shape(F.col("shape_class"), self.model_shape(), F.col("batch"), F.col("q"), F.col("kv"), F.col("keep"), F.col("packed"))
        n = both.select("engine", "step", "eager", shapes.elements(shape).alias("n")).where("n > 0")
        size = F.sum(shapes.align_up(F.col("n") * self.element_bytes, 16)).cast("long")
        return n.groupBy("engine", "step").agg(size.alias("planned"), F.count("*").alias("hooks"), F.bool_or("eager").alias("eager"))

    def reserve(self, plan: DataFrame) -> DataFrame:
        """Outcome, ring level and way of each planned step: through the ring, after a flush, or directly (unstripped) where it is
        larger than the ring; the adapter is told about the last."""
        way = F.when(F.col("outcome") == 0, "ring").when(F.col("outcome") == 1, "flush").when(F.col("outcome") == 2, "direct")
        out = rules.reservations(plan, self.capacity).withColumn("way", way)
        large = out.where("outcome = 2")
        if large.take(1):
            self.on_capacity_exceeded(large)
        return out
