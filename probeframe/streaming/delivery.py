"""Batching, overflow and failure rules of delivery."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame


_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class QueueConfig:
    """When a batch may be taken and how large it may be; 0 turns a rule off. Contradictions raise ValueError."""

    min_items: int = 1
    min_bytes: int = 0
    linger_s: float = 0.0
    max_items: int = 0
    max_bytes: int = 0
    high_items: int = 0
    high_bytes: int = 0

    def __post_init__(self):
        if min(self.min_items, self.min_bytes, self.max_items, self.max_bytes, self.high_items, self.high_bytes) < 0 or self.linger_s < 0:
            raise ValueError("limits are not negative")
        if not (self.min_items or self.min_bytes or self.linger_s):
            raise ValueError("a trigger is needed")
        for low, high, name in ((self.min_items, self.max_items, "max_items"), (self.min_bytes, self.max_bytes, "max_bytes"), (self.min_items, self.high_items, "high_items"), (self.min_bytes, self.high_bytes, "high_bytes")):
            if high and low > high:
                raise ValueError(f"{name} is below the minimum")

    def may_dequeue(self, items: int, size: int, oldest_age_s: float, closed: bool) -> bool:
        if items == 0:
            return False
        full = (self.high_items and items >= self.high_items) or (self.high_bytes and size >= self.high_bytes)
        due = (self.min_items and items >= self.min_items) or (self.min_bytes and size >= self.min_bytes) or (self.linger_s and oldest_age_s >= self.linger_s)
        return bool(closed or full or due)


def should_flush(items: int, size: int, age_s: float, *, max_items: int = 0, max_bytes: int = 0, ratio: float = 0.0, capacity: int = 0, timeout_s: float = 0.0) -> bool:
    """Any rule that is on and reached; a full ring always flushes."""
    rules = [max_items and items >= max_items, max_bytes and size >= max_bytes, ratio and capacity and size >= ratio * capacity, timeout_s and items and age_s >= timeout_s, capacity and size >= capacity]
    return any(rules)


def greedy_batches(rows: DataFrame, max_items: int, max_bytes: int, queue: str = "queue", seq: str = "seq", size: str = "bytes") -> DataFrame:
    """(queue, seq, bytes, batch): first come, first served until a limit is reached. What a batch holds depends on all before it, so
    rows are streamed in order with the running batch as the only state, whatever the length of a queue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, items, total = None, 0, 0, 0
        for f in frames:
            out = []
            for q, n in zip(f[queue], f[size], strict=True):
                if q != key:
                    key, batch, items, total = q, 0, 0, 0
                elif items >= max_items or total + n > max_bytes:
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + n
                out.append(batch)
            yield f.assign(batch=out)

    kept = rows.select(queue, seq, size)
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", batch long"
    return kept.repartition(queue).sortWithinPartitions(queue, seq).mapInPandas(run, schema)


def flush_groups(rows: DataFrame, queue: str = "queue", seq: str = "seq", size: str = "bytes", at: str = "at", **rules) -> DataFrame:
    """(queue, seq, size, at, batch): after each arrival the rules of should_flush decide whether what is held goes out; ``at`` is the
    time of arrival and the age that of the oldest item held. What is held depends on all arrivals before, so rows of a queue are
    streamed in order with three numbers as the only state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, items, total, oldest = None, 0, 0, 0, 0
        for f in frames:
            out = []
            for q, n, t in zip(f[queue], f[size], f[at], strict=True):
                if q != key:
                    key, batch, items, total = q, 0, 0, 0
                oldest = t if items == 0 else oldest
                items, total = items + 1, total + n
                out.append(batch)
                if should_flush(items, total, t - oldest, **rules):
                    batch, items, total = batch + 1, 0, 0
            yield f.assign(batch=out)

    kept = rows.select(queue, seq, size, at)
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", batch long"
    return kept.repartition(queue).sortWithinPartitions(queue, seq).mapInPandas(run, schema)


def longest_prefix(sizes: list[int], room: int) -> int:
    """How many items from the front fit into a staging area; one that is larger than the room on its own stops the rest."""
    total = 0
    for n, size in enumerate(sizes):
        total += size
        if total > room:
            return n
    return len(sizes)


class OnFull(Enum):
    RAISE = "raise"
    DROP = "drop"
    RETRY = "retry"
    ABORT = "abort"


class Aborted(RuntimeError):
    pass


class DeliverySink:
    """A foreachBatch function that applies an overflow policy to a write; counts what is dropped.

    A batch that this sink has written is not written again. A restarted driver forgets what was written, so ``write`` should be
    repeatable by batch id (for instance overwrite a folder named after it).
    """

    def __init__(self, write: Callable[[DataFrame, int], None], on_full: OnFull = OnFull.RAISE, max_retries: int = 3, backoff_s: float = 0.0):
        self.write, self.on_full, self.max_retries, self.backoff_s = write, on_full, max_retries, backoff_s
        self.dropped, self.failures, self.done = 0, [], set()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.done:
            return
        for attempt in range(1 + (self.max_retries if self.on_full is OnFull.RETRY else 0)):
            try:
                self.write(batch, batch_id)
                self.done.add(batch_id)
                return
            except Exception as e:
                self.failures.append(e)
                if self.on_full is OnFull.DROP:
                    rows = batch.count()
                    self.dropped += rows
                    _log.warning("batch %s of %s rows is dropped: %s", batch_id, rows, e)
                    return
                if self.on_full is OnFull.ABORT:
                    raise Aborted(str(e)) from e
                if self.on_full is OnFull.RETRY and attempt < self.max_retries:
                    time.sleep(self.backoff_s)
                    continue
                raise

    def raise_if_failed(self) -> None:
        if self.failures:
            raise self.failures[0]
