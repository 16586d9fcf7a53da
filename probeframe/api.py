"""Reading captures by field: lazy fields of one run, requirements and retries, and the places where own code plugs in."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import CaptureAdapter
from .functions.catalog import BY_SHORT, is_preset_registered, natural_key, register_preset, resolve_hook_selection
from .operators import reassemble
from .schema import FIELDS, HOOKS, stored_name
from .sources.codec import token_rows
from .sources.store import CaptureStore, custom_select, names_matching, prefix_get
from .streaming.delivery import DeliverySink, OnFull, QueueConfig
from .streaming.engine import BatchQueue, Engine, OnFailure, Stage

#: Raised where a public name goes or changes its meaning.
API_VERSION = 1

__all__ = [
    "API_VERSION", "BatchQueue", "CaptureAdapter", "CaptureStore", "DeliverySink", "Engine", "HookSet", "IncompleteInternalError", "LazyInternal", "MissingInternalError", "OnFailure", "OnFull",
    "QueueConfig", "Requirement", "Stage", "StepSource", "apply_hook", "custom_select", "get_internal", "is_preset_registered", "make_lazy_internal", "names_matching", "prefix_get", "register_field",
    "register_preset", "resolve_eos", "resolve_hook_selection", "store_reader", "token_rows",
]


class MissingInternalError(LookupError):
    """The field has no rows."""


class IncompleteInternalError(LookupError):
    """The field has rows, but not all that are required."""


def _per_layer(tokens: DataFrame) -> DataFrame:
    return reassemble.left_padded(tokens, ["layer_no", "request_id"], ["layer_no"])


def _global(tokens: DataFrame) -> DataFrame:
    return reassemble.left_padded(tokens, ["request_id"], [])


_BY_SHORT = {r[2]: r for r in HOOKS}
#: field -> (stored act_name, tokens -> DataFrame)
_fields: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {f: (stored_name(_BY_SHORT[s][1], _BY_SHORT[s][3]), _per_layer if _BY_SHORT[s][3] else _global) for f, s in FIELDS.items()}


def register_field(name: str, act_name: str, reassembler: Callable[[DataFrame], DataFrame]) -> None:
    """A field of one's own: token rows of act_name through a function. A name that is taken raises ValueError."""
    if name in _fields or name == "token_mask":
        raise ValueError(f"field {name!r} is registered")
    _fields[name] = (act_name, reassembler)


def apply_hook(tokens: DataFrame, act_name: str, fn: Callable) -> DataFrame:
    """A forward callback on one act: fn maps the values column to a new column; rows of other acts stay as they are."""
    return tokens.withColumn("values", F.when(F.col("act_name") == act_name, fn(F.col("values"))).otherwise(F.col("values")))


@dataclass
class _Hook:
    names: frozenset[str]
    fn: Callable
    direction: str
    permanent: bool
    level: int | None


class HookSet:
    """Callbacks on token rows: fn(values, act_name) -> values, as columns, for the acts that a name, a pattern or a predicate picks.

    Hooks run in the order they were added, prepended ones first. Those that belong to a ``hooks`` block have its level and go with
    it; permanent ones stay until they are reset by name. Backward hooks see gradient rows only, through apply(rows, "bwd").
    """

    def __init__(self):
        self._hooks: list[_Hook] = []
        self._depth = 0

    def add_hook(self, name: str | Callable[[str], bool], hook: Callable, dir: str = "fwd", is_permanent: bool = False, level: int | None = None, prepend: bool = False) -> int:
        """How many acts of the catalog the hook is on; none raises ValueError."""
        if dir not in ("fwd", "bwd"):
            raise ValueError(f"no such direction: {dir!r}")
        names = frozenset(names_matching(name)) or (frozenset([name]) & frozenset(a for a, _ in _fields.values()) if isinstance(name, str) else frozenset())
        if not names:
            raise ValueError(f"no act is picked by {name!r}")
        new = _Hook(names, hook, dir, is_permanent, level)
        self._hooks.insert(0, new) if prepend else self._hooks.append(new)
        return len(names)

    def reset(self, direction: str = "both", including_permanent: bool = False, level: int | None = None) -> None:
        def goes(h: _Hook) -> bool:
            return direction in ("both", h.direction) and (including_permanent or not h.permanent) and (level is None or h.level == level)

        self._hooks = [h for h in self._hooks if not goes(h)]

    def apply(self, tokens: DataFrame, direction: str = "fwd") -> DataFrame:
        """Rows with every hook of the direction applied, in order; one projection, no shuffle."""
        for h in self._hooks:
            if h.direction == direction:
                on = F.col("act_name").isin(*sorted(h.names))
                tokens = tokens.withColumn("values", F.when(on, h.fn(F.col("values"), F.col("act_name"))).otherwise(F.col("values")))
        return tokens

    @contextmanager
    def hooks(self, fwd_hooks: list[tuple] = (), bwd_hooks: list[tuple] = (), reset_hooks_end: bool = True):
        """Adds (name, fn) pairs for the time of a block."""
        self._depth += 1
        level = self._depth
        try:
            for direction, pairs in (("fwd", fwd_hooks), ("bwd", bwd_hooks)):
                for name, fn in pairs:
                    self.add_hook(name, fn, direction, level=level)
            yield self
        finally:
            if reset_hooks_end:
                self.reset(level=level)
            self._depth -= 1

    def run_with_hooks(self, tokens: DataFrame, fwd_hooks: list[tuple] = (), reset_hooks_end: bool = True) -> DataFrame:
        with self.hooks(fwd_hooks, reset_hooks_end=reset_hooks_end):
            return self.apply(tokens)


def store_reader(store: CaptureStore, model_id: str, request_ids: list[str] | None = None, act_names: list[str] | None = None) -> Callable[[], DataFrame]:
    """What make_lazy_internal and get_internal read with: token rows of a slot, listed and filtered anew at every read."""
    return lambda: store.tokens(model_id, request_ids, act_names)


def resolve_eos(*sources) -> frozenset[int]:
    """The first source that is not None - an id, a list of ids, an array or tensor of any shape - as a set; none: empty."""
    for s in sources:
        if s is not None:
            found = s.tolist() if hasattr(s, "tolist") else s
            while isinstance(found, (list, tuple)) and any(isinstance(x, (list, tuple)) for x in found):
                found = [y for x in found for y in (x if isinstance(x, (list, tuple)) else [x])]
            return frozenset([found] if isinstance(found, int) else (int(x) for x in found))
    return frozenset()


class StepSource(ABC):
    """What brings the steps of an engine: implement the shape of a step; the driver chains the rules."""

    @abstractmethod
    def steps(self, spark: SparkSession) -> DataFrame:
        """step, slot, prefill, batch, real_len, fed_token."""

    def eos(self) -> frozenset[int]:
        return frozenset()

    def ranges(self, spark: SparkSession) -> DataFrame:
        from .operators import steps as rules

        grouped = rules.group_ids(self.steps(spark), engine="slot")
        return rules.token_ranges(rules.latched(grouped, sorted(self.eos()), ["slot", "grp"]), ["slot", "grp"])


@dataclass(frozen=True)
class Requirement:
    """How much of a field must be there: layers (per-layer fields) or requests; and how long to wait for it."""

    count: int
    retry: bool = False
    timeout_s: float = 30.0
    poll_s: float = 0.25
    match_token_ranges: bool = False

    def __post_init__(self):
        if self.count < 0 or self.timeout_s < 0 or self.poll_s < 0:
            raise ValueError("requirements are not negative")


class LazyInternal:
    """Fields of one run as DataFrames, read when asked for and kept until cleared.

    ``read`` returns token rows afresh each time (a path is listed anew), so polling sees new files. No request ids, or an empty
    list, means the whole run. token_ranges: {request_id: [(start, end), ...]}.
    """

    def __init__(self, read: Callable[[], DataFrame], model_id: str, request_ids: list[str] | None = None, token_ranges: dict | None = None, requirements: dict[str, Requirement] | None = None):
        self._read, self._model, self._ids, self._ranges = read, model_id, list(request_ids or []), token_ranges or {}
        self._required, self._cache = dict(requirements or {}), {}

    def _rows(self, field: str) -> DataFrame:
        rows = self._read().where((F.col("model_id") == self._model) & (F.col("act_name") == _fields[field][0]))
        return rows.where(F.col("request_id").isin(*self._ids)) if self._ids else rows

    def require(self, field: str, *, count: int, retry: bool = False, timeout_s: float = 30.0, poll_s: float = 0.25, match_token_ranges: bool = False) -> LazyInternal:
        self._known(field)
        self._required[field] = Requirement(count, retry, timeout_s, poll_s, match_token_ranges)
        self._cache.pop(field, None)
        return self

    def _known(self, field: str) -> None:
        if field not in _fields:
            raise AttributeError(field)

    def _check(self, field: str, rows: DataFrame) -> None:
        need = self._required.get(field)
        per_layer = _fields[field][1] is _per_layer
        got = rows.agg(F.count("*").alias("n"), F.countDistinct("layer_no" if per_layer else "request_id").alias("parts"), F.max("layer_no").alias("top")).first()
        if not got.n:
            raise MissingInternalError(field)
        if need is not None and got.parts != need.count:
            raise IncompleteInternalError(f"{field}: {got.parts} of {need.count}")
        if need is not None and need.match_token_ranges and self._ranges:
            have: dict[str, set] = {}
            for r in rows.where((F.col("layer_no") == got.top) & (F.col("end_token_idx") > F.col("start_token_idx"))).select("request_id", "start_token_idx", "end_token_idx").distinct().collect():
                have.setdefault(r[0], set()).add((r[1], r[2]))
            for request, want in self._ranges.items():
                if have.get(request, set()) != {tuple(w) for w in want if w[1] > w[0]}:
                    raise IncompleteInternalError(f"{field}: ranges of {request}")

    def get(self, field: str) -> DataFrame:
        """The reassembled field. Missing or incomplete data is read again until the time is up (one read if it is 0); other errors
        come through at once, and failures are not kept."""
        self._known(field)
        if field in self._cache:
            return self._cache[field]
        need = self._required.get(field)
        end = time.monotonic() + (need.timeout_s if need is not None and need.retry else 0)
        while True:
            rows = self._rows(field)
            try:
                self._check(field, rows)
            except (MissingInternalError, IncompleteInternalError):
                if need is None or not need.retry or time.monotonic() >= end:
                    raise
                time.sleep(need.poll_s)
                continue
            self._cache[field] = _fields[field][1](rows)
            return self._cache[field]

    def __getattr__(self, field: str) -> DataFrame:
        if field.startswith("_"):
            raise AttributeError(field)
        return self.get(field)

    def clear_cache(self, field: str | None = None) -> None:
        self._cache.clear() if field is None else self._cache.pop(field, None)

    @property
    def available(self) -> list[str]:
        """Sorted fields whose act occurs, and token_mask where ranges are known."""
        rows = self._read().where(F.col("model_id") == self._model)
        rows = rows.where(F.col("request_id").isin(*self._ids)) if self._ids else rows
        acts = {r[0] for r in rows.select("act_name").distinct().collect()}
        return sorted([f for f, (a, _) in _fields.items() if a in acts] + (["token_mask"] if self._ids and self._ranges else []))

    def token_mask(self, spark: SparkSession) -> DataFrame:
        if not self._ids or not self._ranges:
            raise MissingInternalError("token_mask")
        rows = [(r, a, b) for r in self._ids for a, b in self._ranges[r]]
        return reassemble.token_mask(spark.createDataFrame(rows, "request_id string, range_start int, range_end int"))


def make_lazy_internal(read: Callable[[], DataFrame], model_id: str, requirements: dict[str, Requirement] | None = None, request_ids: list[str] | None = None, token_ranges: dict | None = None) -> LazyInternal:
    return LazyInternal(read, model_id, request_ids, token_ranges, requirements)


def get_internal(read: Callable[[], DataFrame], model_id: str) -> dict[str, DataFrame]:
    """All fields that the run has, each reassembled lazily."""
    whole = LazyInternal(read, model_id)
    return {f: _fields[f][1](whole._rows(f)) for f in whole.available}


#: Short hook names by id, for callers that list them.
SHORT_NAMES = {i: n for n, i in BY_SHORT.items()}
