"""Hook selection, ownership by rank, capture schedules and names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HOOKS, LOGITS

BY_SHORT = {r[2]: r[0] for r in HOOKS}
ALL_HOOKS = frozenset(BY_SHORT.values())
# Presets and aliases.
_presets: dict[str, frozenset[int]] = {"full": ALL_HOOKS, "hf-only": frozenset(BY_SHORT[x] for x in ("resid_pre", "final_ln", "pattern", "final_logits"))}
ALIASES = {"hidden-states": "resid_pre", "hidden_states": "resid_pre", "logits": "final_logits", "token-ids": "token_ids"}


def register_preset(name: str, hook_types) -> None:
    """A named set of hook ids; a name that is taken raises ValueError."""
    if name in _presets:
        raise ValueError(f"preset {name!r} is registered")
    _presets[name] = frozenset(hook_types)


def is_preset_registered(name: str) -> bool:
    return name in _presets


def resolve_hook_selection(mode: str) -> frozenset[int]:
    """Comma-separated presets, short names and aliases -> hook ids. Unknown or no tokens raise ValueError."""
    out: set[int] = set()
    tokens = [t.strip() for t in mode.split(",") if t.strip()]
    for t in tokens:
        if t in _presets:
            out |= _presets[t]
        elif ALIASES.get(t, t) in BY_SHORT:
            out.add(BY_SHORT[ALIASES.get(t, t)])
        else:
            raise ValueError(f"unknown hook selection {t!r}")
    if not tokens:
        raise ValueError("empty hook selection")
    return frozenset(out)


def unavailable(config: dict | None) -> frozenset[int]:
    """Hooks that a model of this shape has not."""
    if config is None:
        return frozenset()
    gone = [("mlp_post", "intermediate_dim"), ("router_logits", "num_experts"), ("topk_ids", "top_k"), ("topk_weights", "top_k")]
    return frozenset(BY_SHORT[h] for h, key in gone if not config.get(key))


def select_hook_specs(specs: DataFrame, mode: str, config: dict | None = None, hook: str = "hook_type") -> DataFrame:
    """Rows of specs whose hook is selected and available; a pushed-down membership test."""
    return specs.where(F.col(hook).isin(*sorted(resolve_hook_selection(mode) - unavailable(config))))


def apply_hook_selection(specs: DataFrame, mode: str, config: dict | None = None, hook: str = "hook_type") -> DataFrame:
    """All rows, with ``enabled`` and ``unavailable``."""
    chosen, gone = resolve_hook_selection(mode), unavailable(config)
    return specs.withColumn("enabled", F.col(hook).isin(*sorted(chosen - gone))).withColumn("unavailable", F.col(hook).isin(*sorted(chosen & gone)))


def belongs_to_pp_rank(is_first: bool, is_last: bool) -> Column:
    return F.when(F.col("pp_stage") == 1, F.lit(is_first)).when(F.col("pp_stage") == 2, F.lit(is_last)).otherwise(True)


def belongs_to_tp_rank(tp_rank: int) -> Column:
    return F.lit(True) if tp_rank == 0 else F.col("tp_sharded")


def ep_candidates() -> Column:
    return (F.col("grp") == 1) & ~F.col("tp_sharded")


def row_basis() -> Column:
    return F.when(F.col("shape_class") == LOGITS, "REQUEST_ROWS").otherwise("TOKEN_ROWS")


@dataclass(frozen=True)
class CaptureSchedule:
    """Which requests and steps are captured; every field is checked when it is made."""

    step_stride: int = 1
    step_offset: int = 0
    warmup_steps: int = 0
    capture_prefill: bool = True
    capture_decode: bool = True
    request_stride: int = 1
    request_offset: int = 0
    warmup_requests: int = 0

    def __post_init__(self):
        for n in ("step_stride", "request_stride"):
            if getattr(self, n) < 1:
                raise ValueError(f"{n} must be positive")
        for n in ("step_offset", "warmup_steps", "request_offset", "warmup_requests"):
            if getattr(self, n) < 0:
                raise ValueError(f"{n} must not be negative")

    @staticmethod
    def _due(i: Column, warmup: int, offset: int, stride: int) -> Column:
        past = i - warmup - offset
        return (i >= warmup) & (past >= 0) & (past % stride == 0)

    def captures_request(self, request: Column) -> Column:
        return self._due(request, self.warmup_requests, self.request_offset, self.request_stride)

    def captures_step(self, step: Column, phase: Column) -> Column:
        """phase is prefill or decode; anything else raises when the row is reached."""
        on = F.when(phase == "prefill", F.lit(self.capture_prefill)).when(phase == "decode", F.lit(self.capture_decode)).otherwise(F.raise_error(F.concat(F.lit("bad phase "), phase)).cast("boolean"))
        return on & self._due(step, self.warmup_steps, self.step_offset, self.step_stride)


def parse_internal_id(name: Column) -> Column:
    """blocks.<layer>.x -> (layer, blocks.x); anything else (-1, name)."""
    layer = F.nullif(F.regexp_extract(name, r"^blocks\.(\d+)\..+$", 1), F.lit(""))
    return F.struct(F.coalesce(layer.cast("int"), F.lit(-1)).alias("layer_no"), F.when(layer.isNull(), name).otherwise(F.regexp_replace(name, r"^blocks\.\d+\.", "blocks.")).alias("act_name"))


def natural_key(request: Column) -> Column:
    """Sorts parts between ':' as numbers where they are, before texts."""
    return F.transform(F.split(request, ":"), lambda p: F.struct(p.try_cast("bigint").isNull().alias("text"), p.try_cast("bigint").alias("number"), p.alias("raw")))
