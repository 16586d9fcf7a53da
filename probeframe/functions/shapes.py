"""Shape algebra of hooks and the byte plan of a step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ATTENTION, HIDDEN, KV, LOGITS, MLP_POST, Q, ROUTER, TOKEN_IDS, TOPK_IDS, TOPK_WEIGHTS, Z


def align_up(x: Column, a: int) -> Column:
    """x rounded up to a multiple of a, which is a power of two."""
    if a <= 0 or a & (a - 1):
        raise ValueError("the alignment is a power of two")
    return (x + (a - 1)).bitwiseAND(F.lit(~(a - 1)))


def hook_shape(shape_class: Column, c: dict, batch: Column, q_len: Column, kv_dim: Column, keep: Column, packed: Column) -> Column:
    """Dimensions (array of long) of a hook's tensor: [batch, q, ...], or [tokens, ...] where packed. Unknown classes: [].

    c: hidden_dim, num_heads, num_kv_heads, head_dim, vocab_size, intermediate_dim, num_experts, top_k, tp_size.
    """
    tp = c.get("tp_size", 1)
    heads, kv_heads = max(1, c["num_heads"] // tp), max(1, c["num_kv_heads"] // tp)

    def dims(*tail: int) -> Column:
        last = [F.lit(x).cast("long") for x in tail]
        return F.when(packed, F.array(q_len.cast("long"), *last)).otherwise(F.array(batch.cast("long"), q_len.cast("long"), *last))

    rows = F.when(keep > 0, keep).otherwise(q_len).cast("long")
    attention = F.when(packed, F.array(F.lit(heads).cast("long"), q_len.cast("long"), kv_dim.cast("long"))).otherwise(F.array(batch.cast("long"), F.lit(heads).cast("long"), q_len.cast("long"), kv_dim.cast("long")))
    z = F.when(packed, F.array(q_len.cast("long"), F.lit(heads * c["head_dim"]).cast("long"))).otherwise(F.array(batch.cast("long"), q_len.cast("long"), F.lit(heads).cast("long"), F.lit(c["head_dim"]).cast("long")))
    logits = F.when(packed, F.array(rows, F.lit(c["vocab_size"]).cast("long"))).otherwise(F.array(batch.cast("long"), rows, F.lit(c["vocab_size"]).cast("long")))
    return (
        F.when(shape_class == HIDDEN, dims(c["hidden_dim"]))
        .when(shape_class == Q, dims(heads, c["head_dim"]))
        .when(shape_class == KV, dims(kv_heads, c["head_dim"]))
        .when(shape_class == Z, z)
        .when(shape_class == ATTENTION, attention)
        .when(shape_class == MLP_POST, dims(c["intermediate_dim"] // tp))
        .when(shape_class == TOKEN_IDS, dims())
        .when(shape_class == LOGITS, logits)
        .when(shape_class == ROUTER, dims(c["num_experts"]))
        .when(shape_class.isin(TOPK_IDS, TOPK_WEIGHTS), dims(c["top_k"]))
        .otherwise(F.array().cast("array<bigint>"))
    )


def elements(shape: Column) -> Column:
    """The product of the dimensions; of no dimensions 0."""
    return F.when(F.size(shape) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x))


def kv_dim(cache: Column, q_len: Column, longest: Column, seen: Column) -> Column:
    """Key width: no cache -> q_len, static -> its length, dynamic -> seen + q_len."""
    return F.when(cache == "static", longest).when(cache == "dynamic", seen + q_len).otherwise(q_len)


def recovered_dim0(total_bytes: Column, shape: Column, item: int) -> Column:
    """First dimension from the bytes that came; null where they do not divide."""
    inner = F.aggregate(F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0))), F.lit(item).cast("long"), lambda a, x: a * x)
    return F.when((F.size(shape) >= 2) & (inner > 0) & (total_bytes % inner == 0), F.expr("1") * F.floor(total_bytes / inner))


def two_spans(start: Column, length: Column, capacity: int) -> Column:
    """Where a payload of ``length`` lies in a ring: (first offset, first length, second length)."""
    at = start % capacity
    first = F.least(length, F.lit(capacity) - at)
    return F.struct(at.alias("first_offset"), first.alias("first_bytes"), (length - first).alias("second_bytes"))


def model_shape(config: Column) -> Column:
    """Shape fields from a JSON config with alias fallbacks; null where hidden size or heads are missing."""

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(config, f"$.{n}").cast("int") for n in names])

    hidden, heads = pick("hidden_size", "n_embd", "d_model"), pick("num_attention_heads", "n_head")
    kv, head = F.coalesce(pick("num_key_value_heads"), heads), F.coalesce(pick("head_dim"), F.floor(hidden / heads).cast("int"))
    inner = F.coalesce(pick("intermediate_size", "n_inner", "ffn_dim"), F.when(F.get_json_object(config, "$.model_type") == "gpt2", hidden * 4), F.lit(0))
    out = F.struct(hidden.alias("hidden_dim"), heads.alias("num_heads"), kv.alias("num_kv_heads"), head.alias("head_dim"), inner.alias("intermediate_dim"), F.coalesce(pick("vocab_size"), F.lit(0)).alias("vocab_size"), F.coalesce(pick("num_experts", "num_local_experts"), F.lit(0)).alias("num_experts"), F.coalesce(pick("num_experts_per_tok", "top_k"), F.lit(0)).alias("top_k"))
    return F.when(hidden.isNotNull() & heads.isNotNull(), out)
