"""Schemas, element types and the hook catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAPTURES = "model_id string, request_id string, act_name string, layer_no int, shard_rank int, start_token_idx int, end_token_idx int, dtype string, shape array<long>, bytes binary"
KEY = ["model_id", "request_id", "act_name", "layer_no", "shard_rank", "start_token_idx", "end_token_idx"]
VALUES = ["dtype", "shape", "bytes"]
TOKENS = "model_id string, request_id string, act_name string, layer_no int, shard_rank int, start_token_idx int, end_token_idx int, pos int, values array<double>"

# Stored element types and their sizes in bytes.
DTYPE_BYTES = {
    "torch.float": 4, "torch.float32": 4, "torch.double": 8, "torch.float64": 8, "torch.half": 2, "torch.float16": 2, "torch.bfloat16": 2, "torch.uint8": 1, "torch.int8": 1,
    "torch.short": 2, "torch.int16": 2, "torch.int": 4, "torch.int32": 4, "torch.long": 8, "torch.int64": 8, "torch.bool": 1, "torch.chalf": 4, "torch.cfloat": 8, "torch.cdouble": 16,
}

# The hook catalog (id, act_name, short_name, per_layer, grp, tp_sharded, shape_class, pp_stage).
# grp: 0 attention, 1 mlp, 2 other; pp_stage: 0 any, 1 first, 2 last.
HOOKS = [
    (0, "hook_resid_pre", "resid_pre", True, 2, False, 0, 0),
    (1, "hook_ln1", "ln1", True, 2, False, 0, 0),
    (2, "hook_attn_out", "attn_out", True, 0, False, 0, 0),
    (3, "hook_resid_mid", "resid_mid", True, 2, False, 0, 0),
    (4, "attn.hook_attn_scores", "attn_scores", True, 0, True, 4, 0),
    (5, "attn.hook_pattern", "pattern", True, 0, True, 4, 0),
    (6, "attn.hook_q", "q", True, 0, True, 1, 0),
    (7, "attn.hook_k", "k", True, 0, True, 2, 0),
    (8, "attn.hook_v", "v", True, 0, True, 2, 0),
    (9, "attn.hook_z", "z", True, 0, True, 3, 0),
    (11, "hook_ln2", "ln2", True, 2, False, 0, 0),
    (12, "hook_mlp_in", "mlp_in", True, 1, False, 0, 0),
    (13, "hook_mlp_out", "mlp_out", True, 1, False, 0, 0),
    (14, "hook_resid_final", "resid_final", False, 2, False, 0, 2),
    (15, "hook_embed", "embed", False, 2, False, 0, 1),
    (16, "hook_pos_embed", "pos_embed", False, 2, False, 0, 1),
    (17, "hook_final_ln", "final_ln", False, 2, False, 0, 2),
    (18, "token_ids", "token_ids", False, 2, False, 6, 1),
    (19, "final_logits", "final_logits", False, 2, False, 7, 2),
    (20, "hook_mlp_post", "mlp_post", True, 1, True, 5, 0),
    (21, "mlp.hook_router_logits", "router_logits", True, 2, False, 8, 0),
    (22, "mlp.hook_topk_ids", "topk_ids", True, 2, False, 9, 0),
    (23, "mlp.hook_topk_weights", "topk_weights", True, 2, False, 10, 0),
]
HOOK_SCHEMA = "id int, act_name string, short_name string, per_layer boolean, grp int, tp_sharded boolean, shape_class int, pp_stage int"
HIDDEN, Q, KV, Z, ATTENTION, MLP_POST, TOKEN_IDS, LOGITS, ROUTER, TOPK_IDS, TOPK_WEIGHTS = range(11)

# Public field -> short hook name.
FIELDS = {
    "hidden_states": "resid_pre", "ln1": "ln1", "ln2": "ln2", "attention_output": "attn_out", "attention_values": "z", "middle_residual": "resid_mid", "mlp_input": "mlp_in",
    "mlp_output": "mlp_out", "mlp_activation": "mlp_post", "q": "q", "k": "k", "v": "v", "router_logits": "router_logits", "expert_ids": "topk_ids", "expert_weights": "topk_weights",
    "attention_scores": "attn_scores", "attentions": "pattern", "embeddings": "embed", "position_embeddings": "pos_embed", "final_hidden": "final_ln", "final_residual": "resid_final",
    "logits": "final_logits", "token_ids": "token_ids",
}


def stored_name(act_name: str, per_layer: bool) -> str:
    return f"blocks.{act_name}" if per_layer else act_name


def hook_defs(spark: SparkSession) -> DataFrame:
    """The catalog as a small dimension table (23 rows, safe to broadcast)."""
    return spark.createDataFrame(HOOKS, HOOK_SCHEMA).coalesce(1)


def hook_values_sql() -> str:
    """The catalog as a VALUES list that any SQL engine reads."""
    rows = ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else repr(x) for x in r) + ")" for r in HOOKS)
    return f"(values {rows}) as hook_defs(id, act_name, short_name, per_layer, grp, tp_sharded, shape_class, pp_stage)"
