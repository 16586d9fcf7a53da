"""Queries over scans, names, hook selection, schedules and steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalog, shapes
from ..operators import reassemble, steps as step_ops
from ..schema import HOOKS, hook_defs, hook_values_sql, stored_name
from ..sources import store
from .fixtures import BATCH_STEPS, EOS, SHAPE, STEPS, TOK, batch_steps, read, steps, tok_emb
from .registry import query

HOOKS_SQL = hook_values_sql()
KEY_SQL = "model_id, request_id, act_name, layer_no, shard_rank, start_token_idx, end_token_idx"
ROWS = TOK + f", caps as (select {KEY_SQL}, pos, vec_id, v[1] as first from tok)"


def _captures(spark, sf_dir):
    return tok_emb(spark, sf_dir).withColumn("first", F.get("values", F.lit(0))).drop("values")


def _prefix(*prefix):
    def run(spark, sf_dir):
        return store.prefix_get(_captures(spark, sf_dir), prefix)

    return run


_names = ["model_id", "request_id", "act_name", "layer_no", "shard_rank", "start_token_idx", "end_token_idx"]
for _name, _key in (("prefix_get_k1", ("run0",)), ("prefix_get_k3", ("run0", "0:3", "blocks.hook_resid_pre")), ("prefix_get_full", ("run0", "0:3", "blocks.hook_resid_pre", 1, 0, 0, 4))):
    query(_name, f"with {ROWS} select * from caps where " + " and ".join(f"{c} = {v!r}" for c, v in zip(_names, _key, strict=False)))(_prefix(*_key))


@query("prefix_values_only", f"with {ROWS} select pos, first from caps where model_id = 'run0' and request_id = '0:5'")
def prefix_values_only(spark, sf_dir):
    return store.prefix_get(_captures(spark, sf_dir), ("run0", "0:5"), full_key=False).select("pos", "first")


@query("custom_select", f"with {ROWS} select act_name, layer_no, count(*) as n from caps where request_id = '0:7' group by 1, 2")
def custom_select(spark, sf_dir):
    text = "SELECT act_name, layer_no, count(*) AS n FROM {captures} WHERE request_id = :rid GROUP BY act_name, layer_no"
    return store.custom_select(spark, text, {"rid": "0:7"}, captures=_captures(spark, sf_dir))


@query("scan_act_ordered", f"with {ROWS} select layer_no, start_token_idx, pos, first from caps where model_id = 'run0' and act_name = 'blocks.hook_resid_pre'")
def scan_act_ordered(spark, sf_dir):
    return store.scan_act(_captures(spark, sf_dir), "run0", "blocks.hook_resid_pre").select("layer_no", "start_token_idx", "pos", "first")


@query("path_key_parse", "select event_id, 'r' || (event_id % 9) as request_id, 'resid_pre' as hook, case when event_id % 3 = 0 then -1 else cast(event_id % 4 as int) end as layer_no, cast(event_id % 5 as int) as start_idx, cast(event_id % 5 + 2 as int) as end_idx, case when event_id % 2 = 0 then cast(event_id % 8 as int) else 0 end as shard_rank from events")
def path_key_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    i = F.col("event_id")
    path = F.concat(F.lit("/x/r"), i % 9, F.lit("/resid_pre"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_L"), i % 4)), F.lit("_T"), i % 5, F.lit("_"), i % 5 + 2, F.when(i % 2 == 0, F.concat(F.lit("_SR"), i % 8)).otherwise(""), F.lit(".npy"))
    return e.select("event_id", store.path_key(path).alias("k")).select("event_id", "k.*")


@query("prompt_batches", "with p as (select conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as prompt from conversations where role = 'user' and trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') select conv_id, turn, (row_number() over (order by conv_id, turn) - 1) // 8 as batch, length(prompt) as chars from p")
def prompt_batches(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    return store.prompt_batches(c.withColumn("prompt", F.trim("text", F.lit(" \t\n\r"))), 8, ["conv_id", "turn"]).select("conv_id", "turn", "batch", F.char_length("prompt").cast("long").alias("chars"))


def _ids(names):
    return ", ".join(str(catalog.BY_SHORT[n]) for n in names)


@query("select_hooks", f"select id, short_name from {HOOKS_SQL} where id in ({_ids(['resid_pre', 'final_ln', 'pattern', 'final_logits', 'q', 'token_ids'])})")
def select_hooks(spark, sf_dir):
    return catalog.select_hook_specs(hook_defs(spark), " hf-only, q ,token-ids,", hook="id").select("id", "short_name")


@query("select_hooks_available", f"select id, short_name, short_name not in ('router_logits', 'topk_ids', 'topk_weights') as enabled, short_name in ('router_logits', 'topk_ids', 'topk_weights') as unavailable from {HOOKS_SQL}")
def select_hooks_available(spark, sf_dir):
    return catalog.apply_hook_selection(hook_defs(spark), "full", SHAPE | {"num_experts": 0, "top_k": 0}, hook="id").select("id", "short_name", "enabled", "unavailable")


@query("filter_pp_rank", f"select r.rank, id from {HOOKS_SQL}, (values (0, true, false), (1, false, false), (2, false, true)) r(rank, f, l) where pp_stage = 0 or (pp_stage = 1 and f) or (pp_stage = 2 and l)")
def filter_pp_rank(spark, sf_dir):
    parts = [hook_defs(spark).where(catalog.belongs_to_pp_rank(f, last)).select(F.lit(r).alias("rank"), "id") for r, f, last in ((0, True, False), (1, False, False), (2, False, True))]
    return parts[0].union(parts[1]).union(parts[2])


@query("filter_tp_rank", f"select r.rank, id from {HOOKS_SQL}, (values (0), (1)) r(rank) where r.rank = 0 or tp_sharded")
def filter_tp_rank(spark, sf_dir):
    return hook_defs(spark).where(catalog.belongs_to_tp_rank(0)).select(F.lit(0).alias("rank"), "id").union(hook_defs(spark).where(catalog.belongs_to_tp_rank(1)).select(F.lit(1), "id"))


@query("ep_candidates", f"select id from {HOOKS_SQL} where grp = 1 and not tp_sharded")
def ep_candidates(spark, sf_dir):
    return hook_defs(spark).where(catalog.ep_candidates()).select("id")


@query("schedule_requests", "select event_id from events where event_id >= 2 and event_id - 3 >= 0 and (event_id - 3) % 3 = 0")
def schedule_requests(spark, sf_dir):
    s = catalog.CaptureSchedule(warmup_requests=2, request_offset=1, request_stride=3)
    return read(spark, sf_dir, "events", "event_id").where(s.captures_request(F.col("event_id")))


@query("schedule_steps", "select event_id from events where event_type <> 'signup' and event_id >= 5 and event_id - 7 >= 0 and (event_id - 7) % 4 = 0")
def schedule_steps(spark, sf_dir):
    s = catalog.CaptureSchedule(warmup_steps=5, step_offset=2, step_stride=4, capture_prefill=False)
    e = read(spark, sf_dir, "events", "event_id", "event_type")
    return e.where(s.captures_step(F.col("event_id"), F.when(F.col("event_type") == "signup", "prefill").otherwise("decode"))).select("event_id")


@query("choose_shard", "with s as (select user_id as request_id, event_id % 3 as shard_rank, event_id from events where event_id % 7 <> 0) select request_id, shard_rank, count(*) as n from s where (request_id, shard_rank) in (select (request_id, min(shard_rank)) from s group by request_id) group by 1, 2")
def choose_shard(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id").where("event_id % 7 <> 0")
    rows = e.select(F.col("user_id").alias("request_id"), (F.col("event_id") % 3).alias("shard_rank"))
    return reassemble.chosen_shard(rows, ["request_id"]).groupBy("request_id", "shard_rank").agg(F.count("*").alias("n"))


@query("act_name_roundtrip", f"select id, l.layer as layer, case when per_layer then 'blocks.' || l.layer || '.' || act_name else act_name end as internal_id, case when per_layer then l.layer else -1 end as layer_no, case when per_layer then 'blocks.' || act_name else act_name end as stored from {HOOKS_SQL}, (values (0), (11)) l(layer)")
def act_name_roundtrip(spark, sf_dir):
    h = hook_defs(spark).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(11))))
    internal = F.when(F.col("per_layer"), F.concat(F.lit("blocks."), "layer", F.lit("."), "act_name")).otherwise(F.col("act_name"))
    h = h.withColumn("internal_id", internal).withColumn("p", catalog.parse_internal_id(F.col("internal_id")))
    return h.select("id", "layer", "internal_id", "p.layer_no", F.col("p.act_name").alias("stored"))


@query("elapsed_series", "with s as (select event_id, epoch(ts) - (select min(epoch(ts)) from events) - 10 as elapsed, value from events) select event_id, round(elapsed, 6) as elapsed, value from s where elapsed >= 0")
def elapsed_series(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "value").withColumn("s", F.expr("unix_micros(cast(ts as timestamp)) / 1e6"))
    start = e.agg(F.min("s").alias("t0"))
    return e.crossJoin(F.broadcast(start)).withColumn("elapsed", F.round(F.col("s") - F.col("t0") - 10, 6)).where("elapsed >= 0").select("event_id", "elapsed", "value")


@query("row_basis", f"select id, case when short_name = 'final_logits' then 'REQUEST_ROWS' else 'TOKEN_ROWS' end as basis from {HOOKS_SQL}")
def row_basis(spark, sf_dir):
    return hook_defs(spark).select("id", catalog.row_basis().alias("basis"))


@query("selection_union", f"select id from {HOOKS_SQL} where short_name in ('q', 'k', 'v', 'final_logits')")
def selection_union(spark, sf_dir):
    h = hook_defs(spark)
    return h.where(F.col("short_name").isin("q", "k")).select("id").unionByName(h.where(F.col("short_name").isin("k", "v", "final_logits")).select("id")).distinct()


@query("selection_intersect", f"select id from {HOOKS_SQL} where short_name in ('q', 'mlp_post')")
def selection_intersect(spark, sf_dir):
    h = hook_defs(spark).select("id")
    wanted = catalog.select_hook_specs(h, "q,mlp_post,topk_ids", hook="id")
    gone = h.where(F.col("id").isin(*catalog.unavailable(SHAPE | {"top_k": 0})))
    return h.intersect(wanted).exceptAll(gone)


@query("hook_dim_join", f"select e.event_id, h.act_name, h.per_layer from events e join {HOOKS_SQL} h on e.event_id % 25 = h.id".replace(") as hook_defs(", ") as hd(").replace(" h on", " on").replace("h.act_name", "hd.act_name").replace("h.per_layer", "hd.per_layer").replace("= h.id", "= hd.id"))
def hook_dim_join(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id").withColumn("id", (F.col("event_id") % 25).cast("int"))
    return e.join(F.broadcast(hook_defs(spark)), "id").select("event_id", "act_name", "per_layer")


@query("available_fields", "select f from (values ('attention_scores'), ('hidden_states'), ('logits'), ('token_mask')) t(f)")
def available_fields(spark, sf_dir):
    from ..schema import FIELDS

    acts = tok_emb(spark, sf_dir).select("act_name").union(spark.range(1).select(F.explode(F.array(F.lit("final_logits"), F.lit("blocks.attn.hook_attn_scores"), F.lit("unknown"))))).distinct()
    by = {r[2]: stored_name(r[1], r[3]) for r in HOOKS}
    fields = spark.createDataFrame([(f, by[s]) for f, s in FIELDS.items()], "f string, act_name string")
    return acts.join(F.broadcast(fields), "act_name").select("f").union(spark.range(1).select(F.lit("token_mask"))).orderBy("f")


@query("group_ids", f"with {BATCH_STEPS}, b as (select *, lag(batch) over (partition by engine order by step) as p from bs) select engine, step, cast(sum(case when prefill or p is null or p <> batch then 1 else 0 end) over (partition by engine order by step) as bigint) - 1 as grp from b")
def group_ids(spark, sf_dir):
    return step_ops.group_ids(batch_steps(spark, sf_dir)).select("engine", "step", "grp")


def _ranges(spark, sf_dir):
    s = step_ops.group_ids(steps(spark, sf_dir), engine="slot")
    return step_ops.token_ranges(step_ops.latched(s, EOS, ["slot", "grp"]), ["slot", "grp"])


@query("token_ranges", f"with {STEPS} select step, slot, grp, range_start, range_end from rg")
def token_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).select("step", "slot", "grp", "range_start", "range_end")


@query("eos_latch", f"with {STEPS} select step, slot, fin = 1 as finished from sl")
def eos_latch(spark, sf_dir):
    return step_ops.latched(step_ops.group_ids(steps(spark, sf_dir), engine="slot"), EOS, ["slot", "grp"]).select("step", "slot", "finished")


@query("distinct_ranges", f"with {STEPS} select distinct slot, range_start, range_end from rg where range_end > range_start")
def distinct_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).where("range_end > range_start").select("slot", "range_start", "range_end").distinct()


@query("coverage_check", f"with {STEPS}, g as (select *, coalesce(lag(range_end) over (partition by slot, grp order by range_start, range_end), 0) as p from rg) select slot, grp, cast(sum(case when range_start <> p then 1 else 0 end) as bigint) as gaps, max(range_end) as last_end, count(*) as chunks, sum(case when range_start <> p then 1 else 0 end) = 0 as contiguous from g group by 1, 2")
def coverage_check(spark, sf_dir):
    return step_ops.coverage(_ranges(spark, sf_dir), ["slot", "grp"])


@query("match_token_ranges", f"with {STEPS}, d as (select distinct slot, grp, range_start, range_end from rg where range_end > range_start), l as (select *, lag(range_end) over (partition by slot, grp order by range_start, range_end) as p from d) select slot, grp, count(*) as n, min(range_start) = 0 and sum(case when p is not null and p <> range_start then 1 else 0 end) = 0 as complete from l group by all")
def match_token_ranges(spark, sf_dir):
    d = _ranges(spark, sf_dir).where("range_end > range_start")
    got = d.groupBy("slot", "grp").agg(F.array_sort(F.collect_set(F.struct("range_start", "range_end"))).alias("r"))
    whole = F.forall(F.sequence(F.lit(1), F.size("r")), lambda i: F.element_at("r", i)["range_start"] == F.when(i == 1, 0).otherwise(F.element_at("r", F.greatest(i - 1, F.lit(1)))["range_end"]))
    return got.select("slot", "grp", F.size("r").cast("long").alias("n"), whole.alias("complete"))


@query("packed_offsets", "select event_id, user_id, coalesce(cast(sum(1 + event_id % 4) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as bigint), 0) as dim0 from events")
def packed_offsets(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id").withColumn("n", 1 + F.col("event_id") % 4)
    return e.select("event_id", "user_id", step_ops.exclusive_sum("n", ["user_id"], ["event_id"]).alias("dim0"))


@query("position_ids", "select event_id, user_id, case when event_type = 'error' then 0 else cast(sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as bigint) - 1 end as position_id from events")
def position_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("m", F.when(F.col("event_type") == "error", 0).otherwise(1))
    run = F.sum("m").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", "user_id", F.when(F.col("m") == 0, 0).otherwise(run - 1).cast("long").alias("position_id"))


@query("step_durations", "with d as (select user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as us, row_number() over (partition by user_id order by ts, event_id) as k from events) select user_id, event_id, us, case when k = 2 then 'prefill' else 'decode' end as phase from d where us is not null")
def step_durations(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("us", F.col("t") - F.lag("t").over(w)).withColumn("k", F.row_number().over(w))
    return e.where("us is not null").select("user_id", "event_id", "us", F.when(F.col("k") == 2, "prefill").otherwise("decode").alias("phase"))


@query("trim_first_eos", "with f as (select user_id, min(event_id) as e from events where event_type = 'error' group by 1) select events.user_id, event_id from events left join f using (user_id) where e is null or event_id <= e")
def trim_first_eos(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    first = F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(Window.partitionBy("user_id"))
    return e.withColumn("first", first).where("first is null or event_id <= first").select("user_id", "event_id")


@query("reservation_class", "select event_id, case when event_id % 11 = 0 then -1 when (event_id * 37) % 5000 > 4096 then 2 when (event_id * 37) % 5000 <= (event_id * 91) % 4096 then 0 else 1 end as outcome from events where (event_id * 37) % 5000 > 0")
def reservation_class(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id").where("(event_id * 37) % 5000 > 0")
    i = F.col("event_id")
    return e.select("event_id", step_ops.reservation_class((i * 37) % 5000, F.when(i % 11 == 0, 0).otherwise(3), (i * 91) % 4096, 4096).alias("outcome"))


@query("natural_order", f"with {TOK} select request_id, row_number() over (order by cast(split_part(request_id, ':', 1) as int), cast(split_part(request_id, ':', 2) as int)) - 1 as batch_idx from (select distinct request_id from tok)")
def natural_order(spark, sf_dir):
    return reassemble.batch_index(tok_emb(spark, sf_dir))


@query("limit_tokens", f"with {TOK} select request_id, layer_no, pos from tok where pos < 12")
def limit_tokens(spark, sf_dir):
    return tok_emb(spark, sf_dir).where("pos < 12").select("request_id", "layer_no", "pos")


@query("union_requests", f"with {TOK} select request_id, layer_no, pos from tok where request_id in ('0:1', '0:4')")
def union_requests(spark, sf_dir):
    t = tok_emb(spark, sf_dir)
    return store.prefix_get(t, ("run0", "0:1")).unionByName(store.prefix_get(t, ("run0", "0:4"))).select("request_id", "layer_no", "pos")


@query("parse_request_id", f"with {TOK} select distinct request_id, cast(split_part(request_id, ':', 1) as int) as grp, cast(split_part(request_id, ':', 2) as int) as idx from tok")
def parse_request_id(spark, sf_dir):
    return tok_emb(spark, sf_dir).select("request_id").distinct().select("request_id", store.request_parts(F.col("request_id")).alias("p")).select("request_id", "p.*")


@query("label_clean", "select n_nationkey, replace(replace(n_name, chr(10), '\\n'), 'A', '_') as label, substr(n_name || n_name || n_name || n_name || n_name || n_name || n_name || n_name || n_name || n_name || n_name, 1, 60) as short from nation")
def label_clean(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return n.select("n_nationkey", F.replace(F.replace("n_name", F.lit("\n"), F.lit("\\n")), F.lit("A"), F.lit("_")).alias("label"), F.substring(F.repeat("n_name", 11), 1, 60).alias("short"))


_STEP_SQL = f"""with s as (select event_id as step, 1 + event_id % 4 as batch, 1 + event_id % 9 as q, 16 + event_id % 100 as kv, event_id % 2 as keep, event_id % 3 = 0 as packed from events),
 h as (select * from {HOOKS_SQL}),
 x as (select step, id, shape_class, case when packed then 1 else batch end as b, q, kv, case when keep > 0 then keep else q end as r from s, h),
 e as (select step, id, case shape_class when 0 then b * q * 1024 when 1 then b * q * 8 * 128 when 2 then b * q * 4 * 128 when 3 then b * q * 8 * 128 when 4 then b * 8 * q * kv when 5 then b * q * 1408 when 6 then b * q when 7 then b * r * 151936 when 8 then b * q * 60 else b * q * 4 end as n from x)"""


def _shapes(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    i = F.col("event_id")
    s = e.select(i.alias("step"), (1 + i % 4).alias("batch"), (1 + i % 9).alias("q"), (16 + i % 100).alias("kv"), (i % 2).alias("keep"), (i % 3 == 0).alias("packed"))
    s = s.crossJoin(F.broadcast(hook_defs(spark).select("id", "shape_class")))
    return s.withColumn("shape", shapes.hook_shape(F.col("shape_class"), SHAPE, F.col("batch"), F.col("q"), F.col("kv"), F.col("keep"), F.col("packed")))


@query("hook_shape", _STEP_SQL + " select step, id, n from e")
def hook_shape(spark, sf_dir):
    return _shapes(spark, sf_dir).select("step", "id", shapes.elements(F.col("shape")).alias("n"))


@query("plan_step", _STEP_SQL + " select step, cast(sum((n * 2 + 15) // 16 * 16) as bigint) as total_bytes, count(*) as hooks from e where n > 0 group by 1")
def plan_step(spark, sf_dir):
    n = _shapes(spark, sf_dir).select("step", shapes.elements(F.col("shape")).alias("n")).where("n > 0")
    return n.groupBy("step").agg(F.sum(shapes.align_up(F.col("n") * 2, 16)).alias("total_bytes"), F.count("*").alias("hooks"))


@query("decode_step_bytes", _STEP_SQL.replace("1 + event_id % 9 as q", "1 as q").replace("event_id % 3 = 0 as packed", "false as packed") + " select step, cast(sum((n * 2 + 15) // 16 * 16) as bigint) as total_bytes from e where n > 0 group by 1")
def decode_step_bytes(spark, sf_dir):
    s = _shapes(spark, sf_dir).withColumn("shape", shapes.hook_shape(F.col("shape_class"), SHAPE, F.col("batch"), F.lit(1), F.col("kv"), F.col("keep"), F.lit(False)))
    return s.select("step", shapes.elements(F.col("shape")).alias("n")).where("n > 0").groupBy("step").agg(F.sum(shapes.align_up(F.col("n") * 2, 16)).alias("total_bytes"))


@query("align_up", "select event_id, (event_id + 255) // 256 * 256 as aligned from events")
def align_up(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id").select("event_id", shapes.align_up(F.col("event_id"), 256).alias("aligned"))


@query("kv_dim", "select event_id, case event_id % 3 when 1 then 2048 when 2 then event_id % 50 + 1 + event_id % 7 else 1 + event_id % 7 end as kv from events")
def kv_dim(spark, sf_dir):
    e, i = read(spark, sf_dir, "events", "event_id"), F.col("event_id")
    cache = F.when(i % 3 == 1, "static").when(i % 3 == 2, "dynamic")
    return e.select("event_id", shapes.kv_dim(cache, 1 + i % 7, F.lit(2048).cast("long"), i % 50).alias("kv"))


@query("dim0_recovery", "select event_id, case when (event_id % 40 * 8) % 32 = 0 then event_id % 40 * 8 // 32 end as dim0 from events")
def dim0_recovery(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    return e.select("event_id", shapes.recovered_dim0(F.col("event_id") % 40 * 8, F.array(F.lit(9), F.lit(8)).cast("array<bigint>"), 4).cast("long").alias("dim0"))


@query("two_span", "select event_id, (event_id * 77) % 1000 as first_offset, least(event_id % 300, 1000 - (event_id * 77) % 1000) as first_bytes, event_id % 300 - least(event_id % 300, 1000 - (event_id * 77) % 1000) as second_bytes from events")
def two_span(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    return e.select("event_id", shapes.two_spans(F.col("event_id") * 77, F.col("event_id") % 300, 1000).alias("s")).select("event_id", "s.*")


@query("delta_token_len", f"select id, case when shape_class = 4 then 7 else 5 end as n from {HOOKS_SQL}")
def delta_token_len(spark, sf_dir):
    shape = F.when(F.col("shape_class") == 4, F.array(F.lit(3), F.lit(7), F.lit(11))).otherwise(F.array(F.lit(5), F.lit(64)))
    return hook_defs(spark).select("id", store.delta_tokens(F.col("act_name"), shape).alias("n"))


@query("mask_lengths", "select event_id, event_id % 6 as real_len, 8 - event_id % 6 as left_pad from events")
def mask_lengths(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j >= 8 - F.col("event_id") % 6, 1).otherwise(0))
    real = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("event_id", real.alias("real_len"), (F.size(mask) - real).alias("left_pad"))


@query("model_shape", "select n_nationkey, case when n_nationkey % 4 <> 3 then 64 * (n_nationkey + 1) end as hidden_dim, case when n_nationkey % 4 <> 3 then case when n_nationkey % 2 = 0 then 8 else 4 end end as num_kv_heads, case when n_nationkey % 4 <> 3 then case when n_nationkey % 2 = 1 then 256 * (n_nationkey + 1) else 0 end end as intermediate_dim from nation")
def model_shape(spark, sf_dir):
    n, k = read(spark, sf_dir, "nation", "n_nationkey"), F.col("n_nationkey")
    hidden = F.when(k % 4 == 3, "").when(k % 2 == 0, F.concat(F.lit('"hidden_size":'), 64 * (k + 1), F.lit(","))).otherwise(F.concat(F.lit('"n_embd":'), 64 * (k + 1), F.lit(',"model_type":"gpt2","num_key_value_heads":4,')))
    config = F.concat(F.lit("{"), hidden, F.lit('"n_head":8}'))
    return n.select("n_nationkey", shapes.model_shape(config).alias("s")).select("n_nationkey", "s.hidden_dim", "s.num_kv_heads", "s.intermediate_dim")
