"""Queries over captured values, reassembly, comparison, and run reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tensors
from ..operators import analytics, pairing, reassemble, reports
from ..schema import hook_defs, hook_values_sql
from .fixtures import ATTENTION, BENCH, KERNELS, LOGITS, REF, STEPS, TOK, attention, bench_runs, kernels, logits, nvtx, read, ref_emb, tok_emb, token_ids
from .registry import query

HOOKS_SQL = hook_values_sql()
#: The key of a token row.
ROW = ["request_id", "layer_no", "pos"]


def _long(df, key):
    """One row for each element."""
    return df.select(*key, F.posexplode("values").alias("col", "value"))


_SEQ = TOK + ", sq as (select *, row_number() over (partition by request_id, layer_no order by start_token_idx, end_token_idx, pos) - 1 as seq, count(*) over (partition by request_id, layer_no) as n from tok), wd as (select max(n) as width from sq)"
_SEQL = _SEQ + ", wl as (select layer_no, max(n) as lw from sq group by 1)"


@query("reassemble_per_layer", f"with {_SEQ} select request_id, layer_no, seq, v[1] as first, v[64] as last from sq")
def reassemble_per_layer(spark, sf_dir):
    t = reassemble.concatenated(tok_emb(spark, sf_dir), ["layer_no", "request_id"])
    return t.select("request_id", "layer_no", "seq", F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(63)).alias("last"))


@query("left_pad_stack", f"with {_SEQL}, g as (select request_id, layer_no, n, lw, unnest(range(lw)) as slot from (select distinct request_id, layer_no, n from sq) join wl using (layer_no)) select g.request_id, g.layer_no, slot, coalesce(v[1], 0) as first from g left join sq on sq.request_id = g.request_id and sq.layer_no = g.layer_no and sq.seq = slot - (lw - g.n)")
def left_pad_stack(spark, sf_dir):
    p = reassemble.left_padded(tok_emb(spark, sf_dir), ["layer_no", "request_id"], ["layer_no"])
    return p.select("request_id", "layer_no", "slot", F.coalesce(F.get("values", F.lit(0)), F.lit(0.0)).alias("first"))


#: Global fields have no layers: every layer's requests count as requests of their own.
_OWN = "concat_ws(':', layer_no, element_at(split(request_id, ':'), 2))"
_G = TOK + ", t0 as (select *, row_number() over (partition by request_id order by start_token_idx, end_token_idx, pos) - 1 as seq, count(*) over (partition by request_id) as n, (vec_id * 7 + 3) % 64 as token from (select * replace (layer_no || ':' || split_part(request_id, ':', 2) as request_id) from tok)), w0 as (select max(n) as width from t0), g as (select request_id, n, width, unnest(range(width)) as slot from (select distinct request_id, n from t0), w0)"


@query("reassemble_global", f"with {_G} select g.request_id, slot, coalesce(v[64], 0) as last from g left join t0 on t0.request_id = g.request_id and seq = slot - (width - g.n)")
def reassemble_global(spark, sf_dir):
    p = reassemble.left_padded(tok_emb(spark, sf_dir).withColumn("request_id", F.expr(_OWN)), ["request_id"], [])
    return p.select("request_id", "slot", F.coalesce(F.get("values", F.lit(63)), F.lit(0.0)).alias("last"))


@query("reassemble_token_ids", f"with {_G} select g.request_id, slot, coalesce(token, 0) as token from g left join t0 on t0.request_id = g.request_id and seq = slot - (width - g.n)")
def reassemble_token_ids(spark, sf_dir):
    t = tok_emb(spark, sf_dir).withColumn("request_id", F.expr(_OWN)).withColumn("token", (F.col("vec_id") * 7 + 3) % 64).withColumn("values", F.array("token"))
    return reassemble.left_padded(t, ["request_id"], []).select("request_id", "slot", F.coalesce(F.get("values", F.lit(0)), F.lit(0)).alias("token"))


@query("merge_truncate", f"with {_SEQ} select request_id, layer_no, seq, v[1] as first from sq where seq < 3")
def merge_truncate(spark, sf_dir):
    t = reassemble.concatenated(tok_emb(spark, sf_dir), ["layer_no", "request_id"]).where("seq < 3")
    return t.select("request_id", "layer_no", "seq", F.get("values", F.lit(0)).alias("first"))


_MERGED = ATTENTION + """, lw as (select request_id, head, arg_max(keys, query) as w from att group by 1, 2),
  mg as (select r.request_id, r.head, r.query, k as key, coalesce(x, '-inf'::double) as x from (select distinct request_id, head, query from att) r join lw using (request_id, head), unnest(range(w)) u(k)
         left join att on att.request_id = r.request_id and att.head = r.head and att.query = r.query and att.key = k)"""


def _finite(c):
    """Minus infinity as a number that any engine prints alike."""
    return F.when(c == float("-inf"), -1e9).otherwise(c)


@query("merge_attention", f"with {_MERGED} select request_id, head, query, cast(key as int) as key, case when x = '-inf'::double then -1e9 else x end as value from mg")
def merge_attention(spark, sf_dir):
    m = reassemble.merged_attention(attention(spark, sf_dir), ["request_id", "head"], float("-inf"))
    return m.select("request_id", "head", "query", "key", _finite(F.col("value")).alias("value"))


@query("attention_batch_stack", f"with {_MERGED}, s as (select request_id, max(query) + 1 as q, max(key) + 1 as k from mg group by 1), z as (select max(q) as qw, max(k) as kw from s) select m.request_id, m.head, m.query + z.qw - s.q as q_slot, m.key + z.kw - s.k as k_slot, case when x = '-inf'::double then -1e9 else x end as value from mg m join s using (request_id), z")
def attention_batch_stack(spark, sf_dir):
    m = reassemble.merged_attention(attention(spark, sf_dir), ["request_id", "head"], float("-inf"))
    size = m.groupBy("request_id").agg((F.max("query") + 1).alias("q"), (F.max("key") + 1).alias("k"))
    whole = size.agg(F.max("q").alias("qw"), F.max("k").alias("kw"))
    b = m.join(size, "request_id").crossJoin(F.broadcast(whole))
    return b.select("request_id", "head", (F.col("query") + F.col("qw") - F.col("q")).cast("long").alias("q_slot"), (F.col("key") + F.col("kw") - F.col("k")).cast("long").alias("k_slot"), _finite(F.col("value")).alias("value"))


@query("attention_grid", f"with {ATTENTION}, n as (select max(keys) as t from att) select r.request_id, r.head, r.query, cast(k as int) as key, case when coalesce(x, 0) = '-inf'::double then -1e9 else coalesce(x, 0) end as value from (select distinct request_id, head, query from att) r, n, unnest(range(t)) u(k) left join att on att.request_id = r.request_id and att.head = r.head and att.query = r.query and att.key = k")
def attention_grid(spark, sf_dir):
    a = attention(spark, sf_dir)
    t = a.agg(F.max("keys").alias("t"))
    g = a.crossJoin(F.broadcast(t)).withColumn("key", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    return g.select("request_id", "head", "query", "key", _finite(F.coalesce(F.get("row", F.col("key")), F.lit(0.0))).alias("value"))


@query("attention_submatrix", f"with {ATTENTION} select query, cast(key as int) as key, case when x = '-inf'::double then -1e9 else x end as value from att where request_id = '0:2' and head = 1 and query < 3 and key < 3")
def attention_submatrix(spark, sf_dir):
    a = attention(spark, sf_dir).where("request_id = '0:2' and head = 1 and query < 3")
    return a.select("query", F.posexplode("row").alias("key", "x")).where("key < 3").select("query", "key", _finite(F.col("x")).alias("value"))


@query("require_count", f"with {TOK} select act_name, count(distinct layer_no) as layers, max(layer_no) + 1 as expected, count(distinct layer_no) = max(layer_no) + 1 as complete from tok group by 1")
def require_count(spark, sf_dir):
    t = tok_emb(spark, sf_dir).groupBy("act_name").agg(F.countDistinct("layer_no").alias("layers"), (F.max("layer_no") + 1).alias("expected"))
    return t.withColumn("complete", F.col("layers") == F.col("expected"))


_MASK = """e as (select slot as request_id, grp, max(range_end) as en from rg group by all), w as (select max(en) as width from e),
  g as (select request_id, grp, en, width, unnest(range(width)) as s from e, w), c as (select distinct slot as request_id, grp, unnest(range(range_start, range_end)) as s from rg where range_end > range_start)"""


@query("token_mask", f"with {STEPS}, {_MASK} select g.request_id, g.grp, cast(g.s as int) as slot, c.s is not null as present from g left join c on c.request_id = g.request_id and c.grp = g.grp and c.s = g.s - (g.width - g.en)")
def token_mask(spark, sf_dir):
    from .selection_queries import _ranges

    r = _ranges(spark, sf_dir).withColumnRenamed("slot", "request_id")
    return reassemble.token_mask(r, ["request_id", "grp"])


@query("shape_uniformity", f"with {TOK} select layer_no, count(distinct len(v)) as shapes, count(*) as n from tok group by 1")
def shape_uniformity(spark, sf_dir):
    return tok_emb(spark, sf_dir).groupBy("layer_no").agg(F.countDistinct(F.size("values")).alias("shapes"), F.count("*").alias("n"))


@query("ragged_counts", f"with {_SEQL} select request_id, layer_no, cast(sum(case when list_has_any([x <> 0 for x in v], [true]) then 1 else 0 end) as bigint) as rows_set, max(pos) = max(n) - 1 as last_real from sq group by 1, 2")
def ragged_counts(spark, sf_dir):
    t = tok_emb(spark, sf_dir)
    set_ = reassemble.flags(F.exists("values", lambda x: x != 0))
    return t.groupBy("request_id", "layer_no").agg(set_.alias("rows_set"), (F.max("pos") == F.count("*") - 1).alias("last_real"))


@query("segment_bytes", f"with {TOK} select request_id, cast(sum(len(v) * 4) as bigint) as bytes from tok group by 1")
def segment_bytes(spark, sf_dir):
    return tok_emb(spark, sf_dir).groupBy("request_id").agg(F.sum(F.size("values") * 4).alias("bytes"))


@query("duplicate_keys", f"with {REF} select request_id, layer_no, pos, count(*) as copies from ref group by 1, 2, 3 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return reassemble.duplicate_keys(ref_emb(spark, sf_dir), ROW)


@query("inventory_missing", f"with {REF} select request_id, layer_no, pos from tok where not exists (select 1 from ref where ref.vec_id = tok.vec_id)")
def inventory_missing(spark, sf_dir):
    return tok_emb(spark, sf_dir).join(ref_emb(spark, sf_dir), ROW, "left_anti").select(*ROW)


@query("inventory_unexpected", f"with {REF} select request_id, layer_no, pos from ref where not exists (select 1 from tok where tok.vec_id = ref.vec_id and tok.vec_id % 5 <> 1)")
def inventory_unexpected(spark, sf_dir):
    return ref_emb(spark, sf_dir).join(tok_emb(spark, sf_dir).where("vec_id % 5 <> 1"), ROW, "left_anti").select(*ROW)


@query("value_compare", f"with {REF} select tok.request_id, tok.layer_no, tok.pos, len(tok.v) = len(r0.v) as shape_ok, tok.v = r0.v as equal from tok join r0 using (vec_id)")
def value_compare(spark, sf_dir):
    return pairing.compare(tok_emb(spark, sf_dir), ref_emb(spark, sf_dir).dropDuplicates(ROW), ROW)


@query("max_abs_diff", f"with {REF}, d as (select layer_no, max(abs(x - y)) as m from (select tok.layer_no, unnest(tok.v) as x, unnest(r0.v) as y from tok join r0 using (vec_id)) group by 1) select layer_no, round(m, 9) as max_diff, m <= 0.01 as passed from d")
def max_abs_diff(spark, sf_dir):
    d = analytics.differences(tok_emb(spark, sf_dir).select(*ROW, "values"), ref_emb(spark, sf_dir).dropDuplicates(ROW).select(*ROW, "values"), ROW)
    return d.groupBy("layer_no").agg(F.max("diff").alias("m")).select("layer_no", F.round("m", 9).alias("max_diff"), (F.col("m") <= 0.01).alias("passed"))


@query("argmax_diff", f"with {REF}, d as (select request_id, layer_no, pos, cast(c as int) as col, round(abs(x - y), 9) as diff from (select tok.request_id, tok.layer_no, tok.pos, unnest(tok.v) as x, unnest(r0.v) as y, unnest(range(64)) as c from tok join r0 using (vec_id))), r as (select *, row_number() over (partition by layer_no, request_id order by diff desc, pos, col) as k from d) select request_id, layer_no, pos, col, diff from r where k = 1")
def argmax_diff(spark, sf_dir):
    d = analytics.differences(tok_emb(spark, sf_dir).select(*ROW, "values"), ref_emb(spark, sf_dir).dropDuplicates(ROW).select(*ROW, "values"), ROW)
    return analytics.first_largest(d.withColumn("diff", F.round("diff", 9)), ["layer_no", "request_id"], ["pos", "col"])


@query("resid_norm", f"with {TOK} select layer_no, request_id, pos, round(sqrt(list_sum([x * x for x in v])), 9) as norm from tok")
def resid_norm(spark, sf_dir):
    return tok_emb(spark, sf_dir).select("layer_no", "request_id", "pos", F.round(analytics.norm(F.col("values")), 9).alias("norm"))


@query("masked_mean_norm", f"with {TOK} select layer_no, round(avg(sqrt(list_sum([x * x for x in v]))), 9) as mean_norm, count(*) as tokens from tok where pos < 9 group by 1")
def masked_mean_norm(spark, sf_dir):
    t = tok_emb(spark, sf_dir).where("pos < 9").select("layer_no", analytics.norm(F.col("values")).alias("norm"))
    return t.groupBy("layer_no").agg(F.round(F.avg("norm"), 9).alias("mean_norm"), F.count("*").alias("tokens"))


_LSE = LOGITS + ", ls as (select request_id, pos, max(x) + ln(sum(exp(x - m))) as lse, max(x) as top from (select *, max(x) over (partition by request_id, pos) as m from lx) group by request_id, pos, m)"


@query("top1_prob", f"with {_LSE} select request_id, pos, round(exp(top - lse), 9) as p from ls")
def top1_prob(spark, sf_dir):
    return logits(spark, sf_dir).select("request_id", "pos", F.round(analytics.top1_probability(F.col("values")), 9).alias("p"))


@query("logprob_rank", f"with {_LSE}, c as (select * from lx where k = chosen) select c.request_id, c.pos, c.chosen, round(c.x - lse, 9) as logprob, (select count(*) from lx where lx.request_id = c.request_id and lx.pos = c.pos and lx.x > c.x) + 1 as rank from c join ls using (request_id, pos)")
def logprob_rank(spark, sf_dir):
    v = F.col("values")
    return logits(spark, sf_dir).select("request_id", "pos", "chosen", F.round(analytics.log_probability(v, F.col("chosen")), 9).alias("logprob"), analytics.rank_of(v, F.col("chosen")).cast("long").alias("rank"))


@query("topk_alternatives", f"with {_LSE}, r as (select request_id, pos, k, x, row_number() over (partition by request_id, pos order by x desc, k) as rank from lx) select r.request_id, r.pos, rank, k as token, round(x - lse, 9) as logprob from r join ls using (request_id, pos) where rank <= 10")
def topk_alternatives(spark, sf_dir):
    g = logits(spark, sf_dir).withColumn("lse", analytics.log_sum_exp(F.col("values")))
    return analytics.top_k(g, ["request_id", "pos", "lse"], 10).select("request_id", "pos", "rank", "token", F.round(F.col("value") - F.col("lse"), 9).alias("logprob"))


@query("topk_logits", f"with {LOGITS}, r as (select request_id, pos, k, x, row_number() over (partition by request_id, pos order by x desc, k) as rank from lx) select request_id, pos, rank, k as token, x as value from r where rank <= 5")
def topk_logits(spark, sf_dir):
    return analytics.top_k(logits(spark, sf_dir), ["request_id", "pos"], 5)


@query("greedy_argmax", f"with {LOGITS}, r as (select request_id, pos, k, row_number() over (partition by request_id, pos order by x desc, k) as rank from lx) select request_id, pos, k as token from r where rank = 1")
def greedy_argmax(spark, sf_dir):
    return logits(spark, sf_dir).select("request_id", "pos", analytics.argmax(F.col("values")).alias("token"))


@query("logit_token_align", f"with {LOGITS}, t as (select request_id, pos, (vec_id * 7 + 3) % 64 as token from tok where layer_no = 0) select lg.request_id, lg.pos, t.token, v[t.token + 1] as logit from lg join t on t.request_id = lg.request_id and t.pos = lg.pos + 1")
def logit_token_align(spark, sf_dir):
    a = pairing.shifted(logits(spark, sf_dir), token_ids(spark, sf_dir).select("request_id", "pos", "token"), ["request_id"], 1)
    return a.select("request_id", "pos", "token", F.get("values", F.col("token").cast("int")).alias("logit"))


@query("logprob_diff", "with d as (select user_id, abs(value - (value + (event_id % 3) * 0.5)) as d, event_id % 4 = 0 as other from events) select user_id, cast(sum(case when other then 1 else 0 end) as bigint) as different, round(max(d), 9) as max_abs, round(avg(d), 9) as mean_abs from d group by 1")
def logprob_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "value")
    a = e.select("user_id", "event_id", (F.col("event_id") % 8).alias("token"), F.col("value").alias("lp"))
    b = e.select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, -1).otherwise(F.col("event_id") % 8).alias("token"), (F.col("value") + (F.col("event_id") % 3) * 0.5).alias("lp"))
    return pairing.logprob_difference(a, b, ["user_id", "event_id"], ["user_id"])


@query("check_tally", "select count(*) filter (where value > 20) as passed, count(*) filter (where not (value > 20)) as failed, event_type from events group by event_type")
def check_tally(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "value").withColumn("passed_", F.col("value") > 20)
    return e.groupBy("event_type").agg(F.count_if("passed_").alias("passed"), F.count_if(~F.col("passed_")).alias("failed"))


@query("bench_stats", f"with {BENCH} select mode, batch_size, round(avg(total_ms), 9) as mean, round(coalesce(stddev_samp(total_ms), 0), 9) as stdev, min(total_ms) as min, max(total_ms) as max, count(*) as n from br group by 1, 2")
def bench_stats(spark, sf_dir):
    s = reports.mode_statistics(bench_runs(spark, sf_dir), ["mode", "batch_size"], "total_ms")
    return s.withColumn("mean", F.round("mean", 9)).withColumn("stdev", F.round("stdev", 9))


@query("mode_overhead", f"with {BENCH}, s as (select mode, avg(total_ms) as mean from br group by 1) select s.mode, round(s.mean, 9) as mean, round(100 * (s.mean - b.mean) / b.mean, 9) as overhead_pct from s, (select mean from s where mode = 'signup') b")
def mode_overhead(spark, sf_dir):
    s = reports.mode_statistics(bench_runs(spark, sf_dir), ["mode"], "total_ms")
    return reports.overhead(s, "signup").withColumn("mean", F.round("mean", 9))


@query("generate_timings", f"with {BENCH} select iter, round(case when total_ms > 0 then 1000 * batch_size * 16 / total_ms end, 6) as e2e_tok_s, round(case when iter % 5 > 0 then total_ms / (iter % 5) end, 6) as tpot_ms from br")
def generate_timings(spark, sf_dir):
    b = bench_runs(spark, sf_dir)
    return b.select("iter", F.round(reports.rate(1000 * F.col("batch_size") * 16, F.col("total_ms")), 6).alias("e2e_tok_s"), F.round(reports.rate(F.col("total_ms"), F.col("iter") % 5), 6).alias("tpot_ms"))


@query("tokens_per_s", f"with {BENCH} select mode, batch_size, round(case when sum(case when iter % 7 = 0 then 0 else total_ms end) > 0 then sum(batch_size * 16) / sum(case when iter % 7 = 0 then 0 else total_ms end) * 1000 end, 6) as tok_s from br group by 1, 2")
def tokens_per_s(spark, sf_dir):
    t = bench_runs(spark, sf_dir).groupBy("mode", "batch_size").agg(F.sum(F.col("batch_size") * 16).alias("tokens"), F.sum(F.when(F.col("iter") % 7 == 0, 0).otherwise(F.col("total_ms"))).alias("ms"))
    return t.select("mode", "batch_size", F.round(reports.rate(F.col("tokens"), F.col("ms")) * 1000, 6).alias("tok_s"))


@query("rss_sum", "select ts, round(sum(value), 6) as rss_mb, count(distinct user_id) as pids from events group by ts")
def rss_sum(spark, sf_dir):
    return read(spark, sf_dir, "events", "ts", "value", "user_id").groupBy("ts").agg(F.round(F.sum("value"), 6).alias("rss_mb"), F.countDistinct("user_id").alias("pids"))


@query("profile_summary", "with u as (select 'value' as k, value as x from events union all select 'user', user_id from events) select k, round(avg(x), 6) as avg, min(x) as min, max(x) as max, round(sum(x), 4) as total from u group by 1")
def profile_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events", "value", "user_id").select(F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user"))
    u = e.unpivot([], ["value", "user"], "k", "x")
    return u.groupBy("k").agg(F.round(F.avg("x"), 6).alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.sum("x"), 4).alias("total"))


@query("range_semi_join", f"with {KERNELS} select start, duration, name from kn where exists (select 1 from nv where mode = 'decode' and start between lo and hi)")
def range_semi_join(spark, sf_dir):
    return reports.in_windows(kernels(spark, sf_dir), nvtx(spark, sf_dir).where("mode = 'decode'")).select("start", "duration", "name")


@query("kernel_breakdown", f"with {KERNELS}, i as (select name, cast(sum(duration) as bigint) as total, count(*) as calls from kn where exists (select 1 from nv where start between lo and hi) group by 1) select name, total, calls, round(100.0::double * total / (select sum(total) from i), 9) as share from i order by total desc, name limit 20")
def kernel_breakdown(spark, sf_dir):
    return reports.kernel_breakdown(kernels(spark, sf_dir), nvtx(spark, sf_dir))


@query("memcpy_breakdown", f"with {KERNELS} select case line % 3 when 0 then 1 when 1 then 2 else 8 end as kind, cast(sum(duration) as bigint) as total_ns, count(*) as ops, round(sum(bytes) / 1e6, 9) as mb, round(sum(bytes) / greatest(sum(duration), 1)::double, 9) as gb_per_s from kn group by 1")
def memcpy_breakdown(spark, sf_dir):
    kind = F.when(F.col("line") % 3 == 0, 1).when(F.col("line") % 3 == 1, 2).otherwise(8)
    return reports.memcpy_breakdown(kernels(spark, sf_dir).withColumn("kind", kind))


@query("dict_lookup_default", f"with {KERNELS}, k as (select line, name, count(*) as n from kn group by 1, 2) select line, name, n, coalesce(n_name, cast(line + 20 as varchar)) as label from k left join nation on n_nationkey = line + 20")
def dict_lookup_default(spark, sf_dir):
    k = kernels(spark, sf_dir).groupBy("line", "name").agg(F.count("*").alias("n")).withColumn("id", F.col("line") + 20)
    names = read(spark, sf_dir, "nation", F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return pairing.lookup(k, names, "id", "n_name").select("line", "name", "n", "label")


@query("overlap_join", f"with {TOK}, q as (select event_id, '0:' || (event_id % 12) as request_id, event_id % 6 as lo, event_id % 6 + 3 as hi from events), s as (select request_id, layer_no, start_token_idx, end_token_idx, count(*) as n from tok group by all) select event_id, layer_no, start_token_idx, n from q join s using (request_id) where start_token_idx < hi and end_token_idx > lo")
def overlap_join(spark, sf_dir):
    q = read(spark, sf_dir, "events", "event_id")
    q = q.select("event_id", F.concat(F.lit("0:"), F.col("event_id") % 12).alias("request_id"), (F.col("event_id") % 6).alias("lo"), (F.col("event_id") % 6 + 3).alias("hi"))
    s = tok_emb(spark, sf_dir).groupBy("request_id", "layer_no", "start_token_idx", "end_token_idx").agg(F.count("*").alias("n"))
    return pairing.overlapping(q, s, ["request_id"], ("lo", "hi"), ("start_token_idx", "end_token_idx")).select("event_id", "layer_no", "start_token_idx", "n")


@query("ref_join_by_local_idx", f"with {TOK}, r as (select distinct cast(split_part(request_id, ':', 2) as int) as idx, request_id from tok) select request_id, idx, n_name, n_name is null as out_of_range from r left join nation on n_nationkey = idx * 3")
def ref_join_by_local_idx(spark, sf_dir):
    r = tok_emb(spark, sf_dir).select("request_id").distinct().withColumn("idx", F.element_at(F.split("request_id", ":"), 2).cast("int"))
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return r.join(n, F.col("n_nationkey") == F.col("idx") * 3, "left").select("request_id", "idx", "n_name", F.col("n_name").isNull().alias("out_of_range"))


@query("fifo_pair", "select event_id as seq, user_id, l_quantity as payload from events join (select l_orderkey * 8 + l_linenumber as seq, min(l_quantity) as l_quantity from lineitem group by 1) p on p.seq = event_id")
def fifo_pair(spark, sf_dir):
    meta = read(spark, sf_dir, "events", F.col("event_id").cast("long").alias("seq"), "user_id")
    pay = read(spark, sf_dir, "lineitem", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"), "l_quantity").groupBy("seq").agg(F.min("l_quantity").alias("payload"))
    return pairing.paired(meta, pay, "seq")


@query("expand_requests", "with s as (select event_id as step, event_id % 3 + 1 as n from events) select step, cast(i as int) as ord, 'g' || (step % 4) || ':' || i as req_id, step % 7 as lo, step % 7 + 1 + i as hi from s, unnest(range(n)) u(i)")
def expand_requests(spark, sf_dir):
    e = read(spark, sf_dir, "events", F.col("event_id").cast("long").alias("step"))
    s = F.col("step")
    requests = F.transform(F.sequence(F.lit(0), (s % 3).cast("int")), lambda i: F.struct(i.alias("ord"), F.concat(F.lit("g"), s % 4, F.lit(":"), i).alias("req_id"), (s % 7).alias("lo"), (s % 7 + 1 + i).alias("hi")))
    return pairing.expanded(e.withColumn("requests", requests), ["step"])


@query("slice_batched", f"with {TOK}, w as (select *, max(pos) over (partition by request_id, layer_no) as m from tok) select request_id, layer_no, pos, v[1] as first from w where pos > m - 2")
def slice_batched(spark, sf_dir):
    t = tok_emb(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("request_id", "layer_no")))
    return pairing.last_rows(t, "pos", "n", F.lit(2)).select("request_id", "layer_no", "pos", F.get("values", F.lit(0)).alias("first"))


@query("slice_packed", "with s as (select event_id, user_id, event_id % 4 as n, coalesce(cast(sum(event_id % 4) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as bigint), 0) as dim0 from events) select event_id, user_id, dim0, n from s where n > 0 and dim0 + n <= 20")
def slice_packed(spark, sf_dir):
    from ..operators.steps import exclusive_sum

    e = read(spark, sf_dir, "events", "event_id", "user_id").withColumn("n", F.col("event_id") % 4)
    return e.withColumn("dim0", exclusive_sum("n", ["user_id"], ["event_id"])).where(pairing.packed_ok(F.col("dim0"), F.col("n"), F.lit(20))).select("event_id", "user_id", "dim0", "n")


@query("logits_range", f"with {STEPS} select step, slot, case when range_end - range_start > 1 then range_end - 1 else range_start end as lo, range_end as hi from rg")
def logits_range(spark, sf_dir):
    from .selection_queries import _ranges

    return _ranges(spark, sf_dir).select("step", "slot", pairing.logits_start(F.col("range_start"), F.col("range_end"), F.lit(1)).alias("lo"), F.col("range_end").alias("hi"))


@query("prefix_strip", f"with {TOK} select vec_id, round(list_sum(v[1:least(64, vec_id % 80)]), 9) as s, least(64, vec_id % 80) as n from tok where vec_id % 80 > 0")
def prefix_strip(spark, sf_dir):
    t = tok_emb(spark, sf_dir).where("vec_id % 80 > 0").withColumn("kept", tensors.prefix_strip(F.col("values"), (F.col("vec_id") % 80).cast("int"), 1, 64))
    return t.select("vec_id", F.round(F.aggregate("kept", F.lit(0.0), lambda a, x: a + x), 9).alias("s"), F.size("kept").cast("long").alias("n"))


@query("chunked_strip", f"with {TOK} select vec_id, round(list_sum(v[1:1 + vec_id % 16] || v[17:17 + vec_id % 9] || v[33:33 + vec_id % 5] || v[49:49 + vec_id % 3]), 9) as s from tok")
def chunked_strip(spark, sf_dir):
    i = F.col("vec_id")
    counts = F.array(*[(1 + i % m).cast("int") for m in (16, 9, 5, 3)])
    kept = tensors.chunked_strip(F.col("values"), counts, 16)
    return tok_emb(spark, sf_dir).select("vec_id", F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 9).alias("s"))


#: Limits of the flush rule, as in the SQL below it.
FLUSH = {"max_items": 24, "ratio": 0.8, "capacity": 1000, "timeout_s": 600}
_ARRIVALS = "ev as (select event_id as seq, cast(user_id % 8 as bigint) as queue, cast(1 + event_id % 97 as bigint) as bytes, row_number() over (partition by user_id % 8 order by event_id) as rn from events)"
_FLUSH = f"""recursive {_ARRIVALS},
  r as (select queue, rn, seq, bytes, cast(0 as bigint) as batch, cast(1 as bigint) as items, bytes as total, seq as oldest from ev where rn = 1
    union all select queue, rn, seq, bytes, b + batch, case when b = 1 then 1 else items + 1 end, case when b = 1 then bytes else total + bytes end, case when b = 1 then seq else oldest end
    from (select e.queue, e.rn, e.seq, e.bytes, r.batch, r.items, r.total, r.oldest, case when r.items >= 24 or r.total >= 800 or r.seq - r.oldest >= 600 then 1 else 0 end as b from r join ev e on e.queue = r.queue and e.rn = r.rn + 1))"""


@query("flush_batches", f"with {_FLUSH} select queue, batch, count(*) as n, min(seq) as first, max(seq) as last, cast(sum(bytes) as bigint) as bytes from r group by queue, batch")
def flush_batches(spark, sf_dir):
    from ..streaming.delivery import flush_groups

    e = read(spark, sf_dir, "events", F.col("event_id").cast("long").alias("seq"), (F.col("user_id") % 8).cast("long").alias("queue"), (1 + F.col("event_id") % 97).cast("long").alias("bytes"))
    f = flush_groups(e.withColumn("at", F.col("seq")), **FLUSH)
    return f.groupBy("queue", "batch").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("bytes").alias("bytes"))


_PACK = f"""recursive {_ARRIVALS},
  r as (select queue, rn, seq, bytes, cast(0 as bigint) as batch, cast(1 as bigint) as items, bytes as total from ev where rn = 1
    union all select queue, rn, seq, bytes, b + batch, case when b = 1 then 1 else items + 1 end, case when b = 1 then bytes else total + bytes end
    from (select e.queue, e.rn, e.seq, e.bytes, r.batch, r.items, r.total, case when r.items >= 32 or r.total + e.bytes > 1000 then 1 else 0 end as b from r join ev e on e.queue = r.queue and e.rn = r.rn + 1))"""


@query("batch_pack", f"with {_PACK} select queue, seq, bytes, batch from r")
def batch_pack(spark, sf_dir):
    from ..streaming.delivery import greedy_batches

    e = read(spark, sf_dir, "events", F.col("event_id").cast("long").alias("seq"), (F.col("user_id") % 8).cast("long").alias("queue"), (1 + F.col("event_id") % 97).cast("long").alias("bytes"))
    return greedy_batches(e, max_items=32, max_bytes=1000)


def _stored(spark, sf_dir):
    """A store of its own, with the token rows of the fixture as captured segments."""
    from ..shared import scratch
    from ..sources.codec import segments
    from ..sources.store import CaptureStore

    store = CaptureStore(spark, scratch(spark, "store") + "/captures")
    store.create()
    store.insert(segments(tok_emb(spark, sf_dir).drop("vec_id")))
    return store


@query("store_field", f"with {_SEQL}, g as (select request_id, layer_no, n, lw, unnest(range(lw)) as slot from (select distinct request_id, layer_no, n from sq) join wl using (layer_no)) select g.request_id, g.layer_no, slot, coalesce(v[1], 0) as first, coalesce(v[64], 0) as last from g left join sq on sq.request_id = g.request_id and sq.layer_no = g.layer_no and sq.seq = slot - (lw - g.n)")
def store_field(spark, sf_dir):
    """Segments written to a store, read back by slot and act, decoded to token rows, reassembled by field."""
    from ..api import make_lazy_internal, store_reader

    p = make_lazy_internal(store_reader(_stored(spark, sf_dir), "run0"), "run0").hidden_states
    return p.select("request_id", "layer_no", "slot", *[F.coalesce(F.get("values", F.lit(i)), F.lit(0.0)).alias(n) for i, n in ((0, "first"), (63, "last"))])


@query("store_prefix", f"with {TOK} select layer_no, start_token_idx, end_token_idx, pos, v[1] as first from tok where request_id = '0:3' and act_name = 'blocks.hook_resid_pre'")
def store_prefix(spark, sf_dir):
    """A key prefix over the store: one partition, and row groups by statistics."""
    from ..sources.codec import token_rows
    from ..sources.store import prefix_get

    t = token_rows(prefix_get(_stored(spark, sf_dir).read(), ("run0", "0:3", "blocks.hook_resid_pre")))
    return t.select("layer_no", "start_token_idx", "end_token_idx", "pos", F.get("values", F.lit(0)).alias("first"))


_CAPTURES = "ca as (select request_id, layer_no, start_token_idx, end_token_idx, count(*) as n, list(v order by pos) as v from tok group by all), cb as (select request_id, layer_no, start_token_idx, end_token_idx, count(*) as n, list(v order by pos) as v from r0 group by all)"


@query("capture_compare", f"with {REF}, {_CAPTURES} select request_id, layer_no, start_token_idx, end_token_idx, true as dtype_ok, ca.n = cb.n as shape_ok, ca.v = cb.v as equal from ca join cb using (request_id, layer_no, start_token_idx, end_token_idx)")
def capture_compare(spark, sf_dir):
    """Segments as stored, by dtype, shape and bytes."""
    from ..sources.codec import segments

    a, b = (segments(t.drop("vec_id")) for t in (tok_emb(spark, sf_dir), ref_emb(spark, sf_dir).dropDuplicates(ROW)))
    return pairing.compare_captures(a, b, ["request_id", "layer_no", "start_token_idx", "end_token_idx"])
