"""Captures, step logs and run reports derived from the test tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EOS = [2, 7, 11]
SHAPE = {"hidden_dim": 1024, "num_heads": 16, "num_kv_heads": 8, "head_dim": 128, "vocab_size": 151936, "intermediate_dim": 2816, "num_experts": 60, "top_k": 4, "tp_size": 2}


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def tok_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows of four layers and twelve ragged requests; the first four positions are one chunk."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    e = e.select("vec_id", (F.col("vec_id") % 4).cast("int").alias("layer_no"), F.expr("vec_id div 4").alias("u"), F.col("embedding").cast("array<double>").alias("values"))
    e = e.withColumn("pos", F.expr("cast(u div 12 as int)"))
    start = F.when(F.col("pos") < 4, 0).otherwise(F.col("pos"))
    return e.select(
        F.lit("run0").alias("model_id"), F.concat(F.lit("0:"), F.col("u") % 12).alias("request_id"), F.lit("blocks.hook_resid_pre").alias("act_name"), "layer_no", F.lit(0).alias("shard_rank"),
        start.alias("start_token_idx"), F.when(F.col("pos") < 4, 4).otherwise(F.col("pos") + 1).alias("end_token_idx"), "pos", "values", "vec_id",
    )


TOK = """tok as (select 'run0' as model_id, '0:' || ((vec_id // 4) % 12) as request_id, 'blocks.hook_resid_pre' as act_name, cast(vec_id % 4 as int) as layer_no, 0 as shard_rank,
  cast(case when (vec_id // 4) // 12 < 4 then 0 else (vec_id // 4) // 12 end as int) as start_token_idx,
  cast(case when (vec_id // 4) // 12 < 4 then 4 else (vec_id // 4) // 12 + 1 end as int) as end_token_idx,
  cast((vec_id // 4) // 12 as int) as pos, cast(embedding as double[]) as v, vec_id from embeddings)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last layer's rows as scores over a vocabulary of 64, with a chosen token."""
    return tok_emb(spark, sf_dir).where("layer_no = 3").withColumn("chosen", (F.col("vec_id") * 7 + 3) % 64)


LOGITS = TOK + ", lg as (select *, (vec_id * 7 + 3) % 64 as chosen from tok where layer_no = 3), lx as (select request_id, pos, chosen, unnest(v) as x, unnest(range(64)) as k from lg)"


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of attention scores: one for each query and head, as wide as its chunk; keys after the query are minus infinity."""
    t = tok_emb(spark, sf_dir).where("layer_no = 0").withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(3))))
    row = F.transform(F.sequence(F.lit(0), F.col("end_token_idx") - 1), lambda k: F.when(k <= F.col("pos"), F.get("values", (F.col("head") * 16 + k) % 64)).otherwise(float("-inf")))
    return t.select("request_id", "head", F.col("pos").alias("query"), F.col("end_token_idx").alias("keys"), row.alias("row"))


ATTENTION = TOK + """, att as (select request_id, h as head, pos as query, end_token_idx as keys, k as key, case when k <= pos then v[(h * 16 + k) % 64 + 1] else '-inf'::double end as x
  from tok, unnest(range(4)) a(h), unnest(range(end_token_idx)) b(k) where layer_no = 0),
  aw as (select request_id, max(query) + 1 as n from att group by 1), ax as (select request_id, max(n) as width from aw group by 1)"""


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok_emb(spark, sf_dir).where("layer_no = 0").withColumn("token", (F.col("vec_id") * 7 + 3) % 64)


def ref_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison side: shifted a little, some rows missing, some twice."""
    t = tok_emb(spark, sf_dir)
    t = t.withColumn("values", F.transform("values", lambda x: x + F.lit(0.001) * (F.col("vec_id") % 3))).where("vec_id % 50 <> 0")
    return t.union(t.where("vec_id % 97 = 0"))


REF = TOK + ", r0 as (select * replace (list_transform(v, lambda x: x + 0.001::double * (vec_id % 3)) as v) from tok where vec_id % 50 <> 0), ref as (select * from r0 union all select * from r0 where vec_id % 97 = 0)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot for each user; signup is a prefill, error feeds an end token."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return e.select(
        F.col("event_id").cast("long").alias("step"), F.col("user_id").cast("long").alias("slot"), (F.col("event_type") == "signup").alias("prefill"), F.lit(1).alias("batch"),
        (1 + F.col("event_id") % 5).alias("real_len"), F.when(F.col("event_type") == "error", 2).otherwise(5).alias("fed_token"),
    )


STEPS = """st as (select cast(event_id as bigint) as step, cast(user_id as bigint) as slot, event_type = 'signup' as prefill, 1 + event_id % 5 as real_len, case when event_type = 'error' then 2 else 5 end as fed_token from events),
  sg as (select *, cast(sum(case when prefill or rn = 1 then 1 else 0 end) over (partition by slot order by step) as bigint) - 1 as grp from (select *, row_number() over (partition by slot order by step) as rn from st)),
  sl as (select *, max(case when not prefill and fed_token in (2, 7, 11) then 1 else 0 end) over (partition by slot, grp order by step) as fin from sg),
  sr as (select *, case when fin = 1 then 0 when prefill then real_len else 1 end as n from sl),
  rg as (select *, cast(sum(n) over (partition by slot, grp order by step) as bigint) as range_end, cast(sum(n) over (partition by slot, grp order by step) as bigint) - n as range_start from sr)"""


def batch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return e.select(F.col("event_id").cast("long").alias("step"), (F.col("user_id") % 4).cast("long").alias("engine"), (1 + (F.col("event_id") % 7) % 3).alias("batch"), (F.col("event_type") == "signup").alias("prefill"))


BATCH_STEPS = "bs as (select cast(event_id as bigint) as step, cast(user_id % 4 as bigint) as engine, 1 + (event_id % 7) % 3 as batch, event_type = 'signup' as prefill from events)"


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return e.select(F.col("event_type").alias("mode"), F.expr("cast(shiftleft(1, cast(user_id % 4 as int)) as bigint)").alias("batch_size"), F.col("value").cast("double").alias("total_ms"), F.col("event_id").cast("long").alias("iter"))


BENCH = "br as (select event_type as mode, cast(1 << cast(user_id % 4 as int) as bigint) as batch_size, cast(value as double) as total_ms, cast(event_id as bigint) as iter from events)"


def nvtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation", "n_nationkey")
    return n.select(F.when(F.col("n_nationkey") % 2 == 0, "decode").otherwise("prefill").alias("mode"), (F.col("n_nationkey") * 100).cast("long").alias("lo"), (F.col("n_nationkey") * 100 + 40).cast("long").alias("hi"))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    return k.select(
        ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7) % 2500).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("duration"), F.col("l_returnflag").alias("name"),
        F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").cast("long").alias("bytes"),
    )


KERNELS = """nv as (select case when n_nationkey % 2 = 0 then 'decode' else 'prefill' end as mode, n_nationkey * 100 as lo, n_nationkey * 100 + 40 as hi from nation),
  kn as (select (l_orderkey * 13 + l_linenumber * 7) % 2500 as start, cast(l_quantity as bigint) as duration, l_returnflag as name, cast(l_linenumber as bigint) as line, cast(l_partkey as bigint) as bytes from lineitem)"""
