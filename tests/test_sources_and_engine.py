"""Report files, profiler databases, token rows of stored captures, the delivery engine, adapters and hooks."""

import json
import sqlite3
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeframe import api, shared
from probeframe.adapter import CaptureAdapter
from probeframe.operators import pairing, reassemble, steps
from probeframe.plans.fixtures import SHAPE
from probeframe.schema import CAPTURES
from probeframe.sources import codec, reports, store
from probeframe.streaming.delivery import Aborted, OnFull, QueueConfig, flush_groups, longest_prefix, should_flush
from probeframe.streaming.engine import BatchQueue, Closed, Engine, Full, OnFailure, Stage


def captured(*rows):
    return [(m, r, a, y, 0, s, e, d, list(x.shape), codec.encode(d, x)) for m, r, a, y, s, e, d, x in rows]


def test_token_rows(spark):
    pattern = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)  # heads, queries, keys
    rows = captured(
        ("m", "0:0", "blocks.attn.hook_pattern", 0, 1, 4, "torch.float32", pattern), ("m", "0:0", "blocks.hook_resid_pre", 0, 0, 2, "torch.half", np.arange(6.0).reshape(2, 3)),
        ("m", "0:0", "final_logits", -1, 0, 5, "torch.float64", np.arange(4.0).reshape(1, 4)), ("m", "0:0", "token_ids", -1, 7, 9, "torch.int64", np.array([3, 4])),
        ("m", "0:1", "blocks.hook_ln1", 0, 0, 1, "torch.cfloat", np.array([[1 + 2j, 3 - 4j]])),
    )
    got = {(r["act_name"], r["pos"]): r["values"] for r in codec.token_rows(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {p for a, p in got if a.endswith("pattern")} == {1, 2, 3} and got["blocks.attn.hook_pattern", 2] == pattern[:, 1].ravel().tolist()
    assert got["blocks.hook_resid_pre", 1] == [3.0, 4.0, 5.0] and got["final_logits", 4] == [0.0, 1.0, 2.0, 3.0] and got["token_ids", 8] == [4.0]
    assert got["blocks.hook_ln1", 0] == [1.0, 2.0, 3.0, -4.0]
    with pytest.raises(Exception, match="3 tokens for"):
        codec.token_rows(spark.createDataFrame(captured(("m", "0:0", "x", 0, 0, 2, "torch.half", np.zeros((3, 1)))), CAPTURES)).collect()
    assert codec.token_rows(spark.createDataFrame([], CAPTURES)).count() == 0


def test_store_end_to_end(spark, tmp_path):
    s = store.CaptureStore(spark, f"file://{tmp_path}/captures")
    s.create()
    x = np.arange(24.0).reshape(4, 6)
    rows = captured(*[(m, f"0:{i}", "blocks.hook_resid_pre", y, 0, 4, "torch.float32", x + 100 * i + y) for m in ("a", "b") for i in range(2) for y in range(3)])
    s.insert(spark.createDataFrame(rows, CAPTURES))
    assert s.submit("a", 0, "0:0", "blocks.hook_resid_pre", 0, 4, 5, "torch.float32", [1, 6], codec.encode("torch.float32", x[:1]))
    assert not s.submit("a", 0, "0:0", "blocks.hook_resid_pre", 0, 4, 5, "torch.float32", [], b"")
    field = api.make_lazy_internal(api.store_reader(s, "a"), "a").hidden_states
    got = {(r["layer_no"], r["request_id"], r["slot"]): r["values"] for r in field.collect()}
    assert got[0, "0:0", 4] == x[0].tolist() and got[0, "0:1", 0] is None and got[0, "0:1", 1] == (x[0] + 100).tolist() and got[2, "0:1", 3] == (x[3] + 102).tolist()
    assert "hidden_states" in api.get_internal(api.store_reader(s, "a"), "a")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = store.prefix_get(s.read(), ("a", "0:1", "blocks.hook_resid_pre", 2))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(request_id,0:1)" in plan and "EqualTo(layer_no,2)" in plan and "PartitionFilters: [isnotnull(model_id" in plan
    order = [(r.request_id, r.layer_no, r.start_token_idx) for r in s.scan("a").collect()]
    assert order == sorted(order) and len(order) == 7 and "model_id" not in s.scan("a").columns
    assert s.tokens("a", ["0:1"], predicate="blocks.hook_resid_.*").count() == 12 and s.tokens("a", predicate=lambda n: n.endswith("ln1")).count() == 0
    s.discard(s.read())
    with pytest.raises(ValueError):
        store.CaptureStore(spark, "file:///x/not-a-name")
    for port in (8123, 8443, 0):
        with pytest.raises(ValueError):
            store.check_port(port)
    assert store.check_port(9000) == 9000


def test_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    store.apply_settings(spark, {"spark.sql.shuffle.partitions": 5, "spark.sql.adaptive.enabled": True})
    assert spark.conf.get("spark.sql.shuffle.partitions") == "5" and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    store.apply_settings(spark, {"spark.sql.shuffle.partitions": before})
    for bad, error in (({"spark.driver.memory": "1g"}, ValueError), ({"spark.sql.shuffle.partitions": 1.5}, TypeError)):
        with pytest.raises(error):
            store.apply_settings(spark, bad)


def test_comparison_is_bit_by_bit(spark):
    nan = [np.array([0x7FC00000], "<u4"), np.array([0x7FC00001], "<u4")]
    a, b = (spark.createDataFrame([("k", "torch.float32", [1], x.tobytes()), ("z", "torch.float32", [1], np.array([z], "<f4").tobytes())], "key string, dtype string, shape array<long>, bytes binary") for x, z in zip(nan, (0.0, -0.0), strict=True))
    assert {r.key: r.equal for r in pairing.compare_captures(a, b, ["key"]).collect()} == {"k": False, "z": False}
    assert all(r.equal and r.dtype_ok and r.shape_ok for r in pairing.compare_captures(a, a, ["key"]).collect())
    x, y = (spark.createDataFrame([(1, [z, 1.0])], "key int, values array<double>") for z in (0.0, -0.0))
    assert not pairing.compare(x, y, ["key"]).first().equal and pairing.compare(x, x, ["key"]).first().equal


def test_report_files(spark, tmp_path):
    for i, doc in enumerate([{"batch_size": 1, "prefill": {"tok_s": 5.0}}, {"batch_size": 4, "prefill": None}]):
        (tmp_path / f"summary_{i}.json").write_text(json.dumps(doc, indent=1))
    glob = f"file://{tmp_path}/summary_*.json"
    assert sorted(map(tuple, reports.read_summaries(spark, glob, "prefill").collect())) == [(1, 5.0), (4, None)]
    assert sorted(map(tuple, reports.read_summaries(spark, glob, "decode").collect())) == [(1, None), (4, None)]
    (tmp_path / "mem.csv").write_text("epoch_s,rss_mb\n1.5,10\n2.5,-1\n")
    assert list(map(tuple, reports.read_samples(spark, f"file://{tmp_path}/mem.csv").collect())) == [(1.5, 10.0), (2.5, None)]
    for n in (1, 2):
        reports.append_rows(spark.createDataFrame([(n, "x")], "n int, name string"), f"file://{tmp_path}/bench")
    assert sorted(r.n for r in spark.read.option("header", True).schema("n int, name string").csv(f"file://{tmp_path}/bench").collect()) == [1, 2]
    reports.write_results(spark.createDataFrame([("b", True), ("a", False), ("c", None)], "name string, ok boolean"), f"file://{tmp_path}/results")
    doc = spark.read.json(f"file://{tmp_path}/results").first()
    assert (doc.passed, doc.failed, [t.name for t in doc.tests]) == (1, 2, ["a", "b", "c"])


def test_profiler_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "run.sqlite")
    db.executescript("""create table StringIds (id integer, value text); insert into StringIds values (1, 'gemm'), (2, 'decode step');
    create table NVTX_EVENTS (start integer, "end" integer, text text, textId integer); insert into NVTX_EVENTS values (0, 10, null, 2), (20, 30, 'prefill step', null), (40, null, 'open', null);
    create table CUPTI_ACTIVITY_KIND_KERNEL (start integer, "end" integer, shortName integer); insert into CUPTI_ACTIVITY_KIND_KERNEL values (5, 8, 1), (25, 26, 9), (50, null, 1);
    create table CUPTI_ACTIVITY_KIND_MEMCPY (start integer, "end" integer, copyKind integer, bytes integer); insert into CUPTI_ACTIVITY_KIND_MEMCPY values (1, 3, 2, 100), (4, null, 1, 5);""")
    db.commit()
    db.close()
    path = f"file://{tmp_path}/run.sqlite"
    assert list(map(tuple, reports.profiler_windows(spark, path, "%decode%").collect())) == [("decode step", 0, 10)]
    assert sorted(map(tuple, reports.profiler_kernels(spark, path).collect())) == [("9", 25, 1), ("gemm", 5, 3)]
    assert list(map(tuple, reports.profiler_copies(spark, path).collect())) == [(2, 1, 2, 100)]


def test_flush_rules(spark):
    assert should_flush(3, 10, 0, max_items=3) and should_flush(1, 9, 0, ratio=0.9, capacity=10) and should_flush(1, 0, 5, timeout_s=5) and not should_flush(1, 8, 1, ratio=0.9, capacity=10, max_items=2)
    rows = spark.createDataFrame([(0, i, b, t) for i, (b, t) in enumerate([(5, 0), (5, 1), (1, 2), (1, 30), (9, 31)])], "queue long, seq long, bytes long, at long")
    got = {r.seq: r.batch for r in flush_groups(rows, max_bytes=10, timeout_s=20).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert longest_prefix([3, 4, 5], 7) == 2 and longest_prefix([9], 7) == 0 and longest_prefix([], 7) == 0


def test_queue():
    q = BatchQueue(QueueConfig(min_items=2, max_items=3, high_items=3, max_bytes=10))
    assert all(q.put(i, 1) for i in range(3))
    assert not q.put(9, 1, block=False, on_full=OnFull.DROP) and not q.put(9, 11, on_full=OnFull.DROP)
    with pytest.raises(Full):
        q.put(9, 1, timeout=0.01)
    with pytest.raises(Aborted):
        q.put(9, 1, block=False, on_full=OnFull.ABORT)
    with pytest.raises(Full):
        q.put(9, 1, block=False, on_full=OnFull.RETRY, retries=2, backoff_s=0.001)
    assert q.take() == [0, 1, 2] and q.take(timeout=0.01) == []
    threading.Timer(0.05, lambda: q.put(5, 1)).start()
    q.put(4, 1)
    assert q.take(timeout=5) == [4, 5]
    q.put(6, 1)
    q.close()
    with pytest.raises(Closed):
        q.put(7, 1)
    assert not q.put(7, 1, on_closed=OnFull.DROP) and q.take() == [6] and q.take() is None
    c = q.counters
    assert (c.items_in, c.items_out, c.batches, c.dropped, c.retries) == (6, 6, 3, 3, 2) and c.mean_batch() == 2.0 and BatchQueue(QueueConfig()).counters.mean_batch() == 0.0
    # bytes above the high mark wait, but an item that makes a batch due is let in
    nudged = BatchQueue(QueueConfig(min_items=0, min_bytes=100, high_items=1))
    assert nudged.put("a", 1) and nudged._full() and nudged.take() == ["a"]


def test_engine_runs_stops_and_fails():
    ended, out = [], []
    double = Stage(lambda state, batch: [2 * x for x in batch], init=lambda: "open", cleanup=ended.append, name="double")
    e = Engine([double, Stage(lambda state, batch: [x + 1 for x in batch], name="inc")], out.extend).start()
    for i in range(20):
        e.submit(i, 1)
    with pytest.raises(RuntimeError):
        e.start()
    e.stop()
    assert e.join(10) and out == [2 * i + 1 for i in range(20)] and ended == ["open"] and not e.failures()
    e.enable(False)
    assert e.submit(1, 1) is False
    e.enable(True)
    with pytest.raises(Closed):
        e.submit(1, 1)

    def fragile(state, batch):
        if 3 in batch:
            raise ValueError("three")
        return batch

    kept = []
    e = Engine([Stage(fragile, config=QueueConfig(max_items=1))], kept.extend, OnFailure.CONTINUE).start()
    for i in range(6):
        e.submit(i, 1)
    e.stop()
    assert e.join(10) and kept == [0, 1, 2, 4, 5] and e.counters()["0:stage"].dropped == 1
    with pytest.raises(ValueError):
        e.raise_if_failed()
    e = Engine([Stage(fragile, config=QueueConfig(max_items=1))]).start()
    e.submit(3, 1)
    assert e.join(10) and len(e.failures()) == 1
    with pytest.raises(Closed):
        e.submit(1, 1)
    slow = Engine([Stage(lambda state, batch: time.sleep(0.4) or batch, config=QueueConfig(max_items=1))]).start()
    for i in range(5):
        slow.submit(i, 1)
    slow.stop()
    assert not slow.join(0.1)  # past the timeout it aborts, and what is held is dropped
    assert slow.join(10) and slow.counters()["0:stage"].dropped >= 3


class Fixed(CaptureAdapter):
    capacity = 1 << 20
    told = 0

    def model_shape(self):
        return SHAPE

    def ranks(self):
        return 1, 0, 0, 0

    def is_first_stage(self):
        return True

    def is_last_stage(self):
        return False

    def steps(self, spark):
        return spark.createDataFrame([(0, i, 1, q, 16, 0, True) for i, q in enumerate([1, 2, 500])], "engine long, step long, batch int, q int, kv int, keep int, packed boolean")

    def on_capacity_exceeded(self, large):
        self.told += large.count()


def test_adapter(spark):
    assert len(CaptureAdapter.__abstractmethods__) == 6
    with pytest.raises(TypeError):
        CaptureAdapter()
    a = Fixed()
    names = {r.short_name for r in a.specs(spark, "full").collect()}
    assert names == {"q", "k", "v", "z", "attn_scores", "pattern", "mlp_post"}
    with pytest.warns(UserWarning, match="mlp_post"):
        a.specs(spark, "q,mlp_post", {"intermediate_dim": None, "num_experts": 1, "top_k": 1})
    plan = a.plan(spark, "q,k")
    assert {r.step: (r.planned, r.hooks) for r in plan.collect()}[0] == (2 * 8 * 128 + 2 * 4 * 128, 2)
    assert [(r.outcome, r.way) for r in a.reserve(plan).orderBy("step").collect()] == [(0, "ring"), (0, "ring"), (2, "direct")] and a.told == 1


def test_hooks(spark):
    t = spark.createDataFrame([("blocks.hook_ln1", [1.0]), ("blocks.attn.hook_q", [2.0])], "act_name string, values array<double>")

    def values(df):
        return {r["act_name"]: r["values"][0] for r in df.collect()}

    def add(n):
        return lambda v, act: F.transform(v, lambda x: x + n)

    def times(n):
        return lambda v, act: F.transform(v, lambda x: x * n)

    h = api.HookSet()
    assert h.add_hook("blocks.hook_ln1", add(1), is_permanent=True) == 1 and h.add_hook(lambda n: "ln" in n, times(10), prepend=True) > 1
    h.add_hook("blocks.attn.hook_q", times(3), dir="bwd")
    assert values(h.apply(t)) == {"blocks.hook_ln1": 11.0, "blocks.attn.hook_q": 2.0} and values(h.apply(t, "bwd")) == {"blocks.hook_ln1": 1.0, "blocks.attn.hook_q": 6.0}
    with h.hooks([("blocks.attn.hook_q", add(5))]):
        assert values(h.apply(t))["blocks.attn.hook_q"] == 7.0
    assert values(h.apply(t))["blocks.attn.hook_q"] == 2.0 and values(h.run_with_hooks(t, [("blocks.attn.hook_q", add(5))]))["blocks.attn.hook_q"] == 7.0
    h.reset()
    assert values(h.apply(t)) == {"blocks.hook_ln1": 2.0, "blocks.attn.hook_q": 2.0}
    h.reset(including_permanent=True)
    assert values(h.apply(t)) == {"blocks.hook_ln1": 1.0, "blocks.attn.hook_q": 2.0}
    for bad in (("nothing", add(1), "fwd"), ("blocks.hook_ln1", add(1), "side")):
        with pytest.raises(ValueError):
            h.add_hook(*bad)


def test_public_surface():
    assert api.API_VERSION == 1
    assert set(api.__all__) == {
        "API_VERSION", "BatchQueue", "CaptureAdapter", "CaptureStore", "DeliverySink", "Engine", "HookSet", "IncompleteInternalError", "LazyInternal", "MissingInternalError", "OnFailure", "OnFull", "QueueConfig",
        "Requirement", "Stage", "StepSource", "apply_hook", "custom_select", "get_internal", "is_preset_registered", "make_lazy_internal", "names_matching", "prefix_get", "register_field", "register_preset",
        "resolve_eos", "resolve_hook_selection", "store_reader", "token_rows",
    }
    assert all(hasattr(api, n) for n in api.__all__) and len(api.__all__) == len(set(api.__all__))
    assert api.resolve_eos(None, np.array([[2], [3]])) == {2, 3} and api.resolve_eos(np.array(5)) == {5} and api.resolve_eos(None) == frozenset()


def test_whole_layers(spark):
    t = spark.createDataFrame([(0, 1.0), (2, 1.0), (-1, 1.0)], "layer_no int, x double")
    assert reassemble.whole_layers(t, 3) is None and reassemble.whole_layers(t.where("layer_no < 1"), 1).count() == 2


def test_left_padding_and_scratch(spark):
    s = spark.createDataFrame([(0, True, 3, 8), (1, False, 1, 8)], "step long, prefill boolean, real_len int, width int")
    assert [r.real_len for r in steps.real_lengths(s, strip_left=False).orderBy("step").collect()] == [8, 1] and steps.real_lengths(s) is s
    path = shared.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    assert shared.delete(spark, path) and not shared.delete(spark, path)
