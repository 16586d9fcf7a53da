"""Published vectors, the store and its codec, delivery rules, and the stream against the batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeframe.functions import catalog, shapes
from probeframe.operators import pairing, reassemble, steps
from probeframe.plans import fixtures
from probeframe.schema import CAPTURES, KEY
from probeframe.sources import codec, store
from probeframe.streaming import delivery
from probeframe.streaming.steps import step_ranges

CONFIG = {"hidden_dim": 1024, "num_heads": 16, "num_kv_heads": 8, "head_dim": 128, "vocab_size": 50000, "intermediate_dim": 2816, "num_experts": 60, "top_k": 4}


def test_selection():
    assert catalog.resolve_hook_selection("hf-only") == {catalog.BY_SHORT[x] for x in ("resid_pre", "final_ln", "pattern", "final_logits")}
    assert catalog.resolve_hook_selection(" logits , q,") == {catalog.BY_SHORT["final_logits"], catalog.BY_SHORT["q"]}
    assert len(catalog.resolve_hook_selection("full")) == 23
    for bad in ("", " , ", "nope"):
        with pytest.raises(ValueError):
            catalog.resolve_hook_selection(bad)
    catalog.register_preset("mine", [1, 2])
    assert catalog.is_preset_registered("mine") and catalog.resolve_hook_selection("mine,q") == {1, 2, 6}
    with pytest.raises(ValueError):
        catalog.register_preset("full", [])


def test_schedules(spark):
    ids = spark.range(12).withColumn("phase", F.lit("decode"))
    requests = catalog.CaptureSchedule(warmup_requests=2, request_offset=1, request_stride=3)
    assert [r.id for r in ids.where("id < 7").where(requests.captures_request(F.col("id"))).collect()] == [3, 6]
    every = catalog.CaptureSchedule(warmup_steps=5, step_offset=2, step_stride=4)
    assert [r.id for r in ids.where(every.captures_step(F.col("id"), F.col("phase"))).collect()] == [7, 11]
    with pytest.raises(ValueError):
        catalog.CaptureSchedule(step_stride=0)
    with pytest.raises(Exception, match="bad phase"):
        ids.where(every.captures_step(F.col("id"), F.lit("other"))).collect()


@pytest.mark.parametrize(
    ("kind", "tp", "packed", "want"),
    [(1, 1, True, [10, 16, 128]), (1, 1, False, [4, 10, 16, 128]), (3, 1, True, [10, 2048]), (2, 2, True, [10, 4, 128]), (2, 16, True, [10, 1, 128]), (4, 2, True, [8, 10, 256]), (8, 1, True, [10, 60]), (9, 1, True, [10, 4]), (6, 1, False, [4, 10]), (99, 1, True, [])],
)
def test_shapes(spark, kind, tp, packed, want):
    lit = F.lit
    shape = shapes.hook_shape(lit(kind), CONFIG | {"tp_size": tp}, lit(4), lit(10), lit(256), lit(0), lit(packed))
    assert spark.range(1).select(shape.alias("s")).first().s == want


def step_rows(spark, lengths, feeds, eos, strip=True):
    rows = [(0, i, True, len(lengths), n, -1) for i, n in enumerate(lengths)]
    rows += [(k + 1, i, False, len(lengths), 0, t) for k, f in enumerate(feeds) for i, t in enumerate(f)]
    df = spark.createDataFrame(rows, "step long, slot long, prefill boolean, batch int, real_len long, fed_token long")
    out = steps.token_ranges(steps.latched(steps.group_ids(df, engine="slot"), eos, ["slot", "grp"], strip=strip), ["slot", "grp"])
    got = {(r.step, r.slot): (r.range_start, r.range_end) for r in out.collect()}
    return [[got[k, i] for i in range(len(lengths))] for k in range(len(feeds) + 1)]


def test_end_of_sequence_vectors(spark):
    feeds = [[2, 100, 200], [0, 101, 201], [0, 102, 202]]
    assert step_rows(spark, [1, 3, 4], feeds, [2]) == [[(0, 1), (0, 3), (0, 4)], [(1, 1), (3, 4), (4, 5)], [(1, 1), (4, 5), (5, 6)], [(1, 1), (5, 6), (6, 7)]]
    assert step_rows(spark, [1, 3, 4], feeds[:1], [2], strip=False)[1] == [(1, 2), (3, 4), (4, 5)]
    assert step_rows(spark, [1, 2], [[2, 5]], [])[1] == [(1, 2), (2, 3)]
    assert step_rows(spark, [1, 1, 1], [[2, 7, 5]], [2, 7, 11])[1] == [(1, 1), (1, 1), (1, 2)]


def test_batch_change_starts_a_group(spark):
    rows = [(0, 0, True, 3, 5, -1), (1, 0, False, 3, 0, 2), (2, 0, False, 2, 0, 9)]
    df = spark.createDataFrame(rows, "step long, slot long, prefill boolean, batch int, real_len long, fed_token long")
    out = steps.token_ranges(steps.latched(steps.group_ids(df, engine="slot"), [2], ["slot", "grp"]), ["slot", "grp"]).orderBy("step")
    assert [(r.grp, r.finished, r.range_start, r.range_end) for r in out.collect()] == [(0, False, 0, 5), (0, True, 5, 5), (1, False, 0, 1)]


def test_stream_equals_batch(spark, sf, tmp_path):
    source = fixtures.steps(spark, sf).select("step", "slot", "prefill", F.col("batch").cast("long").alias("batch"), F.col("real_len").cast("long").alias("real_len"), F.col("fed_token").cast("long").alias("fed_token"))
    for i in range(3):
        source.where((F.col("step") >= i * 334) & (F.col("step") < (i + 1) * 334)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    want = steps.token_ranges(steps.latched(steps.group_ids(source, engine="slot"), fixtures.EOS, ["slot", "grp"]), ["slot", "grp"])
    columns = ["step", "slot", "grp", "finished", "range_start", "range_end"]
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = step_ranges(stream, fixtures.EOS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(got.collect()) == sorted(want.select(*columns).collect())


def test_attention_growth(spark):
    rows = [("0:0", 0, 0, 2, [1.0, 1.0]), ("0:0", 0, 1, 2, [1.0, 1.0]), ("0:0", 0, 2, 3, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "request_id string, head int, query int, keys int, row array<double>")
    for fill in (0.0, float("-inf")):
        got = {(r.query, r.key): r.value for r in reassemble.merged_attention(df, ["request_id", "head"], fill).collect()}
        assert len(got) == 9 and got[0, 2] == fill and got[1, 2] == fill and got[2, 2] == 2.0 and got[1, 1] == 1.0


def test_left_pad_and_mask(spark):
    rows = [("0:10", 0, 0, 2, 0, [10.0]), ("0:10", 0, 0, 2, 1, [11.0]), ("0:2", 0, 0, 1, 0, [20.0])]
    df = spark.createDataFrame(rows, "request_id string, layer_no int, start_token_idx int, end_token_idx int, pos int, values array<double>")
    got = {(r.request_id, r.slot): r["values"] for r in reassemble.left_padded(df, ["request_id"], []).collect()}
    assert got == {("0:10", 0): [10.0], ("0:10", 1): [11.0], ("0:2", 0): None, ("0:2", 1): [20.0]}
    assert {r.request_id: r.batch_idx for r in reassemble.batch_index(df).collect()} == {"0:2": 0, "0:10": 1}
    ranges = spark.createDataFrame([("a", 0, 3), ("a", 3, 4), ("b", 0, 2), ("b", 2, 2)], "request_id string, range_start int, range_end int")
    mask = {(r.request_id, r.slot): r.present for r in reassemble.token_mask(ranges).collect()}
    assert [mask["a", i] for i in range(4)] == [True] * 4 and [mask["b", i] for i in range(4)] == [False, False, True, True]


def test_results_do_not_depend_on_row_order(spark, sf):
    t = fixtures.tok_emb(spark, sf)
    a = reassemble.concatenated(t, ["layer_no", "request_id"]).select("vec_id", "seq").collect()
    b = reassemble.concatenated(t.orderBy(F.rand(3)), ["layer_no", "request_id"]).select("vec_id", "seq").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("dtype", sorted([*codec.REAL, *codec.WHOLE, "torch.bfloat16", "torch.bool"]))
def test_codec_round_trip(dtype):
    values = np.array([0.0, 1.0, 0.0, 1.0]) if dtype in ("torch.bool", "torch.uint8") else np.array([0.0, 1.5, -2.0, np.inf]) if dtype in codec.REAL or dtype == "torch.bfloat16" else np.array([0.0, 1.0, -2.0, 100.0])
    payload = codec.encode(dtype, values)
    assert (codec.decode(dtype, payload) == values).all() and codec.encode(dtype, codec.decode(dtype, payload)) == payload
    with pytest.raises(ValueError):
        codec.decode("torch.float8_e5m2", b"")


def test_store(spark, tmp_path):
    s = store.CaptureStore(spark, f"file://{tmp_path}/captures")
    s.create()
    rows = [(m, f"0:{i}", "blocks.hook_resid_pre", i, 0, 0, 2, "torch.half", [2, 2], codec.encode("torch.half", np.arange(4))) for m in ("a", "b/c") for i in range(3)]
    s.insert(spark.createDataFrame([*rows, ("a", "0:9", "x", 0, 0, 0, 0, "torch.half", [], b"")], CAPTURES))
    assert s.read().count() == 6
    got = store.prefix_get(s.read(), ("a", "0:1"))
    assert got.count() == 1 and "PartitionFilters: [isnotnull(model_id" in got._jdf.queryExecution().toString()
    assert codec.decoded(got).first()["values"] == [0.0, 1.0, 2.0, 3.0]
    assert codec.encoded(codec.decoded(got)).select("bytes").collect() == got.select("bytes").collect()
    assert store.prefix_get(s.read(), ("a",), full_key=False).columns == ["dtype", "shape", "bytes"]
    for bad, error in (((), ValueError), (["a"], TypeError), (tuple(range(8)), ValueError)):
        with pytest.raises(error):
            store.prefix_get(s.read(), bad)
    assert s.wipe("b/c") and s.read().count() == 3 and not s.wipe("missing")
    with pytest.raises(ValueError):
        store.custom_select(spark, "WITH x AS (SELECT 1) SELECT * FROM x")
    with pytest.raises(ValueError):
        store.CaptureStore(spark, "x", compression="gzip")
    assert KEY[0] == "model_id"


def test_delivery():
    q = delivery.QueueConfig(min_items=4, linger_s=1.0, high_items=8)
    assert not q.may_dequeue(3, 0, 0.5, False) and q.may_dequeue(3, 0, 1.0, False) and q.may_dequeue(4, 0, 0, False) and q.may_dequeue(1, 0, 0, True) and not q.may_dequeue(0, 0, 9, True)
    for bad in ({"min_items": 0}, {"min_items": 5, "max_items": 4}, {"min_items": -1}):
        with pytest.raises(ValueError):
            delivery.QueueConfig(**bad)
    assert delivery.should_flush(1, 50, 0, ratio=0.5, capacity=100) and not delivery.should_flush(1, 49, 0, ratio=0.5, capacity=100) and delivery.should_flush(0, 100, 0, capacity=100)


def test_sink_policies(spark):
    calls = []

    def fails_twice(batch, i):
        calls.append(i)
        if len(calls) < 3:
            raise OSError("no")

    sink = delivery.DeliverySink(fails_twice, delivery.OnFull.RETRY)
    sink(spark.range(5), 0)
    sink(spark.range(5), 0)
    assert calls == [0, 0, 0] and sink.dropped == 0 and len(sink.failures) == 2

    def fails(batch, i):
        raise OSError("no")

    drop = delivery.DeliverySink(fails, delivery.OnFull.DROP)
    drop(spark.range(5), 1)
    assert drop.dropped == 5
    with pytest.raises(delivery.Aborted):
        delivery.DeliverySink(fails, delivery.OnFull.ABORT)(spark.range(1), 0)
    with pytest.raises(OSError):
        drop.raise_if_failed()


def test_greedy_batches(spark):
    rows = spark.createDataFrame([(i, i % 2, 40 + i) for i in range(20)], "seq long, queue long, bytes long")
    got = delivery.greedy_batches(rows, 3, 120).collect()
    for q in (0, 1):
        batch, items, total = 0, 0, 0
        for r in sorted((r for r in got if r.queue == q), key=lambda r: r.seq):
            if items and (items >= 3 or total + r.bytes > 120):
                batch, items, total = batch + 1, 0, 0
            items, total = items + 1, total + r.bytes
            assert r.batch == batch


def test_pairing_drops_payloads_without_description(spark):
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, m string")
    pay = spark.createDataFrame([(2, 20), (3, 30)], "seq long, p long")
    assert [tuple(r) for r in pairing.paired(meta, pay, "seq").collect()] == [(2, "b", 20)]
