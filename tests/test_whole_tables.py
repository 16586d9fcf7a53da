"""Queries over whole tables, counted out in Python: no fixed part of the ids, heads or groups is left out."""

import random

from probeframe import plans
from probeframe.plans import fixtures
from probeframe.schema import hook_defs


def events(spark, path, ids):
    """events of the given ids, beside the other smallest tables."""
    rows = [(i, i % 7, ("signup", "click", "error", "view", "signup")[i * i % 5]) for i in ids]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_overlap_join_reads_every_event(spark, sf, tmp_path):
    ids = [0, 5, 1999, 2000, 2001, 2011, 12_345]
    sf_dir = events(spark, tmp_path, ids)
    spark.read.parquet(f"{sf}/embeddings.parquet").write.parquet(f"{sf_dir}/embeddings.parquet")
    spans = {}
    for r in fixtures.tok_emb(spark, sf).select("request_id", "layer_no", "start_token_idx", "end_token_idx").collect():
        spans[tuple(r)] = spans.get(tuple(r), 0) + 1
    want = sorted((i, y, s, n) for i in ids for (q, y, s, e), n in spans.items() if q == f"0:{i % 12}" and s < i % 6 + 3 and e > i % 6)
    assert {x[0] for x in want} == set(ids)
    assert sorted(map(tuple, plans.QUERIES["overlap_join"](spark, sf_dir).collect())) == want


def step_elements(i, kind, q, packed):
    """Elements of a hook's tensor in step i."""
    b, kv, keep = 1 if packed else 1 + i % 4, 16 + i % 100, i % 2
    per = {0: q * 1024, 1: q * 8 * 128, 2: q * 4 * 128, 3: q * 8 * 128, 4: 8 * q * kv, 5: q * 1408, 6: q, 7: (keep or q) * 151_936, 8: q * 60, 9: q * 4, 10: q * 4}
    return b * per[kind]


def test_shapes_and_plans_of_every_step(spark, tmp_path):
    ids = [0, 1, 2, 3, 9, 10, 17, 35, 1007]
    sf_dir = events(spark, tmp_path, ids)
    hooks = [tuple(r) for r in hook_defs(spark).select("id", "shape_class").collect()]
    got = {(r.step, r.id): r.n for r in plans.QUERIES["hook_shape"](spark, sf_dir).collect()}
    assert got == {(i, h): step_elements(i, kind, 1 + i % 9, i % 3 == 0) for i in ids for h, kind in hooks}

    def planned(q, packed):
        n = {i: [step_elements(i, kind, q(i), packed(i)) for _, kind in hooks] for i in ids}
        return {i: (sum(-(-x * 2 // 16) * 16 for x in v if x), sum(x > 0 for x in v)) for i, v in n.items()}

    got = {r.step: (r.total_bytes, r.hooks) for r in plans.QUERIES["plan_step"](spark, sf_dir).collect()}
    assert got == planned(lambda i: 1 + i % 9, lambda i: i % 3 == 0)
    got = {r.step: r.total_bytes for r in plans.QUERIES["decode_step_bytes"](spark, sf_dir).collect()}
    assert got == {i: x for i, (x, _) in planned(lambda i: 1, lambda i: False).items()}


def test_requests_of_every_step_are_expanded(spark, tmp_path):
    ids = [0, 1, 2, 4, 5, 10, 23]
    want = sorted((i, k, f"g{i % 4}:{k}", i % 7, i % 7 + 1 + k) for i in ids for k in range(i % 3 + 1))
    got = plans.QUERIES["expand_requests"](spark, events(spark, tmp_path, ids)).select("step", "ord", "req_id", "lo", "hi")
    assert sorted(map(tuple, got.collect())) == want


def ranges(ids):
    """{(slot, grp): [(start, end)]} of events(): a signup or a user's first event starts a group, an error ends its growth."""
    out, state = {}, {}
    for i in ids:
        slot, kind = i % 7, ("signup", "click", "error", "view", "signup")[i * i % 5]
        grp, end, over = state.get(slot, (-1, 0, False))
        if kind == "signup" or grp < 0:
            grp, end, over = grp + 1, 0, False
        over = over or kind == "error"
        n = 0 if over else 1 + i % 5 if kind == "signup" else 1
        out.setdefault((slot, grp), []).append((end, end + n))
        state[slot] = (grp, end + n, over)
    return out


def test_every_group_is_judged_and_masked(spark, tmp_path):
    ids = sorted(random.Random(3).sample(range(400), 120))
    sf_dir, by = events(spark, tmp_path, ids), ranges(ids)
    assert len({g for _, g in by}) > 3
    got = {(r.slot, r.grp): (r.n, r.complete) for r in plans.QUERIES["match_token_ranges"](spark, sf_dir).collect()}
    filled = {k: {x for x in v if x[1] > x[0]} for k, v in by.items()}
    assert got == {k: (len(v), True) for k, v in filled.items() if v}
    got = {(r.request_id, r.grp, r.slot): r.present for r in plans.QUERIES["token_mask"](spark, sf_dir).collect()}
    end = {k: v[-1][1] for k, v in by.items()}
    width = max(end.values())
    assert got == {(*k, s): s >= width - end[k] for k in by for s in range(width)}


def test_every_head_is_stacked(spark, sf):
    got = {(r.request_id, r.head, r.q_slot, r.k_slot): r.value for r in plans.QUERIES["attention_batch_stack"](spark, sf).collect()}
    rows = fixtures.attention(spark, sf).collect()
    size, width = {}, {}
    for r in rows:
        size[r.request_id] = max(size.get(r.request_id, 0), r.query + 1)
        width[r.request_id] = max(width.get(r.request_id, 0), r["keys"])
    dq, dk = ({k: max(x.values()) - v for k, v in x.items()} for x in (size, width))
    low = float("-inf")
    want = {(r.request_id, r.head, r.query + dq[r.request_id], k + dk[r.request_id]): r.row[k] if k < len(r.row) else low for r in rows for k in range(width[r.request_id])}
    assert {k[1] for k in got} == {0, 1, 2, 3} and got == {k: -1e9 if v == low else v for k, v in want.items()}
