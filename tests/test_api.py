"""Lazy fields, requirements and retries, registries, and the public names."""

import pytest
from pyspark.sql import functions as F

from probeframe import api
from probeframe.operators import steps
from probeframe.plans import fixtures


@pytest.fixture(scope="module")
def tokens(spark, sf):
    return fixtures.tok_emb(spark, sf).drop("vec_id").cache()


def test_fields(tokens):
    lazy = api.make_lazy_internal(lambda: tokens, "run0")
    assert lazy.available == ["hidden_states"]
    assert set(lazy.hidden_states.columns) == {"layer_no", "request_id", "slot", "width", "values"}
    assert lazy.hidden_states is lazy.get("hidden_states")
    lazy.clear_cache()
    assert list(api.get_internal(lambda: tokens, "run0")) == ["hidden_states"]
    with pytest.raises(AttributeError):
        lazy.get("nothing")
    with pytest.raises(api.MissingInternalError):
        lazy.get("logits")
    assert api.make_lazy_internal(lambda: tokens, "run0", request_ids=["0:1"], token_ranges={"0:1": [(0, 4)]}).available == ["hidden_states", "token_mask"]


def test_requirements(tokens):
    reads = []

    def read():
        reads.append(1)
        return tokens.where("layer_no < 2") if len(reads) < 3 else tokens

    lazy = api.make_lazy_internal(read, "run0").require("hidden_states", count=4, retry=True, timeout_s=20, poll_s=0.01)
    assert lazy.hidden_states is not None and len(reads) == 3
    reads.clear()
    with pytest.raises(api.IncompleteInternalError):
        api.make_lazy_internal(read, "run0").require("hidden_states", count=4, retry=True, timeout_s=0).hidden_states
    assert len(reads) == 1

    def broken():
        raise OSError("no")

    with pytest.raises(OSError):
        api.make_lazy_internal(broken, "run0").require("hidden_states", count=4, retry=True).hidden_states
    need = {"hidden_states": api.Requirement(4, match_token_ranges=True)}
    with pytest.raises(api.IncompleteInternalError):
        api.make_lazy_internal(lambda: tokens, "run0", need, ["0:1"], {"0:1": [(0, 4), (99, 100)]}).hidden_states


def test_registries(spark, tokens):
    api.register_field("pair_sum", "blocks.hook_resid_pre", lambda t: t.groupBy("request_id").count())
    assert api.make_lazy_internal(lambda: tokens, "run0").pair_sum.count() == 12
    with pytest.raises(ValueError):
        api.register_field("logits", "x", lambda t: t)
    doubled = api.apply_hook(tokens, "blocks.hook_resid_pre", lambda v: F.transform(v, lambda x: 2 * x))
    key = ["request_id", "layer_no", "pos"]
    assert doubled.join(tokens.withColumnRenamed("values", "w"), key).where("get(values, 0) <> 2 * get(w, 0)").count() == 0
    assert api.resolve_eos(None, 2, [3]) == {2} and api.resolve_eos(None, [3, 4]) == {3, 4} and api.resolve_eos(None) == frozenset()
    assert sorted(api.__all__) == api.__all__ and all(hasattr(api, n) for n in api.__all__)


def test_step_source(spark, sf):
    class Events(api.StepSource):
        def steps(self, spark):
            return fixtures.steps(spark, sf)

        def eos(self):
            return frozenset(fixtures.EOS)

    assert Events().ranges(spark).count() == 1000


def test_reservations_carry_the_level(spark):
    rows = spark.createDataFrame([(0, 1, 60, 1), (0, 2, 30, 1), (0, 3, 20, 1), (0, 4, 200, 1), (0, 5, 0, 0), (1, 1, 100, 2)], "engine long, step long, planned long, hooks long")
    got = {(r.engine, r.step): (r.outcome, r.level) for r in steps.reservations(rows, 100).collect()}
    assert got == {(0, 1): (0, 60), (0, 2): (0, 90), (0, 3): (1, 20), (0, 4): (2, 20), (0, 5): (-1, 20), (1, 1): (0, 100)}
