"""The step machine as a stateful stream: group ids, latches and token ranges for each slot, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "step long, slot long, grp long, finished boolean, range_start long, range_end long"
STATE = "grp long, batch long, finished boolean, ends long"


def step_ranges(stream: DataFrame, eos: list[int]) -> DataFrame:
    """(step, slot, grp, finished, range_start, range_end) of a stream of steps (step, slot, prefill, batch, real_len, fed_token).

    Steps of a slot come in order across micro-batches; within one they are sorted. State by slot: four numbers, which live in
    the state store and survive lost executors.
    """
    ends = set(eos)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        grp, batch, finished, end = state.get if state.exists else (-1, -1, False, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("step").itertuples():
            if r.prefill or r.batch != batch:
                grp, batch, finished, end = grp + 1, int(r.batch), False, 0
            if not r.prefill and r.fed_token in ends:
                finished = True
            n = 0 if finished else int(r.real_len) if r.prefill else 1
            rows.append((int(r.step), int(key[0]), grp, finished, end, end + n))
            end += n
        state.update((grp, batch, finished, end))
        yield pd.DataFrame(rows, columns=["step", "slot", "grp", "finished", "range_start", "range_end"])

    return stream.groupBy("slot").applyInPandasWithState(run, SCHEMA, STATE, "append", "NoTimeout")
