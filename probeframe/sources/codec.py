"""Bytes of captured tensors to typed values and back, in Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CAPTURES, TOKENS

#: Acts whose tensors are [heads, queries, keys].
ATTENTION = ("hook_attn_scores", "hook_pattern")

# Element types by stored name.
REAL = {"torch.float": "<f4", "torch.float32": "<f4", "torch.double": "<f8", "torch.float64": "<f8", "torch.half": "<f2", "torch.float16": "<f2"}
WHOLE = {"torch.uint8": "<u1", "torch.int8": "<i1", "torch.short": "<i2", "torch.int16": "<i2", "torch.int": "<i4", "torch.int32": "<i4", "torch.long": "<i8", "torch.int64": "<i8"}
#: Complex elements become two values each, the real part first.
COMPLEX = {"torch.chalf": "<f2", "torch.cfloat": "<f4", "torch.cdouble": "<f8"}


def decode(dtype: str, payload: bytes) -> np.ndarray:
    """A payload as doubles; bfloat16 is widened exactly, booleans become 0 and 1, complex elements two values. Unknown types raise
    ValueError."""
    if kind := REAL.get(dtype) or WHOLE.get(dtype) or COMPLEX.get(dtype):
        return np.frombuffer(payload, dtype=kind).astype(np.float64)
    if dtype == "torch.bfloat16":
        return (np.frombuffer(payload, dtype="<u2").astype(np.uint32) << np.uint32(16)).view("<f4").astype(np.float64)
    if dtype == "torch.bool":
        return np.frombuffer(payload, dtype=np.bool_).astype(np.float64)
    raise ValueError(f"unknown element type {dtype!r}")


def encode(dtype: str, values: np.ndarray) -> bytes:
    if dtype in COMPLEX and np.iscomplexobj(values):
        values = np.stack([np.real(values), np.imag(values)], axis=-1)
    if kind := REAL.get(dtype) or WHOLE.get(dtype) or COMPLEX.get(dtype):
        return np.asarray(values).astype(kind).tobytes()
    if dtype == "torch.bfloat16":
        return (np.asarray(values, dtype="<f4").view("<u4") >> np.uint32(16)).astype("<u2").tobytes()
    if dtype == "torch.bool":
        return np.asarray(values).astype(np.bool_).tobytes()
    raise ValueError(f"unknown element type {dtype!r}")


def _swap(b: pa.RecordBatch, old: str, new: str, column: pa.Array) -> pa.RecordBatch:
    names = [new if n == old else n for n in b.schema.names]
    return pa.RecordBatch.from_arrays([column if n == new else b.column(i) for i, n in enumerate(names)], names=names)


def _fitting(dtype: str, shape: list[int], payload: bytes) -> np.ndarray:
    values = decode(dtype, payload)
    if len(values) != int(np.prod(shape)) * (2 if dtype in COMPLEX else 1):
        raise ValueError(f"{len(values)} elements for shape {shape}")
    return values.reshape(*shape[:-1], -1) if dtype in COMPLEX else values.reshape(shape)


def token_rows(rows: DataFrame) -> DataFrame:
    """Captures (the columns of CAPTURES) as token rows (those of TOKENS): one for each token of a segment.

    The token axis is the second last one of attention matrices ([heads, queries, keys]), else the first. ``pos`` counts from
    start_token_idx; ``values`` are the token's elements in row-major order of the other axes. A segment whose token axis is not
    as long as its range keeps its last rows at the end of the range (logits keep fewer rows), or raises if it is longer.
    """
    keys = [f.split()[0] for f in TOKENS.split(", ")][:7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = _fitting(r["dtype"], r["shape"], r["bytes"])
                attention = r["act_name"].endswith(ATTENTION) and x.ndim >= 3
                x = np.moveaxis(x, -2, 0) if attention else x
                x = x.reshape(len(x), -1)
                first = r["end_token_idx"] - len(x)
                if first < r["start_token_idx"]:
                    raise ValueError(f"{len(x)} tokens for [{r['start_token_idx']}, {r['end_token_idx']})")
                n = len(x)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                same = [pa.array([r[k]] * n, t) for k, t in zip(keys, [pa.string()] * 3 + [pa.int32()] * 4, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(first, first + n), pa.int32()), values], names=[*keys, "pos", "values"])

    return rows.select(*[f.split()[0] for f in CAPTURES.split(", ")]).mapInArrow(run, TOKENS)


def segments(tokens: DataFrame, dtype: str = "torch.float32") -> DataFrame:
    """Token rows as captures: one segment of shape [tokens, width] for each key, its tokens in the order of pos."""
    keys = [f.split()[0] for f in TOKENS.split(", ")][:7]
    rows = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "values"))).alias("__s"))
    shape = F.array(F.size("__s").cast("long"), F.size(F.col("__s")[0]["values"]).cast("long"))
    rows = rows.select(*keys, F.lit(dtype).alias("dtype"), shape.alias("shape"), F.flatten(F.transform("__s", lambda x: x["values"])).alias("values"))
    return encoded(rows).select(*[f.split()[0] for f in CAPTURES.split(", ")])


def decoded(rows: DataFrame) -> DataFrame:
    """``bytes`` replaced by ``values`` (array of double, row-major); a payload that does not fit its shape raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            out = []
            for dtype, shape, payload in zip(*(b.column(at[n]).to_pylist() for n in ("dtype", "shape", "bytes")), strict=True):
                out.append(_fitting(dtype, shape, payload).ravel())
            yield _swap(b, "bytes", "values", pa.array(out, pa.list_(pa.float64())))

    schema = ", ".join(f"{'values' if c == 'bytes' else c} {'array<double>' if c == 'bytes' else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, schema)


def encoded(rows: DataFrame) -> DataFrame:
    """``values`` replaced by ``bytes``, by each row's dtype."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            out = [encode(d, np.array(v, dtype=np.float64)) for d, v in zip(b.column(at["dtype"]).to_pylist(), b.column(at["values"]).to_pylist(), strict=True)]
            yield _swap(b, "values", "bytes", pa.array(out, pa.binary()))

    schema = ", ".join(f"{'bytes' if c == 'values' else c} {'binary' if c == 'values' else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, schema)
