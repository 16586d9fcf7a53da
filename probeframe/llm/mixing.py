"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(cap, exp(l_s * size / mean size of its source)): among all rates that give each source its
target of words these are the closest to 1 in relative entropy, under the cap. The l_s are the variables of the convex dual;
Newton steps (bisection where a step leaves its bracket) solve it. One step sums up the table of (source, size, number of
documents), which is much smaller than the documents. Up to HISTOGRAM_ROWS rows of it come to the driver, once, and steps are sums
in numpy; beyond that each step is an aggregation, of which only a row for each source reaches the driver.
Rates become copies by floor(r + u + shift), with u uniform from a hash of the document, so reruns agree. The shift of a
source is narrowed by aggregations until its sum of words meets the target; the one document at the shift is cut to what is
missing, unless only whole copies are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Sources up to which their table of targets is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of the table of sizes up to which Newton steps are made in the driver (2 MB), where they cost no jobs and no broadcasts.
HISTOGRAM_ROWS = 50_000
GRID = 32
KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def targets(sizes: np.ndarray, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> np.ndarray:
    """Words for each source (sizes in the order of sources): shares by the repeating weights, none above cap * size."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    left = float(sizes.sum())
    while open_.any() and left > 0:
        share = left * w / w[open_].sum()
        over = open_ & (share >= cap * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * sizes[over]
        left -= float((cap * sizes[over]).sum())
        open_ &= ~over
    return out


def _with(rows: DataFrame, table: list[tuple], names: str) -> DataFrame:
    """rows joined by ``k`` to the driver's table of one row for each source. The table is handed over in Arrow form, so no job makes it."""
    kinds = [n.split() for n in names.split(", ")]
    columns = [pa.array(c, KINDS[kind]) for c, (_, kind) in zip(zip(*table, strict=True) if table else [()] * len(kinds), kinds, strict=True)]
    other = rows.sparkSession.createDataFrame(pa.table(columns, [n for n, _ in kinds]))
    return rows.join(F.broadcast(other) if len(table) <= BROADCAST_SOURCES else other, "k")


def _steps_by_plan(hist: DataFrame, means: list[tuple], cap: float) -> Callable[[list[tuple]], Iterable[tuple]]:
    """(k, tilt) of some sources -> (k, words at that tilt, their slope) of each. hist: k, size, c; means: (k, mean size)."""
    hist = saved(_with(hist, means, "k string, mean double").withColumn("x", F.col("size") / F.col("mean")), "mix-scaled")
    e = F.exp(F.least(F.col("l") * F.col("x"), F.lit(700.0)))
    words = F.col("c") * F.col("size") * F.least(e, F.lit(float(cap)))
    slope = F.when(e < cap, F.col("c") * F.col("size") * F.col("x") * e).otherwise(0.0)
    return lambda state: _with(hist, state, "k string, l double").groupBy("k").agg(F.sum(words), F.sum(slope)).collect()


def _steps_in_driver(hist: DataFrame, means: list[tuple], cap: float) -> Callable[[list[tuple]], Iterable[tuple]]:
    """The same sums of a table of at most HISTOGRAM_ROWS rows, in the order of sizes."""
    table = hist.select("k", "size", "c").toArrow()
    at = {k: i for i, (k, _) in enumerate(means)}
    source = np.array([at[k] for k in table["k"].to_pylist()])
    size, count = table["size"].to_numpy(), table["c"].to_numpy()
    order = np.lexsort((size, source))
    source, size, count = source[order], size[order].astype(float), count[order]
    x, words = size / np.array([m for _, m in means])[source], count * size
    ends = np.searchsorted(source, np.arange(len(means) + 1))

    def run(state: list[tuple]):
        for k, l in state:
            own = slice(ends[at[k]], ends[at[k] + 1])
            e = np.exp(np.minimum(l * x[own], 700.0))
            free = e < cap
            yield k, float((words[own] * np.minimum(e, cap)).sum()), float((words[own][free] * x[own][free] * e[free]).sum())

    return run


def solve(sums: Callable[[list[tuple]], Iterable[tuple]], sources: list, goal: np.ndarray, cap: float = CAP, steps: int = 60, tol: float = 1e-9) -> list[float]:
    """The tilt of each source. sums: (k, tilt) of the open sources -> (k, words at that tilt, their slope)."""
    n = len(sources)
    tilt, lo, hi = np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)
    total = np.array([float(s.total) for s in sources])
    done = (goal <= 0) | (goal >= cap * total * (1 - 1e-12))
    tilt[goal <= 0] = -np.inf
    tilt[(goal > 0) & done] = np.inf
    at = {s.k: i for i, s in enumerate(sources)}
    for _ in range(steps):
        if done.all():
            break
        state = [(s.k, float(tilt[i])) for i, s in enumerate(sources) if not done[i]]
        for k, words, slope in sums(state):
            i = at[k]
            off = words - goal[i]
            if abs(off) <= tol * max(1.0, goal[i]):
                done[i] = True
                continue
            lo[i], hi[i] = (lo[i], tilt[i]) if off > 0 else (tilt[i], hi[i])
            step = tilt[i] - off / slope if slope > 0 else math.nan
            if not lo[i] < step < hi[i]:
                wide = 1.0 + 2 * abs(tilt[i])
                step = tilt[i] + wide if math.isinf(hi[i]) else tilt[i] - wide if math.isinf(lo[i]) else (lo[i] + hi[i]) / 2
            if step == tilt[i]:
                done[i] = True
            tilt[i] = step
    return tilt.tolist()


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, whole: bool = False, rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of docs (doc_id, text, source).

    size: words of the text, null text 0; documents without words take 0. Null source: a source of its own, after the others.
    An empty table gives an empty result. Equal rows get equal results. ``whole``: taken is copies * size, and a source comes
    as near to its target as whole copies allow; else the last copy of one document of each source is cut (copies counts it
    as none). Rows without doc_id are mixed like others. ``rows`` (with whole): a last column ``row`` holds all columns of docs; what is
    taken of a row follows from its doc_id, source and size, so texts are read once more and neither joined nor shuffled.
    """
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    if rows and not whole:
        raise ValueError("rows are given with whole copies only")
    row = [F.struct(*docs.columns).alias("row")] if rows else []
    given = docs.select("doc_id", "source", key.alias("k"), size.alias("size"), *row)
    sized = saved(given.drop("row"), "mix-sizes")
    hist = saved(sized.groupBy("k", "size").agg(F.count("*").cast("double").alias("c")), "mix-histogram")
    sources = hist.groupBy("k").agg(F.sum(F.col("c") * F.col("size")).alias("total"), F.sum("c").alias("n"), F.count("*").alias("sizes")).collect()
    if not sources:
        return given.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), *given.columns[4:])
    sources.sort(key=lambda r: (r.k == "n", r.k.encode()))
    total = np.array([float(r.total) for r in sources])
    goal = targets(total, weights, cap)
    mean = [r.total / r.n if r.total else 1.0 for r in sources]
    steps = _steps_in_driver if sum(r.sizes for r in sources) <= HISTOGRAM_ROWS else _steps_by_plan
    tilt = solve(steps(hist, [(r.k, m) for r, m in zip(sources, mean, strict=True)], cap), sources, goal, cap)

    table = [(r.k, int(t), float(g), float(m), 0.0 if math.isinf(l) else l, 0.0 if l == -math.inf else float(cap) if l == math.inf else -1.0) for r, t, g, m, l in zip(sources, total, goal, mean, tilt, strict=True)]
    rate = F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 11) / F.lit(float(1 << 53))

    def rates(of: DataFrame) -> DataFrame:
        both = _with(of, table, "k string, source_size long, target double, mean double, l double, fixed double")
        return both.select("doc_id", "source", "k", "size", "source_size", "target", rate.alias("rate"), u.alias("u"), *of.columns[4:])

    rated = saved(rates(sized), "mix-rates").withColumn("v", F.col("rate") + F.col("u"))

    def copies(shift) -> Column:
        return F.least(F.lit(cap), F.greatest(F.lit(0), F.floor(F.col("v") + shift)))

    start, width = np.full(len(sources), -1.0), np.full(len(sources), 2.0)
    at = {r.k: i for i, r in enumerate(sources)}
    got, above = np.zeros(len(sources)), np.zeros(len(sources))
    for _ in range(4):
        state = [(r.k, float(start[i]), float(width[i])) for i, r in enumerate(sources)]
        sums = [F.sum(F.col("size") * copies(F.col("at") + F.col("w") * (j / GRID))).alias(f"s{j}") for j in range(GRID + 1)]
        for r in _with(rated, state, "k string, at double, w double").groupBy("k").agg(*sums).collect():
            i = at[r.k]
            s = [float(r[f"s{j}"]) for j in range(GRID + 1)]
            j = max([0] + [j for j in range(GRID) if s[j] <= goal[i]])
            start[i] += width[i] * (j / GRID)
            got[i], above[i] = s[j], s[j + 1]
        width /= GRID
    if whole:
        start = np.where(np.abs(above - goal) < np.abs(got - goal), start + width, start)
    shifts = [(r.k, float(start[i]), float(max(0, math.floor(goal[i] - got[i] + 1e-6)))) for i, r in enumerate(sources)]
    if rows:
        rated = rates(given).withColumn("v", F.col("rate") + F.col("u"))
    done = _with(rated, shifts, "k string, shift double, missing double").withColumn("copies", copies(F.col("shift")).cast("long"))
    if whole:
        taken = F.col("size") * F.col("copies")
    else:
        gap = F.floor(F.col("v") + F.col("shift")) + 1 - (F.col("v") + F.col("shift"))
        done = done.withColumn("next", F.when((F.col("copies") < cap) & (F.col("size") > 0), F.struct(gap.alias("g"), F.col("doc_id"), F.col("size"))))
        ends = done.groupBy("k").agg(F.min("next").alias("edge"))
        edge = {r.k: r.edge for r in ends.where("edge is not null").collect()}
        rows = [(k, float(e.g), None if e.doc_id is None else str(e.doc_id), int(e.size)) for k, e in edge.items()]
        last = _with(done.select("k", "next", "doc_id", "size"), rows, "k string, eg double, ed string, es long") if rows else None
        same = (F.col("next.g") == F.col("eg")) & F.col("doc_id").cast("string").eqNullSafe(F.col("ed")) & (F.col("size") == F.col("es"))
        ties = {r.k: r.n for r in last.where(same).groupBy("k").agg(F.count("*").alias("n")).collect()} if rows else {}
        found = {x[0]: x[1:] for x in rows}
        edges = [(r.k, *found.get(r.k, (None, None, None)), float(ties.get(r.k, 1))) for r in sources]
        done = _with(done, edges, "k string, eg double, ed string, es long, ties double")
        part = F.least(F.col("size"), F.floor(F.col("missing") / F.col("ties")))
        taken = F.col("size") * F.col("copies") + F.when(same, part).otherwise(0)
    return done.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken.cast("long").alias("taken"), *given.columns[4:])


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
