"""Packing by non-negative least squares over a histogram of lengths.

Documents become pieces of at most ``window`` tokens (full windows and a rest), and the lengths of pieces are counted in bins of
``width`` tokens, rounded up. Shallow combinations of up to three bins that fill a window exactly are enumerated; non-negative
least squares finds how often to repeat each so that the histogram is used up; the counts are rounded within it, and what is
left is packed greedily, best fit decreasing, on the histogram as well. So the driver's work and the plan depend on the number
of bins, not on the number of documents. Pieces then take the places of their bin by rank; ranks are counted by salted groups,
and only their small table of offsets is summed up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, saved
from .tokens import END, VOCABULARY, encoder, vocabulary_path

WINDOW = 4096
WIDTH = 8
#: Pieces that one ranking group is meant to hold.
RANKED = 200_000


def combinations(bins: int, depth: int = 3) -> np.ndarray:
    """All non-increasing triples (0: none) of bins that add up to ``bins``."""
    out = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    if depth >= 3:
        out += [(a, b, bins - a - b) for a in range(-(-bins // 3), bins - 1) for b in range(-(-(bins - a) // 2), min(a, bins - a - 1) + 1)]
    return np.array(out, dtype=np.int64)


def non_negative_least_squares(parts: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes sum of x over the combinations' bins close to hist; accelerated projected gradient steps."""

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hist))
        for j in range(parts.shape[1]):
            np.add.at(out, parts[:, j], x)
        out[0] = 0
        return out

    goal = hist.astype(float)
    goal[0] = 0
    v = np.ones(len(parts))
    for _ in range(30):  # the largest eigenvalue bounds the step
        u = used(v)
        w = sum(u[parts[:, j]] for j in range(parts.shape[1]))
        norm = float(np.linalg.norm(w)) or 1.0
        v = w / norm
    rate = 0.95 / norm
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        off = used(y) - goal
        grad = sum(off[parts[:, j]] for j in range(parts.shape[1]))
        nxt = np.maximum(0.0, y - rate * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit_decreasing(hist: np.ndarray, bins: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs the histogram greedily: (number of sequences, [(bin, times in each sequence)])."""
    open_: list[list] = [[] for _ in range(bins + 1)]  # by room
    for b in range(bins, 0, -1):
        left, room = int(hist[b]), b
        while left:
            while room <= bins and not open_[room]:
                room += 1
            if room > bins:
                n, parts, space = left, [], bins
            else:
                n, parts = open_[room].pop()
                space = room
            each = min(space // b, left)
            taken = min(n, left // each)
            if n > taken and parts:
                open_[space].append((n - taken, parts))
            open_[space - each * b].append((taken, [*parts, (b, each)]))
            left -= taken * each
    return [x for groups in open_ for x in groups if x[0]]


def plan(hist: np.ndarray, bins: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences that take every counted piece exactly once."""
    parts = combinations(bins)
    x = non_negative_least_squares(parts, hist)
    left = hist.astype(np.int64).copy()
    out = []
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 0.5)
        if n == 0:
            break
        uses = {int(b): int((parts[i] == b).sum()) for b in set(parts[i].tolist()) if b}
        n = min([n, *(int(left[b]) // k for b, k in uses.items())])
        if n > 0:
            out.append((n, sorted(uses.items(), reverse=True)))
            for b, k in uses.items():
                left[b] -= n * k
    return out + best_fit_decreasing(left, bins)


def _pieces(path: str, window: int, end: int, with_ids: bool):
    def run(batches):
        own = encoder(path)
        for b in batches:
            ids, first = own.batch(b.column(2))
            rows: list[tuple] = []
            for i, (key, copy) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                mine = np.append(ids[first[i] : first[i + 1]], np.uint32(end)).astype("<u4", copy=False)
                n = len(mine)
                for a in range(0, n, window):
                    part = mine[a : a + window]
                    rows.append((key, copy, a, len(part), zlib.crc32(part), n, part.tobytes() if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, KINDS, strict=True)], names=NAMES)

    return run


NAMES = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "ids"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _places(entries):
    """Adds the sequence to (bin, rank): entries has, for each bin, sorted first ranks, first sequences and times in each."""

    def run(batches):
        table = entries.value
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            bins, ranks = b.column(at["bin"]).to_numpy(), b.column(at["rank"]).to_numpy()
            seq = np.empty(len(bins), dtype=np.int64)
            for k in np.unique(bins):
                firsts, seqs, times = table[int(k)]
                mine = bins == k
                e = np.searchsorted(firsts, ranks[mine], side="right") - 1
                seq[mine] = seqs[e] + (ranks[mine] - firsts[e]) // times[e]
            keep = [b.column(at[n]) for n in NAMES]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq)], names=[*NAMES, "sequence_id"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, width: int = WIDTH, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, copy, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset), a row for each piece of docs (doc_id, text).

    Null or empty text: the end id alone. ``copy`` counts rows of one doc_id and text from 0, so equal rows are packed each.
    Rows without doc_id are packed like others. ``ids`` (little-endian unsigned 32-bit) is null unless with_ids.
    """
    if window % width:
        raise ValueError("window is a multiple of width")
    spark = docs.sparkSession
    bounded_batches(spark, rows=3000, mb=16)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("copy"), "text")
    schema = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = saved(docs.mapInArrow(released(_pieces(vocabulary_path(vocabulary), window, end, with_ids)), schema), "pack-pieces")
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / width).cast("int"))
    bins = window // width
    hist = np.zeros(bins + 1, dtype=np.int64)
    for r in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect():
        hist[r.bin] = r.n

    groups, entries, base, used = plan(hist, bins), {}, 0, np.zeros(bins + 1, dtype=np.int64)
    for n, parts in groups:
        for b, times in parts:
            entries.setdefault(b, []).append((int(used[b]), base, times))
            used[b] += n * times
        base += n
    assert (used == hist).all()
    table = spark.sparkContext.broadcast({b: tuple(np.array(c, dtype=np.int64) for c in zip(*e, strict=True)) for b, e in entries.items()})

    salts = max(16, -(-int(hist.max()) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bin", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    copies = Window.partitionBy("bin", "salt", "doc_id", "start", "ids_crc32", "doc_tokens").orderBy("bin")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).withColumn("copy", (F.row_number().over(copies) - 1).cast("long"))
    counts = F.broadcast(counts) if salts * (bins + 1) <= 1_000_000 else counts
    ranked = ranked.join(counts, ["bin", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    placed = ranked.select(*NAMES, "bin", "rank").mapInArrow(released(_places(table)), schema + ", sequence_id long")
    placed = saved(placed, "pack-placed")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "copy", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def op6_nnls_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy")
