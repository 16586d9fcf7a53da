"""Nearest neighbours by inner product with multi-index hashing.

Vectors are lifted by one component so that the largest inner product becomes the smallest angle, projected and rotated by
iterative quantisation (fitted on a bounded sample), and reduced to binary codes of BITS bits. Codes are cut into substrings;
each substring has an index of its own, a table of posting lists addressed by the substring's value. By the pigeonhole principle a
code within Hamming radius r of the query's lies within floor(r / number of substrings) of it in at least one substring: every
list of a value that near is read, the true radius is checked, and what is left is ranked by the inner product of the original
vectors in double precision.

The rows are dealt once into shards of bounded size, each indexed by one task. Queries are written to the shared folder in blocks;
every task reads them block by block and sends on only the best k of its shard for each query. So vectors are shuffled once,
whatever the number of queries. The radius is set on the sample so that it holds the wanted share of true neighbours; where it
holds fewer than k rows of a shard it is widened, up to the whole shard. The closer true neighbours are, the fewer lists are
read; for vectors without structure most rows lie within the radius, and the search costs as much as a scan of the codes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch

BITS = 64
PARTS = 8
#: Vectors that the rotation and the radius are learned on at most, queries among them, and the neighbours the radius shall hold.
SAMPLE, PROBES, HELD = 20_000, 400, 0.98
#: Rows and bytes of a shard at most, about.
SHARD, SHARD_BYTES = 8192, 64 << 20
NEAREST = 20


class Codes:
    """A learned projection to binary codes."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, seed: int = 3, rounds: int = 40):
        self.longest = longest or 1.0
        lifted = self.lift(sample)
        self.mean = lifted.mean(axis=0)
        centred = lifted - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        rng = np.random.default_rng(seed)
        dims = lifted.shape[1]
        if len(axes) < dims:
            axes = np.linalg.qr(np.concatenate([axes, rng.normal(size=(dims, dims))]).T)[0].T[:dims]
        axes = axes[: min(bits, dims)]
        if len(axes) < bits:  # more bits than axes: further random directions
            axes = np.concatenate([axes, np.linalg.qr(rng.normal(size=(dims, dims)))[0][: bits - len(axes)]] * (1 + bits // dims))[:bits]
        v = centred @ axes.T
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.axes = axes.T @ turn

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def _pack(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.axes > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self.lift(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._pack(np.concatenate([unit, np.zeros((len(x), 1))], axis=1))


class Shard:
    """Substring indexes over the codes of some rows: for each substring, the rows in order of its value and where each value begins."""

    def __init__(self, codes: np.ndarray, parts: int = PARTS, bits: int = BITS):
        self.codes, self.parts, self.width = codes, parts, bits // parts
        self.mask = np.uint64((1 << self.width) - 1)
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.flips = values[np.argsort(np.bitwise_count(values), kind="stable")]
        self.upto = np.cumsum([comb(self.width, k) for k in range(self.width + 1)])
        self.index = []
        for j in range(parts):
            piece = (codes >> np.uint64(j * self.width)) & self.mask
            order = np.argsort(piece, kind="stable")
            self.index.append((np.searchsorted(piece[order], np.arange((1 << self.width) + 1)), order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes at most radius away, through the lists of all substring values at most radius / parts away."""
        flips = self.flips[: self.upto[min(self.width, radius // self.parts)]]
        seen = np.zeros(len(self.codes), dtype=bool)
        for j, (first, order) in enumerate(self.index):
            at = (((code >> np.uint64(j * self.width)) & self.mask) ^ flips).astype(np.int64)
            lo, length = first[at], first[at + 1] - first[at]
            ends = np.cumsum(length)
            seen[order[np.repeat(lo - ends + length, length) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def learn(vectors: DataFrame, bits: int = BITS) -> tuple[Codes, int] | None:
    """The codes and the radius, from the SAMPLE vectors of smallest hash."""
    longest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if longest is None:
        return None
    picked = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0)
    x = matrix(picked)
    x = x[np.lexsort(x.T)]
    codes = Codes(x, float(np.sqrt(longest)), bits)
    q = x[:: max(1, len(x) // PROBES)]
    own, asked = codes.rows(x), codes.queries(q)
    k = min(NEAREST + 1, len(x))
    near = []
    for i in range(len(q)):
        best = np.argpartition(-(x @ q[i]), k - 1)[:k]
        near.append(np.bitwise_count(own[best] ^ asked[i]))
    return codes, int(np.ceil(np.quantile(np.concatenate(near), HELD)))


def _search(model, k: int, folder: str):
    """One shard's rows (vec_id, v) -> (query_id, vec_id, score) of the best k for each query in the files of folder."""

    def answer(rows, ids, shard, code, q, own):
        radius = model.value[1]
        while True:
            found = shard.within(code, radius)
            found = found[ids[found] != own]
            if len(found) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + 4)
        score = (rows[found] * q).sum(axis=1)
        if len(found) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= edge
            found, score = found[keep], score[keep]
        best = np.lexsort((ids[found], -score))[:k]
        return found[best], score[best]

    def run(batches):
        codes = model.value[0]
        held = [(b.column(0).to_numpy(), matrix(b.column(1))) for b in batches if b.num_rows]
        if not held:
            return
        ids, rows = (np.concatenate(c) for c in zip(*held, strict=True))
        shard = Shard(codes.rows(rows))
        system, place = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet"))
        for path in files:
            for block in pq.ParquetFile(system.open_input_file(path)).iter_batches(1024):
                asked, x = block.column(0).to_numpy(), matrix(block.column(1))
                found = [answer(rows, ids, shard, code, q, own) for own, q, code in zip(asked, x, codes.queries(x), strict=True)] if len(asked) else []
                if found:
                    who = np.repeat(asked, [len(f) for f, _ in found])
                    at, score = np.concatenate([f for f, _ in found]), np.concatenate([z for _, z in found])
                    yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(ids[at], pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a finite, non-zero vector. Where lengths differ, vectors are filled up with zeros to the longest."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    ends = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("z")).first()
    return rows if ends.a == ends.z else rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(ends.z) - F.size("v"))).alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, v) that is_query picks, the k rows of another vec_id with
    the largest inner product that the radius holds; ties go to the smaller vec_id. All vectors have one length (see usable).

    Rows of one vec_id are candidates each, for queries of other ids; of several queries of one id the greatest vector is asked.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=2000)
    vectors = saved(vectors.select("vec_id", "v"), "search-vectors")
    n, size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    model = learn(vectors)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(model)
    folder = scratch(spark, "search-queries")
    vectors.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v")).write.parquet(folder)
    shards = max(1, -(-n // max(1, min(SHARD, SHARD_BYTES // (8 * size)))))
    found = vectors.repartition(shards).mapInArrow(_search(sent, k, folder), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)
