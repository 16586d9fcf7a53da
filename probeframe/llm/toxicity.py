"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled documents are drawn from all learning rows, toxic ones included, so that they
hold positives at the class prior. Labels may cover a part that is not like the rest, so the class prior pi of all learning rows is counted
where there are labels; where there are none it is taken to be the same unless the texts speak against it (open_share). The risk of a linear classifier over hashed words is
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), minimised in numpy by mini-batches; where the second term falls below zero a step
goes against it. The classifier is fitted on two bounded samples (max_positive, max_unlabelled: the documents of smallest hash);
scores are made for every whole text.

Features: the set of a text's words - A-Z in lower case, ASCII punctuation and white space between them - hashed to
2^BITS cells. Labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, released, saved
from .words import LOWER, SPACE, word_table

BITS = 18
THRESHOLD = 0.3
MAX_POSITIVE = 6000
MAX_UNLABELLED = 24000
#: A cell is used if this share of the positives (and MIN_POSITIVES of them) hold it, LIFT times the negatives' share as estimated.
MIN_SHARE, MIN_POSITIVES, LIFT = 0.006, 4, 8.0
#: Telling cells must be found in this many more of the toxic than of the clean texts before they count texts without a label.
TELLING = 0.2

_BREAK = SPACE.copy()
_BREAK[[ord(c) for c in string.punctuation]] = True
_BREAK[:32] = True


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(cells, first): sorted distinct cells of each row, one row after the other."""
    _, _, h, first = word_table(column, LOWER, _BREAK)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.unique((row << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(keys >> np.uint64(bits), np.arange(len(first), dtype=np.uint64))


def _cells(bits: int):
    def run(batches):
        for b in batches:
            cells, first = features(b.column(1), bits)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(cells, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], names=["positive", "label", "cells"])

    return run


def _sums(w: np.ndarray, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(w[cells])))
    return total[first[1:]] - total[first[:-1]]


def _counts(rows: list[np.ndarray], bits: int) -> np.ndarray:
    """How many rows hold each cell; some rows at a time, so that no copy of all cells is made."""
    out = np.zeros(1 << bits, np.int64)
    for a in range(0, len(rows), 500):
        out += np.bincount(np.concatenate(rows[a : a + 500]), minlength=1 << bits)
    return out


def informative(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS) -> np.ndarray:
    """Which cells are frequent enough, and more so among positives. The negatives' share is the unlabelled texts' less what the
    prior puts down to positives."""
    p, u = (_counts(x, bits) for x in (positive, unlabelled))
    negative = np.maximum(0.0, u / len(unlabelled) - prior * p / len(positive)) / (1 - prior)
    return (p >= max(MIN_POSITIVES, MIN_SHARE * len(positive))) & (p / len(positive) >= LIFT * negative)


def open_share(toxic: list[np.ndarray], clean: list[np.ndarray], unknown: list[np.ndarray], like: float, bits: int = BITS) -> float:
    """The share of toxic texts among those without a label: that of the labelled ones (like), unless an adjusted count says otherwise.
    It is how many hold a cell that tells toxic from clean texts, corrected by how many of the toxic and of the clean ones do; cells are
    chosen on one half of the labelled texts and counted on the other, both ways. It counts if it is further than three standard
    errors from like."""
    found = []
    for k in (0, 1):
        p, c, q, d = toxic[k::2], clean[k::2], toxic[1 - k :: 2], clean[1 - k :: 2]
        if not (p and c and q and d and unknown):
            continue
        cell = [_counts(x, bits) for x in (p, c)]
        used = (cell[0] >= max(MIN_POSITIVES, MIN_SHARE * len(p))) & (cell[0] / len(p) >= LIFT * cell[1] / len(c))
        held = [sum(bool(used[r].any()) for r in x) for x in (q, d, unknown)]
        hit, miss, of = (h / len(x) for h, x in zip(held, (q, d, unknown), strict=True))
        if hit - miss < TELLING:
            continue
        share = min(1.0, max(0.0, (of - miss) / (hit - miss)))
        near = [((h + 0.5) / (len(x) + 1), len(x)) for h, x in zip(held, (q, d, unknown), strict=True)]  # never 0 or 1, so errors are not 0
        error = sum(w * w * r * (1 - r) / n for w, (r, n) in zip((share, 1 - share, 1.0), near, strict=True)) ** 0.5 / (hit - miss)
        found.append((share, error))
    if not found:
        return like
    share, error = (sum(x) / len(found) for x in zip(*found, strict=True))
    return share if abs(share - like) > 3 * error else like


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, epochs: int = 70, rate: float = 0.04, decay: float = 5e-5, batch: int = 3000, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier; logistic loss, Adam, non-negative risk with steps against a negative part."""
    rng = np.random.default_rng(seed)
    used = informative(positive, unlabelled, prior, bits)
    positive, unlabelled = ([r[used[r]] for r in rows] for rows in (positive, unlabelled))
    w, b = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0

    def grads(rows: list[np.ndarray], sign: float):
        """Mean loss log(1 + exp(-sign z)) and its gradient by cell and bias."""
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        cells = np.concatenate([*rows, np.empty(0, np.int32)])
        z = sign * (_sums(w, cells, first) + b)
        d = -sign / (1 + np.exp(np.clip(z, -60, 60))) / max(1, len(rows))
        return float(np.logaddexp(0, -z).mean()) if len(rows) else 0.0, np.bincount(cells, np.repeat(d, np.diff(first)), 1 << bits), float(d.sum())

    for _ in range(epochs):
        pos, unl = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        rounds = max(1, -(-len(unl) // batch))
        for i in range(rounds):
            u = [unlabelled[j] for j in unl[i::rounds]]
            p = [positive[j] for j in pos[i::rounds]] or positive
            _, gp, bp = grads(p, 1.0)
            ln, gn, bn = grads(p, -1.0)
            lu, gu, bu = grads(u, -1.0)
            rest = lu - prior * ln
            if rest >= 0:
                g, gb = prior * gp + gu - prior * gn, prior * bp + bu - prior * bn
            else:
                g, gb = prior * gn - gu, prior * bn - bu
            g = g + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w.astype(np.float32), b


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, bits: int = BITS) -> tuple[np.ndarray, float] | None:
    """A model from the learning rows of docs (doc_id, text) and labels (doc_id, toxic); None without a toxic or any other row.

    A doc_id that is labelled more than once is toxic if any of its labels says so; null labels count as none.
    """
    bounded_batches(docs.sparkSession)
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = saved(learn, "toxicity-labels")
    counts = learn.agg(F.sum("toxic"), F.count("*")).first()
    if not counts[0] or counts[0] == counts[1]:
        return None
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    # the samples are chosen by ids alone; only their texts are read on
    ids = saved(rows.select("doc_id").distinct().join(learn.withColumnRenamed("toxic", "label"), "doc_id", "left").withColumn("label", F.col("label").cast("int")), "toxicity-ids")
    n, labelled, known = ids.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    rank = [F.xxhash64(F.lit(seed), "doc_id") for seed in (11, 12)]
    toxic = ids.where("label = 1").withColumn("positive", F.lit(1)).orderBy(rank[0], "doc_id").limit(max_positive)
    drawn = ids.withColumn("positive", F.lit(0)).orderBy(rank[1], "doc_id").limit(max_unlabelled)
    chosen = saved(toxic.union(drawn), "toxicity-sample")
    sample = rows.join(F.broadcast(chosen), "doc_id").select("positive", "text", "label").mapInArrow(released(_cells(bits)), "positive int, label int, cells array<int>")
    got: dict[int, list[np.ndarray]] = {0: [], 1: []}
    by_label: dict[int | None, list[np.ndarray]] = {0: [], 1: [], None: []}
    for r in sample.toArrow().to_batches():
        for k, label, cells in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2), strict=True):
            got[k].append(cells.values.to_numpy())  # a view, no copy
            if k == 0:
                by_label.setdefault(label, []).append(got[k][-1])
    if not got[0] or not got[1]:
        return None
    for k in (*got.values(), *by_label.values()):  # the order of rows must not matter
        k.sort(key=lambda c: c.tobytes())
    rest = open_share(got[1], by_label[0], by_label[None], counts[0] / counts[1], bits)
    prior = (known + (n - labelled) * rest) / n
    prior = min(prior, 1 - 0.5 / n)
    model = fit(got[1], got[0], prior, bits)
    del got, by_label, k, cells, r
    release()
    return model


def _score(model, bits: int):
    def run(batches):
        w, bias = model.value
        for b in batches:
            cells, first = features(b.column(1), bits)
            z = _sums(w.astype(np.float64), cells, first) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["key", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(key, score) for every row of docs (key, text). Null text is empty; without a model every score is 0."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score"))
    kind = dict(docs.dtypes)[key]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(released(_score(sent, bits)), f"key {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    model = train(docs, labels)
    row = docs.select(F.col("text"), F.struct(*docs.columns).alias("row"))
    scored = score(row, model, "row")
    return scored.where(F.col("score") < threshold).select("key.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, from a model that has never seen labels of the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
