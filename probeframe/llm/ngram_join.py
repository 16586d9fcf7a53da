"""Exact Jaccard join of documents over word shingles, with skipping by set relations.

A document's set: its distinct shingles of five consecutive words (A-Z in lower case, words are runs of anything but \\x20 and
\\x09-\\x0D); a shorter text is one shingle; without words or text the set is empty and links with nothing. Two documents link
when 100 * |intersection| >= 75 * |union|.

1. Equal sets are one class, kept by its smallest doc_id. From here on only classes take part.
2. Order: elements are ordered by (document frequency, hash). Linked sets of size n share one of their first
   n - ceil(0.75 n) + 1 elements (their prefix) under any common order; what occurs in one set only comes first and is shared with
   nothing. So a set whose prefix is made of such elements is out. A sieve finds these sets from the lower half of the hash
   space alone; full frequencies are then counted among the sets that are left. Elements travel as packed arrays, one for each
   (chunk of sets, bucket of elements), and those that several sets of a chunk have travel once.
3. Near groups first: sets with an equal minimum hash, under WAYS hashes, meet in blocks of bounded size. A block's sets are asked
   against an index of the block one after the other, and a set's answers are derived from those of the set before it by the
   elements in which the two differ, where these are fewer. Linked sets become components.
4. Index lists: each element of a prefix has a list of (block, position, sizes). Elements whose sets are all in one component are
   dropped, for answers within a component follow from its links. A set skips a block of its list when all of it belongs to the
   set's own component, or when sizes, the block's first position or its own position cannot give the overlap.
5. What is left is asked against whole blocks as in 3; so large groups cost one row for each set and block, not for each pair.
   Components of all links are found by alternating stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, only_listed, released, saved
from .words import LOWER, grams, mix, word_table

SHINGLE = 5
#: Link when SHARE[1] * |intersection| >= SHARE[0] * |union|.
SHARE = (75, 100)
#: The sieve looks at elements below 2^SIEVE.
SIEVE = 63
#: Elements of a bucket and of a chunk, sets of a chunk; buckets at least.
BUCKET, CHUNK, CHUNK_SETS, BUCKETS = 1 << 20, 1 << 19, 60_000, 64
#: Sets and elements of a block, about.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 20
#: Minimum hashes under which near sets meet first.
WAYS = 4
#: Members that are asked against one copy of a block.
RUN = 500

_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * w + 1) % 2**64) for w in range(WAYS)]


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a text column."""
    _, _, h, first = word_table(column, LOWER)
    out = []
    all_grams = grams(h, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        elif b > a:
            out.append(grams(h[a:b], int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def missing_most(n, share: tuple[int, int] = SHARE):
    """How many elements of a set of n a linked set may lack."""
    return n - -(-n * share[0] // share[1])


def _describe(batches):
    """(doc_id, size of the set, two hashes of the set)."""
    for b in batches:
        n, k1, k2 = [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            k1.append(int(np.sum(mix(s), dtype=np.uint64).view(np.int64)))
            k2.append(int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["doc_id", "n", "k1", "k2"])


class Dealt:
    """The elements of a chunk of sets, dealt into buckets: those of one set alone (in order of bucket and set), and the others."""

    def __init__(self, sets: list[np.ndarray], bits: int, buckets: int):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        log, ends = buckets.bit_length() - 1, np.arange(buckets + 1)
        self.order = np.argsort(self.flat, kind="stable")
        s = self.flat[self.order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
        times = np.diff(np.append(first, len(s)))
        self.lone = np.zeros(len(s), dtype=bool)
        self.lone[self.order[first[times == 1]]] = True
        self.multi, self.times, self.first = s[first[times > 1]], times[times > 1], first[times > 1]
        at = (self.flat[self.lone] >> np.uint64(bits - log)).astype(np.uint32)
        by = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
        self.single = np.flatnonzero(self.lone)[by]
        self.edges = np.searchsorted(at[by], ends)
        self.multi_edges = np.searchsorted((self.multi >> np.uint64(bits - log)).astype(np.int64), ends)
        self.left = np.uint64(64 - bits + log)

    def short(self, tokens: np.ndarray) -> np.ndarray:
        """What tells the elements of a bucket apart, in 32 bits; where two share it, both count as more frequent than they are."""
        return ((tokens << self.left) >> np.uint64(32)).astype("<u4")

    def rows(self, chunk: int, owners: bool):
        """(chunk, bucket, kind 1, owners, singles, multis, times) of the buckets that are not empty."""
        for k in np.flatnonzero((np.diff(self.edges) > 0) | (np.diff(self.multi_edges) > 0)).tolist():
            i, m = self.single[self.edges[k] : self.edges[k + 1]], slice(self.multi_edges[k], self.multi_edges[k + 1])
            yield chunk, k, 1, self.owner[i].astype("<u2").tobytes() if owners else None, self.short(self.flat[i]).tobytes(), self.short(self.multi[m]).tobytes(), self.times[m].astype("<u4").tobytes()


DEALT = "chunk long, bucket int, kind int, owners binary, singles binary, multis binary, times binary"
_DEALT = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _sieve(buckets: int, share: tuple[int, int]):
    """(doc_id, text) -> rows of Dealt for chunks of sets, and for each chunk a row of kind 0: the ids, how many elements below
    2^SIEVE may occur in one set only, and how many are known to occur in several. A chunk is named by its task and number in it: rows
    come from a scan, or sorted by doc_id, so a task that is run again makes the same chunks."""
    limit = np.uint64(1 << SIEVE)

    def chunk(name: int, ids: list[int], sets: list[np.ndarray]):
        dealt = Dealt([s[: int(np.searchsorted(s, limit))] for s in sets], SIEVE, buckets)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        spare = dealt.sizes - missing_most(size, share) - 1  # as many of the low ones as this, or more, must be shared
        known = np.bincount(dealt.owner[~dealt.lone], minlength=len(sets))
        yield name, name % buckets, 0, np.array(ids, "<i8").tobytes(), spare.astype("<i8").tobytes(), known.astype("<i8").tobytes(), None
        yield from dealt.rows(name, True)

    def run(batches):
        ids, sets, total, name = [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for who, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                if not len(s):
                    continue
                ids.append(who)
                sets.append(s)
                total += len(s)
                if total >= CHUNK or len(ids) >= CHUNK_SETS:
                    yield _batch(list(chunk(name, ids, sets)), _DEALT, DEALT)
                    ids, sets, total, name = [], [], 0, name + 1
        if ids:
            yield _batch(list(chunk(name, ids, sets)), _DEALT, DEALT)

    return run


def _deal(buckets: int):
    """(chunk, doc_id, text), sorted by chunk -> rows of Dealt, all elements."""

    def run(batches):
        for chunk, _, sets, _ in _chunks(batches):
            yield _batch(list(Dealt(sets, 64, buckets).rows(chunk, False)), _DEALT, DEALT)

    return run


def _chunks(batches):
    """(chunk, ids, sets, counts) of rows (chunk, kind, bucket, doc_id, text, singles, multis), sorted by the first three."""
    key, ids, sets, counts = None, [], [], []
    for b in batches:
        fields = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
        for (chunk, kind, bucket, who, singles, multis), s in zip(zip(*fields, strict=True), shingle_sets(b.column(4)), strict=True):
            if chunk != key:
                if ids:
                    yield key, ids, sets, counts
                key, ids, sets, counts = chunk, [], [], []
            if kind == 0:
                ids.append(who)
                sets.append(s)
            else:
                counts.append((bucket, singles, multis))
    if ids:
        yield key, ids, sets, counts


def _count(full: bool):
    """Rows of Dealt sorted by bucket -> (chunk, bucket, kind, a, b): document frequencies of singles and multis (full), or how many
    of the singles of which sets occur in several. Rows of kind 0 are passed on."""

    def settle(bucket: int, rows: list[tuple]):
        singles = [np.frombuffer(r[4], "<u4") for r in rows]
        multis = [np.frombuffer(r[5], "<u4") for r in rows]
        values = np.concatenate(singles + multis)
        weights = np.concatenate([np.ones(sum(map(len, singles)), np.int64), *[np.frombuffer(r[6], "<u4") for r in rows]])
        order = np.argsort(values, kind="stable")
        v = values[order]
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), v[1:] != v[:-1])))
        total, v = np.add.reduceat(weights[order], first), v[first]
        for r, s, m in zip(rows, singles, multis, strict=True):
            df = total[np.searchsorted(v, s)]
            if full:
                yield r[0], bucket, 1, np.minimum(df, 65535).astype("<u2").tobytes(), np.minimum(total[np.searchsorted(v, m)], 65535).astype("<u2").tobytes()
            else:
                who, times = np.unique(np.frombuffer(r[3], "<u2")[df > 1], return_counts=True)
                if len(who):
                    yield r[0], bucket, 1, who.tobytes(), times.astype("<u4").tobytes()

    def run(batches):
        key, held = None, []
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[1] != key:
                    out += settle(key, held) if held else []
                    key, held = r[1], []
                if r[2] == 0:
                    out += [(r[0], r[1], 0, r[3], r[4]), (r[0], r[1], -1, r[5], None)]
                else:
                    held.append(r)
            yield _batch(out, _COUNTED, COUNTED)
        if held:
            yield _batch(list(settle(key, held)), _COUNTED, COUNTED)

    return run


COUNTED = "chunk long, bucket int, kind int, a binary, b binary"
_COUNTED = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _survivors(batches):
    """Rows (chunk, kind, a, b) sorted by chunk and kind -> doc_id of the sets that the sieve leaves."""
    key, known, ids, spare = None, np.empty(0, np.int64), None, None

    def left():
        return np.empty(0, np.int64) if ids is None else ids[known > spare]

    for b in batches:
        out = []
        for chunk, kind, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk != key:
                out.append(left())
                key, ids = chunk, None
            if kind == -1:
                known = np.frombuffer(x, "<i8").copy()
            elif kind == 0:
                ids, spare = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
            else:
                known[np.frombuffer(x, "<u2")] += np.frombuffer(y, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.empty(0, np.int64)]))], names=["doc_id"])
    yield pa.RecordBatch.from_arrays([pa.array(left())], names=["doc_id"])


PREFIX = "rep long, n int, alone int, tokens array<long>, ways array<long>"


def _prefixes(buckets: int, share: tuple[int, int]):
    """(chunk, kind, bucket, doc_id, text, a, b) sorted by the first three -> PREFIX: of each set that can have links, the elements of its
    prefix that other sets have too, in order, how many come before them, and WAYS minimum hashes of its elements."""

    def run(batches):
        for _, ids, sets, counts in _chunks(batches):
            dealt = Dealt(sets, 64, buckets)
            df = np.empty(len(dealt.flat), np.int64)
            df[dealt.single] = np.concatenate([np.empty(0, "<u2"), *[np.frombuffer(c[1], "<u2") for c in counts]])
            of = np.concatenate([np.empty(0, "<u2"), *[np.frombuffer(c[2], "<u2") for c in counts]]).astype(np.int64)
            spread = np.repeat(dealt.first - np.concatenate(([0], np.cumsum(dealt.times)[:-1]))[: len(dealt.times)], dealt.times) + np.arange(dealt.times.sum())
            df[dealt.order[spread]] = np.repeat(of, dealt.times)
            start = np.concatenate(([0], np.cumsum(dealt.sizes)))
            rows = []
            for i, s in enumerate(sets):
                d = df[start[i] : start[i + 1]]
                alone, need = int((d == 1).sum()), missing_most(len(s), share) + 1
                if not len(s) or alone >= need:
                    continue
                some = np.flatnonzero(d > 1)
                some = some[np.argsort(d[some], kind="stable")][: need - alone]
                if len(some):
                    rows.append((ids[i], len(s), alone, s[some].view(np.int64), [int(mix(s ^ x).min().view(np.int64)) for x in _SEEDS]))
            longs = pa.list_(pa.int64())
            yield _batch(rows, [pa.int64(), pa.int32(), pa.int32(), longs, longs], PREFIX)

    return run


class Index:
    """Lists of the elements of a block's sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def hits(self, s: np.ndarray) -> np.ndarray:
        """How many elements of s each of the block's sets has."""
        at = np.searchsorted(self.tokens, s)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == s]
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        lists = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n) + np.arange(n.sum())
        return np.bincount(self.owner[lists], minlength=len(self.size))

    def answers(self, s: np.ndarray) -> np.ndarray:
        """As hits; derived from the last set's answers where that differs from s by less than s has."""
        if self.last is not None:
            old, known = self.last
            more, less = np.setdiff1d(s, old, assume_unique=True), np.setdiff1d(old, s, assume_unique=True)
            if len(more) + len(less) < len(s):
                self.last = (s, known + self.hits(more) - self.hits(less))
                return self.last[1]
        self.last = (s, self.hits(s))
        return self.last[1]


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return _batch(rows, [pa.int64(), pa.int64()], "a long, b long")


def _near(share: tuple[int, int]):
    """(block, rep, text) sorted by block -> links within blocks, one for each component that a set joins."""

    def links(ids: list[int], sets: list[np.ndarray]):
        index, label = Index(sets), np.arange(len(sets))
        for i in np.argsort(index.size, kind="stable"):
            inter = index.answers(sets[i])
            linked = (label != label[i]) & (share[1] * inter >= share[0] * (index.size + len(sets[i]) - inter))
            if linked.any():
                ends, one = np.unique(label[linked], return_index=True)
                for j in np.flatnonzero(linked)[one].tolist():
                    if ids[i] != ids[j]:
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])
                label[np.isin(label, ends)] = label[i]

    def run(batches):
        key, ids, sets = None, [], []
        for b in batches:
            out: list[tuple[int, int]] = []
            for block, who, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2)), strict=True):
                if block != key:
                    out += links(ids, sets) if len(ids) > 1 else []
                    key, ids, sets = block, [], []
                if len(s):
                    ids.append(who)
                    sets.append(s)
            yield _edges(out)
        if len(ids) > 1:
            yield _edges(list(links(ids, sets)))

    return run


def _block_links(share: tuple[int, int]):
    """Rows sorted by (block, run, kind, comp): the block's sets, then the sets that are asked against all of them."""

    def run(batches):
        key, held, index = None, [], None
        for b in batches:
            out: list[tuple[int, int]] = []
            fields = [b.column(i).to_pylist() for i in range(5)]
            for block, part, kind, who, comp, s in zip(*fields, shingle_sets(b.column(5)), strict=True):
                if (block, part) != key:
                    key, held, index = (block, part), [], None
                if not len(s):
                    continue
                if kind == 0:
                    held.append((who, comp, s))
                    continue
                if not held:
                    continue
                if index is None:
                    ids, comps, index = np.array([h[0] for h in held]), np.array([h[1] for h in held]), Index([h[2] for h in held])
                inter = index.answers(s)
                linked = np.flatnonzero((ids < who) & (comps != comp) & (share[1] * inter >= share[0] * (index.size + len(s) - inter)))
                if len(linked):  # one link to each component will do
                    _, one = np.unique(comps[linked], return_index=True)
                    out += [(int(ids[i]), who) for i in linked[one]]
            yield _edges(out)

    return run


def block_links(asked: DataFrame, node: DataFrame, texts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): links between components among the sets of a block and those asked against it (block, rep), from whole texts.

    A block is read once for each run of at most RUN sets that are asked; every set of the block is compared in one pass over an
    index of the block, so a pair costs no row.
    """
    counts = asked.groupBy("block").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    known = node.select("rep", "comp").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    runs = F.pmod(F.xxhash64("rep"), F.col("runs")).cast("int")
    members = asked.join(counts, "block").select("block", runs.alias("run"), F.lit(1).alias("kind"), "rep").join(known, "rep")
    blocks = node.join(counts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind"), "rep").join(known, "rep")
    fields = ["block", "run", "kind", "rep", "comp", "text"]
    rows = blocks.select(*fields).union(members.select(*fields)).repartition("block", "run").sortWithinPartitions("block", "run", "kind", "comp")
    return rows.mapInArrow(released(_block_links(share)), "a long, b long")


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def left_by_sieve(texts: DataFrame, elements: int, share: tuple[int, int]) -> DataFrame:
    """doc_id of the rows of texts (doc_id, text) whose sets may have links."""
    buckets = max(BUCKETS, _power(elements / 2 / BUCKET))
    dealt = texts.mapInArrow(released(_sieve(buckets, share)), DEALT).repartition("bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(released(_count(False)), COUNTED).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return counted.select("chunk", "kind", "a", "b").mapInArrow(released(_survivors), "doc_id long")


def prefixes(texts: DataFrame, elements: int, share: tuple[int, int]) -> DataFrame:
    """PREFIX of texts (doc_id, text), by the document frequencies among them."""
    buckets, chunks = max(BUCKETS, _power(elements / BUCKET)), max(BUCKETS, _power(elements / CHUNK))
    none = [F.lit(None).cast("binary").alias(c) for c in "ab"]
    rows = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "doc_id", "text", *none)
    inside = rows.repartition("chunk").sortWithinPartitions("chunk", "doc_id", "text")
    counted = inside.mapInArrow(released(_deal(buckets)), DEALT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_count(True)), COUNTED)
    back = counted.select("chunk", "kind", "bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "a", "b")
    both = rows.union(back).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket", "doc_id", "text")
    return both.mapInArrow(released(_prefixes(buckets, share)), PREFIX)


def near_links(kept: DataFrame, texts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): links among sets that share a minimum hash, from whole texts."""
    meet = kept.select("rep", "n", F.posexplode("ways").alias("way", "low"))
    groups = meet.groupBy("way", "low").agg(F.count("*").alias("c"), F.sum("n").alias("e")).where("c > 1")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("e") / BLOCK_ELEMENTS))
    deal = F.xxhash64("way", "low", F.pmod(F.xxhash64("way", "rep"), blocks))
    meet = meet.join(groups, ["way", "low"]).select(deal.alias("block"), F.col("rep").alias("doc_id"))
    rows = meet.join(texts, "doc_id").select("block", "doc_id", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(released(_near(share)), "a long, b long")


def linked_components(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Null or wordless text: 0 shingles, a component of its own. Rows without doc_id: component null, and they link with nothing.
    Several rows of one doc_id: each row is returned; they are one node, linked by any of their texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = saved(docs.mapInArrow(released(_describe), "doc_id long, n int, k1 long, k2 long"), "ngram-described")
    # written, so that the join shuffles both sides and a class of very many copies can be split
    classes = saved(described.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    members = saved(described.join(classes.hint("merge"), ["k1", "k2", "n"], "left").select("doc_id", "n", "rep"), "ngram-members")
    reps = saved(members.where("rep = doc_id").groupBy("rep").agg(F.sum("n").alias("n")).select(F.col("rep").alias("doc_id"), "n"), "ngram-reps")
    # rows of one doc_id in several classes link these
    joined = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("b")).where("size(b) > 1")
    joined = joined.select("a", F.explode("b").alias("b")).where("a <> b")

    texts = only_listed(docs.where("text is not null and doc_id is not null"), reps.select("doc_id"), "doc_id")
    elements = reps.agg(F.sum("n")).first()[0] or 0
    alive = saved(left_by_sieve(texts, elements, share).distinct(), "ngram-alive")
    texts = saved(only_listed(texts, alive, "doc_id"), "ngram-texts")
    elements = alive.join(reps, "doc_id").agg(F.sum("n")).first()[0] or 0
    kept = saved(prefixes(texts, elements, share), "ngram-prefixes")

    near = saved(near_links(kept, texts, share).union(joined), "ngram-near")
    comps = saved(components(near, "ngram-components"), "ngram-components")

    # sets with one lowest element stand in blocks; a list then names blocks in place of sets
    node = kept.select("rep", "n", F.array_min(F.transform("tokens", lambda t: F.xxhash64(t))).alias("home"))
    many = node.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"))
    node = node.groupBy("rep").agg(F.min("home").alias("home")).join(many, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block"))
    node = node.join(comps, node.rep == comps.node, "left").select("rep", "block", F.coalesce("component", "rep").alias("comp"))
    node = saved(node, "ngram-blocks")
    entry = kept.select("rep", "n", "alone", F.posexplode("tokens").alias("i", "token")).select("rep", "n", "token", (F.col("alone") + F.col("i")).alias("pos"))
    entry = saved(entry.join(node, "rep"), "ngram-lists")
    crossing = entry.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    entry = saved(entry.join(crossing, "token"), "ngram-crossing")
    named = entry.groupBy("token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("rep").alias("least"))
    x, y = named.alias("x"), entry.alias("y")
    sizes = f"{share[1]} * x.hi >= {share[0]} * y.n and {share[1]} * y.n >= {share[0]} * x.lo"
    smallest = f"greatest(x.lo, cast(ceil(y.n * {share[0]}D / {share[1]}) as int))"
    overlap = f"cast(ceil({share[0]}D * (y.n + {smallest}) / {sum(share)}) as int)"
    asked = x.join(y, F.expr(f"x.token = y.token and x.least < y.rep and not (x.c0 = y.comp and x.c1 = y.comp) and {sizes} and y.n - y.pos >= {overlap} and x.rest >= {overlap}"))
    asked = saved(asked.select(F.col("x.block").alias("block"), F.col("y.rep").alias("rep")).distinct(), "ngram-asked")
    edges = saved(near.union(block_links(asked, node, texts, share)), "ngram-links")
    final = components(edges, "ngram-components")

    out = members.join(final, members.rep == final.node, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that have a linked document of smaller doc_id in their component; rows without doc_id stay, and so do
    all rows of a doc_id that stays."""
    parts = linked_components(docs)
    gone = parts.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and the smallest doc_id that links lead to."""
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
     s as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0),
     g as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle from s),
     n as (select doc_id, count(*) as n from g group by doc_id),
     c as (select a.doc_id as x, b.doc_id as y, count(*) as i from g a join g b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
     l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 75 * (p.n + q.n - i)),
     r(a, b) as (select doc_id, doc_id from w union select r.a, l.y from r join l on l.x = r.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(b) from r where r.a = w.doc_id) as component_id from w left join n using (doc_id)
"""
