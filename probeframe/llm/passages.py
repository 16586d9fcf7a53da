"""Removal of passages that repeat across documents, located by Aho-Corasick automata.

A window is WINDOW consecutive words (runs of anything but \\x20 and \\x09-\\x0D, unchanged) of one document. A word goes if a
window that covers it also starts in a document of smaller doc_id. Windows are judged on the input.

1. Documents of equal words are one class, kept by the smallest doc_id; of the others all words go (if they fill a window).
2. Every window has a pick: the phrase of PHRASE words in it with the smallest hash. Equal windows have equal picks, and a
   document has few of them (about 2 / 36 of its words). A phrase picked in two or more documents is confirmed as recurring; the
   smallest document that picks it owns it. All windows that repeat have a recurring pick.
3. Documents send the stretches around their recurring picks (all windows with that pick lie within) to the owners. An owner's
   phrases are compiled into an automaton, over one character for each word, and the stretches are streamed through it to locate
   every occurrence. Windows around an occurrence that the owner has too are repeats of it. A popular owner is spread over many
   tasks, by copies of its own stretches; no task holds more than one stretch and one owner's stretches at a time.
4. Windows around an occurrence that the owner does not have may repeat between the others: their hashes meet in a
   pre-aggregated minimum of doc_id, and those of larger doc_id are repeats.

Windows are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only_listed, saved
from .words import grams, mix, text_buffer, windows, word_table

WINDOW, PHRASE = 50, 16
#: Stretches that are compared with one copy of their owner's.
RUN = 250


def picks(h: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hash, position) of the picks of all windows of a document's word hashes, each position once."""
    g = grams(h, phrase)
    span = window - phrase + 1
    if len(g) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best = np.argmin(np.lib.stride_tricks.sliding_window_view(g, span), axis=1) + np.arange(len(g) - span + 1)
    at = np.unique(best)
    return g[at], at


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[a:e].tobytes() for a, e in zip(starts, ends, strict=True)])


def _describe(window: int, phrase: int):
    def run(batches):
        for b in batches:
            data, edges = text_buffer(b.column(1))
            _, _, h, first = word_table(b.column(1))
            raw = data.tobytes()
            n, k1, k2, sha, found, places, sizes = [], [], [], [], [], [], [0]
            for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)):
                own = h[x:y]
                n.append(int(y - x))
                sha.append(hashlib.sha256(b" ".join(raw[edges[i] : edges[i + 1]].split())).hexdigest())
                whole = [int(windows(own, len(own), w)[0].view(np.int64)) if len(own) else 0 for w in (0, 1)]
                k1.append(whole[0])
                k2.append(whole[1])
                p, at = picks(own, window, phrase)
                found.append(p.view(np.int64))
                places.append(at)
                sizes.append(sizes[-1] + len(p))
            none = [np.empty(0, np.int64)]
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(none + x), pa.int64())) for x in (found, places)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha), *lists], names=["doc_id", "t", "n_words", "k1", "k2", "sha", "picks", "places"])

    return run


def _stretches(window: int, phrase: int):
    """(doc_id, text, t, list of {owner, place}) -> (owner, doc_id, t, start, text of the stretch, places of the picks in it)."""

    def run(batches):
        for b in batches:
            data, _ = text_buffer(b.column(1))
            s, e, _, first = word_table(b.column(1))
            out: list[tuple] = []
            for i, (doc, t, wanted) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 2, 3)), strict=True)):
                n, base = int(first[i + 1] - first[i]), first[i]
                wanted.sort(key=lambda w: (w["owner"], w["place"]))
                j = 0
                while j < len(wanted):
                    owner, lo = wanted[j]["owner"], max(0, wanted[j]["place"] - (window - phrase))
                    hi, places = min(n, wanted[j]["place"] + window), [wanted[j]["place"]]
                    j += 1
                    while j < len(wanted) and wanted[j]["owner"] == owner and wanted[j]["place"] - (window - phrase) <= hi:
                        hi = min(n, wanted[j]["place"] + window)
                        places.append(wanted[j]["place"])
                        j += 1
                    out.append((owner, doc, t, lo, data[s[base + lo] : e[base + hi - 1]].tobytes(), [p - lo for p in places]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["owner", "doc_id", "t", "start", "stretch", "places"])

    return run


class Owner:
    """The automaton of an owner's phrases and the hashes of its windows."""

    def __init__(self, window: int, phrase: int):
        import ahocorasick

        self.window, self.phrase, self.machine, self.made = window, phrase, ahocorasick.Automaton(), False
        self.first, self.second = [], []

    @staticmethod
    def letters(h: np.ndarray) -> str:
        """One character for each word; words that share one are told apart later."""
        return (np.uint32(0x10000) + (mix(h) >> np.uint64(44)).astype(np.uint32) % np.uint32(0xFFFFF)).astype("<u4").tobytes().decode("utf-32-le")

    def add(self, h: np.ndarray, places: list[int]) -> None:
        text = self.letters(h)
        for p in places:
            self.machine.add_word(text[p : p + self.phrase], 1)
        self.first.append(windows(h, self.window, 0))
        self.second.append(windows(h, self.window, 1))

    def locate(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, repeated, hash, hash): the windows of h around located phrases, and whether the owner has them."""
        if not self.made:
            self.machine.make_automaton()
            self.first, self.second = np.concatenate(self.first), np.concatenate(self.second)
            order = np.argsort(self.first, kind="stable")
            self.first, self.second, self.made = self.first[order], self.second[order], True
        n = len(h) - self.window + 1
        near = np.zeros(max(n, 0) + 1, dtype=np.int64)
        if n > 0 and len(self.machine):
            for end, _ in self.machine.iter(self.letters(h)):
                p = end - self.phrase + 1
                a, z = max(0, p - (self.window - self.phrase)), min(n, p + 1)
                if z > a:
                    near[a] += 1
                    near[z] -= 1
        starts = np.flatnonzero(np.cumsum(near)[:-1])
        f, g = windows(h, self.window, 0)[starts], windows(h, self.window, 1)[starts]
        at, to = np.searchsorted(self.first, f), np.searchsorted(self.first, f, side="right")
        same = np.zeros(len(starts), dtype=bool)
        once = to > at
        same[once] = self.second[at[once]] == g[once]
        for i in np.flatnonzero(to > at + 1):
            same[i] = bool((self.second[at[i] : to[i]] == g[i]).any())
        return starts, same, f, g


def _locate(window: int, phrase: int):
    """Rows sorted by (owner, run, kind): the owner's own stretches, then those of others."""

    def run(batches):
        key, owner = None, None
        for b in batches:
            out: list[tuple] = []
            _, _, h, first = word_table(b.column(5).cast(pa.large_binary()).cast(pa.large_string()))
            for i, (who, part, kind, doc, start, places, t) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 3, 4, 6, 7)), strict=True)):
                if (who, part) != key:
                    key, owner = (who, part), Owner(window, phrase)
                own = h[first[i] : first[i + 1]]
                if kind == 0:
                    owner.add(own, places)
                elif owner.first is not None and len(owner.first):
                    starts, same, f, g = owner.locate(own)
                    for on in (True, False):
                        rows = np.flatnonzero(same == on)
                        if len(rows):
                            out.append((doc, t, (starts[rows] + start).tolist(), None if on else f[rows].view(np.int64).tolist(), None if on else g[rows].view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), longs, longs, longs], strict=True)], names=["doc_id", "t", "starts", "f", "g"])

    return run


def _cut(window: int):
    def run(batches):
        for b in batches:
            data, _ = text_buffer(b.column(1))
            s, e, _, first = word_table(b.column(1))
            gone, sha = [], []
            for i, starts in enumerate(b.column(3)):
                n = int(first[i + 1] - first[i])
                at = starts.values.to_numpy()
                cover = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + window, n), minlength=n + 1)[: n + 1]
                kept = np.cumsum(cover)[:n] <= 0
                gone.append(int(n - kept.sum()))
                x, y = s[first[i] : first[i + 1]][kept], e[first[i] : first[i + 1]][kept]
                sha.append(hashlib.sha256(_joined(data, x, y)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "t", "n_removed", "kept_sha256"])

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text).

    Null text has no words. Rows without doc_id keep all their words, and nothing goes because of them. Rows of one doc_id are
    one document to others but judged each by its own text (t is its hash), so equal ones get equal results.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    described = docs.mapInArrow(_describe(window, phrase), "doc_id long, t long, n_words long, k1 long, k2 long, sha string, picks array<long>, places array<long>")
    facts = saved(described, "passages-facts")
    known = facts.where(f"doc_id is not null and n_words >= {window}")
    least = F.min(F.struct("doc_id", "t", F.arrays_zip(F.col("picks").alias("pick"), F.col("places").alias("place")).alias("p"))).alias("x")
    classes = known.groupBy("k1", "k2", "n_words").agg(least)
    classes = saved(classes.select("k1", "k2", "n_words", F.col("x.doc_id").alias("rep"), F.col("x.t").alias("rep_t"), "x.p"), "passages-classes")
    each = classes.select("rep", "rep_t", F.explode("p").alias("p")).select("rep", "rep_t", F.col("p.pick").alias("pick"), F.col("p.place").alias("place"))
    # written, so that the join shuffles both sides and a pick that very many documents have can be split
    owners = each.groupBy("pick").agg(F.min("rep").alias("owner"), F.max("rep").alias("last")).where("owner < last").select("pick", "owner")
    owners = saved(owners, "passages-confirmed")
    wanted = each.join(owners.hint("merge"), "pick").groupBy(F.col("rep").alias("doc_id"), F.col("rep_t").alias("t")).agg(F.collect_list(F.struct("owner", "place")).alias("wanted"))
    wanted = saved(wanted, "passages-wanted")
    texts = only_listed(docs.where("text is not null"), wanted.select("doc_id"), "doc_id")
    cut = texts.join(wanted, ["doc_id", "t"]).select("doc_id", "text", "t", "wanted").mapInArrow(_stretches(window, phrase), "owner long, doc_id long, t long, start long, stretch binary, places array<long>")
    cut = saved(cut, "passages-stretches")
    others = cut.where("owner <> doc_id")
    parts = others.groupBy("owner").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    own = cut.where("owner = doc_id").join(parts, "owner").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).withColumn("kind", F.lit(0))
    rest = others.join(parts, "owner").withColumn("run", F.pmod(F.xxhash64("doc_id", "t", "start"), "runs").cast("int")).withColumn("kind", F.lit(1))
    fields = ["owner", "run", "kind", "doc_id", "start", "stretch", "places", "t"]
    rows = own.select(*fields).union(rest.select(*fields)).repartition("owner", "run").sortWithinPartitions("owner", "run", "kind")
    located = saved(rows.mapInArrow(_locate(window, phrase), "doc_id long, t long, starts array<long>, f array<long>, g array<long>"), "passages-located")

    repeats = located.where("f is null").select("doc_id", "t", "starts")
    open_ = located.where("f is not null").select("doc_id", "t", F.explode(F.arrays_zip("starts", "f", "g")).alias("w")).select("doc_id", "t", F.col("w.starts").alias("at"), F.col("w.f").alias("f"), F.col("w.g").alias("g"))
    least = open_.groupBy("f", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("f", "g", "least")
    more = open_.join(saved(least, "passages-least").hint("merge"), ["f", "g"]).where("doc_id > least").groupBy("doc_id", "t").agg(F.collect_set("at").alias("starts"))
    starts = repeats.union(more).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    starts = saved(starts, "passages-starts")
    hit = only_listed(docs.where("text is not null"), starts.select("doc_id"), "doc_id").join(starts, ["doc_id", "t"])
    done = hit.select("doc_id", "text", "t", "starts").mapInArrow(_cut(window), "doc_id long, t long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "t"])

    # a class's result is that of its representative
    empty = hashlib.sha256(b"").hexdigest()
    reps = classes.select("k1", "k2", "n_words", "rep", "rep_t")
    out = saved(facts.select("doc_id", "n_words", "k1", "k2", "sha").join(reps.hint("merge"), ["k1", "k2", "n_words"], "left"), "passages-members")
    own = F.col("rep").isNotNull() & (F.col("doc_id") == F.col("rep"))
    heads = out.where(own).join(done.select(F.col("doc_id").alias("rep"), F.col("t").alias("rep_t"), "n_removed", "kept_sha256"), ["rep", "rep_t"], "left")
    heads = heads.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    copy = F.col("rep").isNotNull()
    rest = out.where(~F.coalesce(own, F.lit(False)))
    return heads.union(rest.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(0), F.when(copy, empty).otherwise(F.col("sha"))))


def op7_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that repeat smaller documents' passages taken out."""
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
     s as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
     g as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as win from s),
     m as (select win, min(doc_id) as least from g group by win),
     hit as (select g.doc_id, g.i from g join m using (win) where g.doc_id > m.least),
     gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from hit),
     each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
     kept as (select each.doc_id, count(*) as n, string_agg(word, ' ' order by each.p) as words from each anti join gone on each.doc_id = gone.doc_id and each.p = gone.p group by each.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.words, '')) as kept_sha256
from w left join kept using (doc_id)
"""
