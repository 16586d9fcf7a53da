"""Operators on texts against brute-force versions, planted cases, edge cases and empty tables."""

import ctypes
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probeframe.llm import common, line_dedup, mixing, ngram_join, passages, spot_signatures, toxicity, words


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")


def test_word_table():
    texts = ["a b\x0bc", "", None, " x  y ", "é é", "z" * 5000, "q"]
    for step in (3, 1 << 16):
        s, e, h, first = words.word_table(pa.array(texts), step=step)
        data, _ = words.text_buffer(pa.array(texts))
        got = [[data[a:b].tobytes() for a, b in zip(s[x:y], e[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
        assert got == [(t or "").encode().split() for t in texts]
    w = words.windows(h := np.arange(300, dtype=np.uint64) ** 3, 50)
    assert (words.windows(h[7:], 50) == w[7:]).all() and len(set(w.tolist())) == len(w)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 100), (200, 200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


# line dedup


def one_edit_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def repeated_lines(docs, least=8):
    """(doc_id, line) of the lines that an earlier line is within the bound of, by comparing all pairs of distinct lines."""
    first, out, lines = {}, set(), []
    for i in sorted(docs):
        for k, line in enumerate((docs[i] or "").split("\n")):
            w = tuple(line.encode().split())
            if w:
                first.setdefault(w, (i, k))
                lines.append((i, k, w))
    units = {w: (0, w) if len(w) >= least else (1, b" ".join(w).decode()) for w in first}
    near = {w: min([p for v, p in first.items() if v != w and units[v][0] == units[w][0] and min(len(units[v][1]), len(units[w][1])) >= least and one_edit_apart(units[v][1], units[w][1])], default=(1 << 60, 0)) for w in first}
    return {(i, k) for i, k, w in lines if min(first[w], near[w]) < (i, k)}


def edited(rng, line):
    w = line.split()
    for _ in range(rng.choice([0, 1, 1, 2])):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1])] = [rng.choice("abcdef")] * rng.choice([0, 1])
    return " ".join(w)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdef") for _ in range(10)) for _ in range(20)]
    docs = {i: "\n".join(edited(rng, rng.choice(base)) for _ in range(8)) for i in range(60)} | {900: None, 901: "", 902: "\n \n"}
    short = ["The anhely eran.", "a b c d e f g", "größe 漢字 und so", "abcdefgh", "abcdefg"]
    for i in range(100, 140):
        lines = [list(rng.choice(short)) for _ in range(4)]
        for c in lines:
            for _ in range(rng.choice([0, 1, 1, 2])):
                j = rng.randrange(len(c))
                c[j : j + rng.choice([0, 1])] = [rng.choice("xyz, ")] * rng.choice([0, 1])
        docs[i] = "\n".join("".join(c) for c in lines) + "\n  a \t b  c d\x0be f g h " * (i % 3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    gone = repeated_lines(docs)
    assert {tuple(r) for r in line_dedup.removed_lines(frame(spark, docs)).select("doc_id", "line_no").collect()} == gone
    for i, t in docs.items():
        lines = (t or "").split("\n")
        words, removed = sum(bool(x.split()) for x in lines), sum(d == i for d, _ in gone)
        kept = "" if words and removed == words else "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == (words, removed, t if not removed else kept)


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    line = "one two three four five six seven eight nine"
    rows = [(0, line), (1, line + "\nanother line of its own that nobody else has at all"), (1, "precious unrelated only line\nother things are here"), (2, "x y"), (2, "x y")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, 1, 0, line), (1, 2, 1, "another line of its own that nobody else has at all"), (1, 2, 0, rows[2][1]), (2, 1, 0, "x y"), (2, 1, 0, "x y")])


def test_line_dedup_edges(spark, edge, empty):
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(edge).collect()}
    assert (None, "no id here at all") in got and (1, None) in got and (4, "  \n\t ") in got and (6, "") in got and (3, "word") in got
    assert line_dedup.dedup_lines(edge).count() == edge.count() and line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(edge, max_edits=0).count() == edge.count()


# n-gram join


def linked(docs):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))] for _ in range(8)]
    docs = {}
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs[i] = " ".join(w[: rng.choice([len(w), len(w), len(w) - 1, len(w) * 4 // 5])])
    docs |= {500: None, 501: "", 502: "one two", 503: "One TWO", 504: "same " * 50, 505: "same " * 9}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(frame(spark, docs)).collect()}
    assert got == linked(docs)


def test_ngram_join_links_truncated_copies(spark):
    """Shorter copies with the larger doc_id, whose shingles other documents share in part: their lists differ from the longer text's."""
    rng = random.Random(12)
    docs = {}
    for g in range(400):
        w = [f"g{g}x{i}" for i in range(19)]
        docs[g] = " ".join(w)
        docs[10_000 + g] = " ".join(w[:16])
        for j in range(rng.randrange(1, 5)):
            a = rng.randrange(13)
            part = w[a : a + rng.randrange(5, 8)]
            docs[1000 + 10 * g + j] = " ".join([f"g{g}y{j}z{i}" for i in range(8)] + part + [f"g{g}u{j}z{i}" for i in range(8)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(frame(spark, docs)).collect()}
    want = {i: (len(t.split()) - 4, i - 10_000 if i >= 10_000 else i) for i, t in docs.items()}
    assert {i: x for i, x in got.items() if x != want[i]} == {}


def test_ngram_join_edges(spark, edge, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_components(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (6, 29996, 5), (8, 1, 8), (9, 1, 8)} <= got
    assert ngram_join.linked_components(edge).count() == edge.count() and ngram_join.linked_components(empty).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8}


# repeated passages


def without_repeats(docs):
    first, out = {}, {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        seen = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        gone = [False] * len(w)
        for j, x in enumerate(seen):
            if first.get(x, i) < i:
                gone[j : j + 50] = [True] * 50
        for x in seen:
            first.setdefault(x, i)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([40, 60, 200]))] for _ in range(15)]
    docs = {}
    for i in range(80):
        w = []
        for _ in range(rng.randrange(5)):
            p, a = rng.choice(pool), rng.randrange(20)
            w += p[a : a + rng.randrange(10, 150)] if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(30)]
        docs[i] = " ".join(w)
    docs |= {1000: None, 1001: docs[0], 1002: "x " * 500, 1003: "x " * 300, 1004: ""}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_words(frame(spark, docs)).collect()}
    assert got == without_repeats(docs)


def test_passages_keep_rows_of_one_id_apart(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(40)) + " " + passage
    rows = [(0, passage), (1, other), (1, "short text"), (1, passage.replace(" ", "  ")), (0, "y " + passage), (0, passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    left = sha(" ".join(f"q{i}" for i in range(40)))
    assert got == sorted([(0, 60, 0, sha(passage)), (0, 60, 0, sha(passage)), (0, 61, 0, sha("y " + passage)), (1, 100, 60, left), (1, 2, 0, sha("short text")), (1, 60, 60, sha(""))])


def test_passages_edges(spark, edge, empty):
    got = passages.repeated_words(edge)
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got.collect()} >= {(1, 0, 0), (5, 30000, 0), (6, 30000, 30000), (None, 5, 0), (3, 1, 0)}
    assert got.count() == edge.count() and passages.repeated_words(empty).count() == 0


# spot signatures


def test_spot_signatures(spark, edge, empty):
    out = spot_signatures.fingerprints(edge).collect()
    assert len(out) == edge.count() and spot_signatures.fingerprints(empty).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1 and by[1].fingerprint == by[2].fingerprint


@pytest.mark.parametrize("run", [3, 1000])
def test_spot_neighbours(spark, run, monkeypatch):
    monkeypatch.setattr(spot_signatures, "RUN", run)
    rng = random.Random(6)
    docs = {i * i: "".join(rng.choice("abü 漢 the is ") for _ in range(rng.randrange(40))) for i in range(25)}
    got = {r.doc_id: r for r in spot_signatures.fingerprints(frame(spark, docs)).collect()}
    ids = sorted(docs, reverse=True)
    for k, i in enumerate(ids):
        text, after = docs[i], docs[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        edited_text = text[: len(text) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited_text.encode()).hexdigest())


def signatures(text):
    """The set of (anchor, three content words) of a text; with none all its words, and without words the text."""
    w = [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.ASCII) if x]
    content = [(x, w[i - 1] if i and w[i - 1] in spot_signatures.ANCHORS else None) for i, x in enumerate(w) if x not in spot_signatures.ANCHORS]
    out = {(p, x, content[i + 1][0], content[i + 2][0]) for i, (x, p) in enumerate(content) if p and i + 2 < len(content)}
    return out or {tuple(w) or text}


def test_spot_likeness_equals_brute_force(spark):
    rng = random.Random(16)
    vocabulary = ["the", "is", "of", "la", "der", "fox", "tree", "river", "Größe", "nube", "Haus", "x1"]
    docs = {i: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ". "]) for _ in range(rng.randrange(80))) for i in range(40)}
    docs |= {100: docs[3], 101: docs[3] + " the fox tree river", 102: "", 103: None, 104: "?!"}
    got = {r.doc_id: r for r in spot_signatures.fingerprints(frame(spark, docs)).collect()}
    ids, own = sorted(docs, reverse=True), {i: signatures(t or "") for i, t in docs.items()}

    def alike(a, b):
        return len(a & b) / len(a | b)

    for k, i in enumerate(ids):
        text, j = docs[i] or "", ids[(k + 1) % len(ids)]
        edited_set = signatures(text[: len(text) - len(text) // 3] + (docs[j] or "")[: len(text) // 3])
        assert got[i].near_edited == pytest.approx(alike(own[i], edited_set)) and got[i].near_next == pytest.approx(alike(own[i], own[j]))
        marks, changed, after = (set(x.split()) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[j].fingerprint))
        assert len(marks) == len(own[i]) and got[i].near_next == alike(marks, after) and got[i].near_edited == alike(marks, changed)
    assert got[100].fingerprint == got[3].fingerprint


def test_spot_pairs_in_groups_of_copies(spark):
    rng = random.Random(17)
    words_ = [f"c{i}" for i in range(60)]
    base = [" ".join(("the " if rng.random() < 0.5 else "") + rng.choice(words_) for _ in range(60)) for _ in range(3)]
    docs = {i: base[i % 3] + (" the " + " ".join(rng.choice(words_) for _ in range(rng.randrange(4, 14))) if i % 5 else "") for i in range(60)}
    own, first = {i: signatures(t) for i, t in docs.items()}, {}
    for i in sorted(docs):
        first.setdefault(frozenset(own[i]), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(own[a] & own[b]) >= 0.75 * len(own[a] | own[b])}
    assert {(r.a, r.b) for r in spot_signatures.near_pairs(frame(spark, docs)).collect()} == want and want


def test_spot_pairs(spark):
    text = "the red fox jumps over the lazy dog and the small cat sleeps in the warm house while the old man reads a long book by the fire"
    text += " in the green garden a tall tree grows by the quiet river and the children play in the soft grass under the blue sky near the old bridge"
    docs = {1: text, 2: text + " with strange new stars", 3: "completely different words without anything", 4: text}
    got = {(r.a, r.b) for r in spot_signatures.near_pairs(frame(spark, docs)).collect()}
    assert got == {(1, 2)}


# toxicity


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(8)
    bad = ["vile", "rotten"]
    docs, labels = {}, []
    for i in range(900):
        toxic = i % 6 == 0
        w = [f"n{rng.randrange(200)}" for _ in range(40)]
        if toxic:
            w[3], w[9] = rng.choice(bad), rng.choice(bad)
        docs[i] = " ".join(w)
        labels.append((i, int(toxic)))
    d, table = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, table)
    again = toxicity.train(d, table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (model[0] == again[0]).all() and model[1] == again[1]  # labels of the held-out fold change nothing
    scores = {r.key: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scores[i] >= 0.3) == (i % 6 == 0) for i in held]) > 0.95


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(18)
    docs = [(i, " ".join(f"n{rng.randrange(300)}" for _ in range(30)) + (" vile rotten" if i % 8 == 0 else "")) for i in range(800)] + [(900, None), (901, "")]
    labels = [(i, int(i % 8 == 0)) for i in range(0, 800, 2)] + [(1, None), (1, 0), (16, 0)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op5_toxicity(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in docs]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == int(r.doc_id % 8 == 0 and r.doc_id < 800) for r in rows]) > 0.97


def test_toxicity_prior_is_taken_off_the_unlabelled(spark):
    positive, unlabelled = [np.array([1, 2])] * 20, [np.array([2, 3])] * 90 + [np.array([1, 2])] * 10
    assert np.flatnonzero(toxicity.informative(positive, unlabelled, 0.1, 4)).tolist() == [1]


def test_informative_makes_no_copy_of_all_cells():
    rows = [np.arange(i, i + 500, dtype=np.int32) for i in range(4000)]
    tracemalloc.start()
    toxicity.informative(rows, rows, 0.1, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # all cells are 8 MB, 16 MB as 64-bit numbers


def held() -> float:
    """MB that this process holds."""
    return int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024


glibc = pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")


@glibc
def test_tasks_give_memory_back(spark, edge):
    def run(batches):
        parts = [np.ones(12_000) for _ in range(800)]  # 77 MB in pieces too small for the system
        pins.extend(parts[::100])
        yield from batches

    pins, before = [], held()
    assert list(common.released(run)(iter([1, 2]))) == [1, 2] and len(pins) == 8
    assert held() - before < 40
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (toxicity.score(edge, (np.zeros(1 << toxicity.BITS), 0.0)), ngram_join.left_by_sieve(edge.select("doc_id", "text"), 10, (3, 4)))]
    assert [plan.count("MapInArrow whole(") for plan in plans] == [plan.count("MapInArrow ") for plan in plans] == [1, 3]


@glibc
def test_training_gives_memory_back(spark, monkeypatch):
    def fit(*_):
        parts = [np.ones(12_000) for _ in range(800)]  # 77 MB in pieces too small for the system
        pins.extend(parts[::100])
        return np.zeros(4), 0.0

    pins, before = [], held()
    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(i, "vile" if i % 2 else "fine") for i in range(40)], "doc_id long, text string")
    assert toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))) is not None
    assert held() - before < 40


def test_toxicity_prior_of_rows_without_labels(spark):
    toxic, clean, odd = [np.array([1, 2])] * 20, [np.array([2, 3])] * 60, [np.array([2, 3])] * 95 + [np.array([1, 2])] * 5
    assert abs(toxicity.open_share(toxic, clean, odd, 0.25, 4) - 0.05) < 1e-9 and toxicity.open_share(toxic, clean, clean, 0.25, 4) == 0.0
    assert toxicity.open_share(toxic, clean, odd, 0.06, 4) == 0.06  # too near to tell
    assert toxicity.open_share(toxic, toxic, odd, 0.5, 4) == 0.5 and toxicity.open_share(toxic[:1], clean, odd, 0.9, 4) == 0.9
    # labels for every toxic text and few of the others: their toxic share is ten times that of all texts
    docs = {i: f"n{i % 7} n{i % 11}" + (" vile" if i % 20 == 0 else "") for i in range(1000)}
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in docs if i % 20 in (0, 1)], "doc_id long, toxic int")
    d = frame(spark, docs)
    scores = {r.key: r.score for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert all((scores[i] >= 0.3) == (i % 20 == 0) for i in docs)


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(edge, none) is None
    assert {r.score for r in toxicity.score(edge, None).collect()} == {0.0}
    kept = toxicity.drop_toxic(edge, none)
    assert kept.columns == edge.columns and kept.count() == edge.count() and toxicity.drop_toxic(empty, none).count() == 0
    model = (np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    assert {r.score for r in toxicity.score(edge, model).collect()} == {0.5} and toxicity.score(empty, model).count() == 0


# mixing


def test_targets():
    assert mixing.targets(np.array([100.0, 100.0, 100.0])).tolist() == [187.5, 75.0, 37.5]
    assert mixing.targets(np.array([10.0, 100.0, 100.0])).tolist() == [30.0, 120.0, 60.0]
    assert mixing.targets(np.array([0.0, 0.0])).tolist() == [0.0, 0.0]


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "b", "c", None])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "target", "taken", F.coalesce("source", F.lit("~"))).collect())) for _ in range(2))
    assert first == second
    by = {}
    for _, size, target, taken, source in first:
        assert 0 <= taken <= 3 * size
        x = by.setdefault(source, [target, 0, 0])
        x[1] += taken
        x[2] += size
    want = mixing.targets(np.array([float(by[s][2]) for s in ("a", "b", "c", "~")]))
    for s, t in zip(("a", "b", "c", "~"), want, strict=True):
        assert abs(by[s][0] - t) < 1e-6 and abs(by[s][1] - t) < 2
    for r in mixing.mix(d, whole=True).collect():
        assert r.taken == r.copies * r.size


def test_mix_tables_need_no_job(spark):
    rows = spark.range(3).withColumn("k", F.concat(F.lit("s"), "id"))
    both = mixing._with(rows, [("s0", 1.5, None, 2**40), ("s2", -0.5, "ü", -1)], "k string, x double, t string, n long")
    assert [tuple(r) for r in both.orderBy("id").collect()] == [("s0", 0, 1.5, None, 2**40), ("s2", 2, -0.5, "ü", -1)]
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    assert mixing._with(rows, [], "k string, x double").count() == 0


def test_mix_steps_in_the_driver(spark, edge, monkeypatch):
    rng = random.Random(10)
    d = spark.createDataFrame([(i, "w " * int(rng.paretovariate(0.7)), rng.choice(["a", "b", "ü", "", None])) for i in range(600)] + [(600, "", "none")], "doc_id long, text string, source string")
    out = {}
    for most in (mixing.HISTOGRAM_ROWS, 0):
        monkeypatch.setattr(mixing, "HISTOGRAM_ROWS", most)
        spark.sparkContext.setJobGroup(f"mix-{most}", "")
        out[most] = [sorted(mixing.mix(x, whole=True).select("source", "doc_id", "size", "copies", F.round("rate", 9)).collect(), key=str) for x in (d, edge)]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    (few, rows), (many, same) = [(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"mix-{most}")), x) for most, x in out.items()]
    assert rows == same and few < 0.7 * many, (few, many)
    hist = spark.createDataFrame([("a", 0, 2.0), ("a", 5, 1.0), ("b", 3, 4.0), ("b", 900, 1.0)], "k string, size long, c double")
    given = (hist, [("b", 100.0), ("a", 2.0), ("c", 1.0)], 3)
    for state in ([("a", 0.2), ("b", -0.5)], [("b", 500.0)], []):
        by_plan, in_driver = (sorted(map(tuple, steps(*given)(state))) for steps in (mixing._steps_by_plan, mixing._steps_in_driver))
        assert [k for k, *_ in by_plan] == [k for k, *_ in in_driver] and np.allclose([x[1:] for x in by_plan], [x[1:] for x in in_driver], rtol=1e-12)


def test_pipeline_mix_moves_no_texts(spark, edge, empty, sf):
    out = corpus_pipeline.mix_sources(spark, edge, sf)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for r in mixing.mix(edge, whole=True).collect():
        want[r.doc_id, r.source, r.size] = max(want[r.doc_id, r.source, r.size], r.copies if r.size else 0)
    given = Counter(tuple(r) for r in edge.collect())
    copies = {r: n * want[r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))] for r, n in given.items()}
    assert Counter(tuple(r) for r in out.collect()) == Counter({r: n for r, n in copies.items() if n}) and out.columns == edge.columns
    assert corpus_pipeline.mix_sources(spark, empty, sf).count() == 0


def test_mix_edges(edge, empty):
    out = mixing.mix(edge).collect()
    assert len(out) == edge.count() and all(r.taken == 0 for r in out if r.size == 0) and mixing.mix(empty).count() == 0
