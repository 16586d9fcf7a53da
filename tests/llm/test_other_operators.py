"""Archives, search, packing and the pipeline: round trips, recall, brute force, edge cases and empty tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeframe.llm import hashing_search, mixing, packing, token_matrix, tokens, toxicity, warc


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_archive_round_trip(spark):
    big = "x" * 2000
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://c/ d\r\ne", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "ü" * 600), (None, "n", big), (2, None, big), (9, "l", "<p>" * 400_000)]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, length int, path int")
    index = warc.write_archives(df)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_records(index).collect()), key=str)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        revisit = html == big and i != 2
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None, None if revisit else bytearray(raw)))
    assert got == sorted(want, key=str)
    some = warc.read_records(index.where("page_id in (3, 7)")).collect()
    assert {r.page_id for r in some} == {3, 7}
    assert warc.write_archives(df.limit(0)).count() == 0 and warc.read_records(index.limit(0)).count() == 0


def test_search_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[500:520] = x[40]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0, 0), (2020, [0.0] * 32, 0, 0), (2040, [float("nan")] * 32, 0, 0), (2060, [None] + [1.0] * 31, 0, 0), (2080, [float("inf")] * 32, 0, 0), (2100, [1.0], 0, 0), (None, [1.0] * 32, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, kind int")
    got = hashing_search.nearest(hashing_search.usable(df), F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(found.pop(2100)) == 20  # a vector of another length counts as filled up with zeros
    assert set(found) == set(range(0, 1500, 20)) and {len(v) for v in found.values()} == {20}
    hits = 0
    for q, v in found.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        v = [p for p in v if p[0] != 2100]
        hits += len(set(best.tolist()) & {i for i, _ in v})
        assert all(abs(z - s[i]) < 1e-9 for i, z in v) and v == sorted(v, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(found)) >= 0.9
    assert hashing_search.nearest(hashing_search.usable(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    few = hashing_search.nearest(hashing_search.usable(df.where("vec_id < 5")), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_search_query_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(hashing_search, "SHARD", 300)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = table.column(0).to_numpy(), [np.array(v, dtype=float) if v is not None else np.empty(0) for v in table.column(1).to_pylist()]
    fine = [i for i, v in enumerate(x) if len(v) and np.isfinite(v).all() and v.any()]
    ids, x = ids[fine], np.array([x[i] for i in fine])
    out = hashing_search.op2_multi_index_hashing(spark, SF)
    assert out.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0} and all(sorted(v) == list(range(1, 21)) for v in found.values())
    hits = 0
    for q, v in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(v.values()))
    assert hits / (20 * len(found)) >= 0.95


def test_search_fills_up_short_vectors_and_repeats(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0]), (2, [0.5, 0.5, 0.5]), (3, []), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 1.0]), (0, [1.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0])]
    usable = hashing_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in hashing_search.nearest(usable, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.5), (0, 2, 2, 1.5), (0, 3, 1, 1.0)]


def test_probing_reads_few_lists_where_neighbours_are_close():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40_000, 4), dtype=np.uint64), axis=1)
    codes = centres[rng.integers(0, 400, 40_000)] ^ flips
    shard = hashing_search.Shard(codes)
    near = shard.flips[: shard.upto[7 // shard.parts]].astype(int)
    read = 0
    for j, (first, _) in enumerate(shard.index):
        at = (int(codes[0]) >> 8 * j & 255) ^ near
        read += int((first[at + 1] - first[at]).sum())
    assert len(shard.within(codes[0], 7)) > 20 and read < 0.1 * len(codes)


def test_pigeonhole_finds_every_code_within_the_radius():
    codes = np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0xFFFF00FF)
    shard = hashing_search.Shard(codes)
    for r in (0, 3, 7, 12):
        assert (shard.within(codes[5], r) == np.flatnonzero(np.bitwise_count(codes ^ codes[5]) <= r)).all()


def test_cached_ids_equal_the_tokenizer(tokenizer):
    rng, alphabet = random.Random(3), "aZéÜßİıſŉK'.,!| \n\t  \x0b\x0c\x1c12-漢字<|endoftext|>Σσς"
    encoder = tokens.WordEncoder(tokens.vocabulary_path(), cached=50)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encoder.ids(text) == ids_of(tokenizer, text)[:-1].tobytes()


def test_histogram_plan_takes_every_piece():
    rng = np.random.default_rng(4)
    hist = np.zeros(65, dtype=np.int64)
    hist[1:] = rng.integers(0, 200, 64)
    groups = packing.plan(hist, 64)
    used = np.zeros(65, dtype=np.int64)
    for n, parts in groups:
        assert sum(b * k for b, k in parts) <= 64
        for b, k in parts:
            used[b] += n * k
    assert (used == hist).all()
    room = sum(n for n, _ in groups) * 64
    assert room - (hist * np.arange(65)).sum() < 0.02 * room + 64


def check_pieces(rows, docs, window, tokenizer):
    """Every id in one piece, gapless sequences of at most ``window``, right checksums. docs: list of (id, text)."""
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in placed.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= window
    want = sorted((i, a, len(x[a : a + window]), zlib.crc32(x[a : a + window].tobytes()), len(x)) for i, t in docs for x in [ids_of(tokenizer, t)] for a in range(0, len(x), window))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want


def test_packing(spark, edge, empty, tokenizer):
    docs = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in edge.collect()]
    check_pieces(packing.pack(edge).collect(), docs, 4096, tokenizer)
    assert packing.pack(empty).count() == 0
    with_ids = packing.pack(edge, with_ids=True).where("doc_id = 8").first()
    assert bytes(with_ids.ids) == ids_of(tokenizer, "a b c d e").tobytes()


def test_token_matrices(spark, edge, empty, tokenizer):
    docs = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in edge.collect()]
    check_pieces(token_matrix.read_matrices(token_matrix.write_matrices(edge)).collect(), docs, 2048, tokenizer)
    assert token_matrix.read_matrices(token_matrix.write_matrices(empty)).count() == 0


def test_segment_tree_packs_as_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(100):
        lengths = np.array([rng.randrange(1, 41) for _ in range(60)])
        sequence, offset, n = token_matrix.best_fit(lengths, 40)
        rooms = []
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 40) - x)
        assert n == len(rooms) and sorted(40 - np.bincount(sequence, lengths).astype(int)) == sorted(rooms)


def test_pipeline(spark, sf, tokenizer):
    """Each stage against a plain version of it, on what the stage before kept."""
    import corpus_pipeline as p
    from test_text_operators import linked, repeated_lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    def after(k):
        nonlocal docs
        out = p.STAGES[k][1](spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        return rows

    rows = after(0)
    predicted = {r.doc_id: r.predicted for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert {r.doc_id: r for r in rows} == {i: r for i, r in before.items() if not predicted[i]}

    before = {r.doc_id: r for r in rows}
    gone, want = repeated_lines({i: r.text for i, r in before.items()}), {}
    for i, r in before.items():
        lines = (r.text or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        if kept == r.text or not r.text:
            want[i] = (r.text, r.n_chars)
        elif kept.split():
            want[i] = (kept, len(kept))
    rows = after(1)
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == want and len(want) < len(before) + 1

    before = {r.doc_id: r for r in rows}
    rows = after(2)
    parts = linked({i: r.text for i, r in before.items()})
    assert {r.doc_id: r for r in rows} == {i: r for i, r in before.items() if parts[i][1] == i}

    before = {r.doc_id: r for r in rows}
    rows = after(3)
    assert all(before[r.doc_id] == r for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 3
    size = {i: len((r.text or "").encode().split()) for i, r in before.items()}
    names = sorted({r.source for r in before.values()}, key=lambda x: (x is None, (x or "").encode()))
    goal = mixing.targets(np.array([float(sum(size[i] for i, r in before.items() if r.source == n)) for n in names]))
    for n, g in zip(names, goal, strict=True):
        assert abs(sum(size[r.doc_id] for r in rows if r.source == n) - g) <= max(size[i] for i, r in before.items() if r.source == n)

    pieces = p.STAGES[4][1](spark, docs, sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in rows], 4096, tokenizer)
    used, sequences = sum(r.length for r in pieces), len({r.sequence_id for r in pieces})
    assert sequences <= 1.05 * -(-used // 4096) + 1


def test_pipeline_edges(spark, sf, edge, empty):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (edge.select(*columns), empty.select(*columns), edge):
        docs = table
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {r.doc_id for r in table.collect()} and (table is empty or p.STAGES[-1][1](spark, docs, sf).count() >= len(ids))


def test_encoder_keeps_few_words_and_works_in_blocks(monkeypatch):
    texts = [" ".join(f"w{i}q{j} x{j % 7}" for j in range(40)) for i in range(50)] + [None, "", "  \t a"]
    column = tokens.pa.array(texts, tokens.pa.large_string())
    want = tokens.WordEncoder(tokens.vocabulary_path()).batch(column)
    monkeypatch.setattr(tokens, "KNOWN", 70)
    monkeypatch.setattr(tokens, "GATHERED", 33)
    small = tokens.WordEncoder(tokens.vocabulary_path(), cached=100)
    for _ in range(2):
        ids, first = small.batch(column)
        assert (ids == want[0]).all() and (first == want[1]).all()
        assert len(small.new) + len(small.old) <= 2 * (100 + 70)  # not all 2,008 words of the batch
