"""Best-fit-decreasing packing into written id matrices.

Every task tokenizes its documents, cuts overlong ones into pieces of ``window`` ids (nothing is lost), and packs blocks of at
most BLOCK pieces: longest first, each into the sequence with the least room that fits, found through a segment tree over the
number of sequences by room. A block is written as one uncompressed ``.npz`` file in the shared folder: ``ids``
(sequences x window, unsigned 16-bit where the vocabulary allows, rows padded with ``pad``), ``cu_seqlens`` (cumulative lengths of the
segments of all sequences), ``first`` (each sequence's first segment) and ``positions`` (sequences x window, counted from 0
again at each segment). Files are named after the task attempt; only blocks of attempts that succeeded are in the manifest.
No row is shuffled, so a hot key cannot matter.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch
from .tokens import END, VOCABULARY, encoder, vocabulary_path

WINDOW = 2048
#: Pieces and tokens of a block at most (a block ends after the document that reaches one of them, or within a longer one).
BLOCK, TOKENS = 8192, 4 << 20


class Rooms:
    """A segment tree over rooms 0..size: how many sequences have each; finds the least room that is at least asked for."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest fit, taken out."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.held[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece and the number of sequences; ties go in the order given."""
    rooms, count = Rooms(window), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = rooms.take(n)
        room, s = found if found else (window, count)
        count += found is None
        sequence[i], offset[i] = s, window - room
        rooms.put(room - n, s)
    return sequence, offset, count


def _write(folder: str, path: str, window: int, end: int, pad: int, wide: bool | None):
    def run(batches):
        where = TaskContext.get()
        stem = f"part-{where.partitionId():06d}-{where.taskAttemptId()}"
        system, place = fs.FileSystem.from_uri(folder)
        own = encoder(path)
        large = max(own.largest, end, pad) > 0xFFFF
        kind = np.uint32 if (large if wide is None else wide) else np.uint16
        if large and kind is np.uint16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        pieces: list[tuple] = []
        counted = np.arange(window)
        state = {"tokens": 0, "block": 0}

        def flush():
            lengths = np.array([len(p[2]) for p in pieces], dtype=np.int64)
            seq, off, n = best_fit(lengths, window)
            ids, positions = np.full((n, window), pad, dtype=kind), np.zeros((n, window), dtype=np.uint16 if window <= 1 << 16 else np.uint32)
            order = np.lexsort((off, seq))
            for i in order:
                ids[seq[i], off[i] : off[i] + lengths[i]] = pieces[i][2]
                positions[seq[i], off[i] : off[i] + lengths[i]] = counted[: lengths[i]]
            segment = np.empty(len(pieces), np.int64)
            segment[order] = np.arange(len(pieces))
            out = io.BytesIO()
            np.savez(out, ids=ids, cu_seqlens=np.concatenate(([0], np.cumsum(lengths[order]))), first=np.searchsorted(seq[order], np.arange(n + 1)), positions=positions)
            name = f"{place}/{stem}-{state['block']:04d}.npz"
            system.create_dir(place, recursive=True)
            with system.open_output_stream(name, compression=None) as f:
                f.write(out.getbuffer())
            base = (where.partitionId() << 40) + (state["block"] << 24)
            docs, starts, _, totals = zip(*pieces, strict=True)
            row = [[f"{folder}/{stem}-{state['block']:04d}.npz"], [base], [n], [list(docs)], [list(starts)], [list(totals)], [segment.tolist()]]
            pieces.clear()
            state.update(tokens=0, block=state["block"] + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, KINDS, strict=True)], names=NAMES)

        for b in batches:
            ids, first = own.batch(b.column(1))
            ids = ids.astype(kind)
            for i, doc in enumerate(b.column(0).to_pylist()):
                mine = np.append(ids[first[i] : first[i + 1]], kind(end))
                n = len(mine)
                for a in range(0, n, window):
                    pieces.append((doc, a, mine[a : a + window], n))
                    state["tokens"] += len(pieces[-1][2])
                    if len(pieces) >= BLOCK or state["tokens"] >= TOKENS:
                        yield flush()
        if pieces:
            yield flush()

    return run


NAMES = ["path", "base", "sequences", "doc_id", "start", "doc_tokens", "segment"]
_LONGS = pa.list_(pa.int64())
KINDS = [pa.string(), pa.int64(), pa.int64(), _LONGS, _LONGS, _LONGS, _LONGS]
MANIFEST = "path string, base long, sequences long, doc_id array<long>, start array<long>, doc_tokens array<long>, segment array<long>"


def write_matrices(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END, pad: int = 0, wide: bool | None = None) -> DataFrame:
    """Writes blocks for docs (doc_id, text) and returns their saved manifest, a row for each block with its pieces.

    Null or empty text is the end id alone. Rows without doc_id and repeated rows are packed each. An empty table writes nothing.
    ``wide`` stores ids in 32 bits; None: where the vocabulary, end or pad has an id above 65,535, and False raises there.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=3000, mb=16)
    folder = scratch(spark, "token-matrices")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(_write(folder, vocabulary_path(vocabulary), window, end, pad, wide), MANIFEST), "token-manifest")


def _read(batches):
    for b in batches:
        out: list[tuple] = []
        for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            system, at = fs.FileSystem.from_uri(r["path"])
            with system.open_input_file(at) as f:
                z = np.load(io.BytesIO(f.read()))
            ids, edges, first, positions = z["ids"], z["cu_seqlens"], z["first"], z["positions"]
            of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for doc, start, total, k in zip(r["doc_id"], r["start"], r["doc_tokens"], r["segment"], strict=True):
                s = int(of[k])
                lo, n = int(edges[k] - edges[first[s]]), int(edges[k + 1] - edges[k])
                part = ids[s, lo : lo + n].astype("<u4")
                if positions[s, lo] != 0 or positions[s, lo + n - 1] != n - 1:
                    raise ValueError(f"{r['path']}: positions do not reset at a segment")
                out.append((doc, start, n, zlib.crc32(part.tobytes()), total, r["base"] + s, lo))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def read_matrices(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, from the written files."""
    bounded_batches(manifest.sparkSession)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return manifest.repartition("path").mapInArrow(_read, fields)


def op8_token_matrices(spark, sf_dir: str) -> DataFrame:
    """Every document tokenized, packed, written and read back."""
    return read_matrices(write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
