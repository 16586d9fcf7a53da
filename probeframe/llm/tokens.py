"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import text_buffer

#: Words whose ids a worker keeps at most, in two generations.
CACHED_WORDS = 300_000
#: Distinct words that are looked up at once.
KNOWN = 30_000
#: Words whose ids are put in place at once.
GATHERED = 1 << 16
VOCABULARY = "word_bpe_49k.json"
END = 2

#: Tab, line feed and return become spaces.
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[0x09, 0x0A, 0x0D]] = 0x20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer; a path in place of a name is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class WordEncoder:
    """ids of texts for tokenizers that drop white space, so that the pieces between space, tab, line feed and return stand alone.

    Texts are split and their distinct words found by column. Words come again and again, so their ids are kept: recent ones in ``new``; when it is full it becomes ``old``. A new word of
    Latin letters, with or without marks of TAILS after them, is two pieces to the tokenizer's own pattern, so its letters go
    straight to the tokenizer's model (for tokenizers that fold case and split letters, digits and marks); all others go
    through the whole tokenizer.
    """

    TAILS = ".,!?|;:"

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.cached, self.new, self.old = Tokenizer.from_file(path), cached, {}, {}
        self.letters, self.tails, self.cores = _byte_letters(), {}, {}
        self.largest = max(self.model.get_vocab(with_added_tokens=True).values(), default=0)
        self.plain = sys.byteorder == "little" and array("I").itemsize == 4 and all(self._whole(w) == self._latin(w) for w in ("the", "The", "Été,", "naïve!!", "STRASSE", "größer.", "x|"))

    def _whole(self, word: str) -> bytes:
        return np.array(self.model.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _latin(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters and marks, None for other words."""
        low = word.lower()
        core = low.rstrip(self.TAILS)
        out = self.cores.get(core)
        if out is None:
            plain = core.isascii()
            if not core.isalpha() or not plain and max(core) >= "\u0250":
                return None
            text = core if plain else "".join([self.letters[b] for b in core.encode()])
            out = self.cores[core] = array("I", [t.id for t in self.model.model.tokenize(text)]).tobytes()
            if len(self.cores) > self.cached:
                self.cores = {}
        if len(core) == len(low):
            return out
        tail = low[len(core) :]
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._whole(tail)
            if len(tail) <= 8:
                self.tails[tail] = ids
        return out + ids

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        new, old, plain, latin = self.new, self.old, self.plain, self._latin
        out: list = list(map(new.get, words))
        missing = []
        for i in [i for i, x in enumerate(out) if x is None]:
            w = words[i]
            x = old.get(w)
            if x is None and plain and len(w) <= 64:
                x = latin(w)
            if x is None:
                missing.append(i)
            else:
                out[i] = new[w] = x
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            for i, e in zip(part, self.model.encode_batch([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = x = np.array(e.ids, dtype="<u4").tobytes()
                if len(words[i]) <= 64:
                    new[words[i]] = x
        if len(new) > self.cached:
            self.old, self.new = new, {}
        return out

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts of a column, one after the other, and where each begins (one more entry at the end).
        Null is empty. Texts are split and their distinct words found over the whole column."""
        data, at = text_buffer(column)
        text = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(_SPACES[data])])
        parts = pc.split_pattern(text, " ")
        words, rows = parts.flatten().dictionary_encode(), np.asarray(parts.offsets)
        del data, text, parts
        # distinct words in blocks, so that the kept words and those of a block are all the words that are Python's at a time
        size, flat = np.empty(len(words.dictionary), np.int64), []
        for a in range(0, len(size), KNOWN):
            known = self._known(words.dictionary.slice(a, KNOWN).to_pylist())
            size[a : a + len(known)] = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            flat.append(b"".join(known))
            del known
        which = words.indices.to_numpy()
        del words
        pa.default_memory_pool().release_unused()
        start = np.concatenate(([0], np.cumsum(size)))[: len(size)]
        flat = np.frombuffer(b"".join(flat), dtype="<u4")
        # the ids of a block of words at a time: positions take several times the room of the ids
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size[which], out=ends[1:])
        ids = np.empty(ends[-1], dtype="<u4")
        for a in range(0, len(which), GATHERED):
            some = which[a : a + GATHERED]
            first, last = ends[a], ends[min(a + GATHERED, len(which))]
            ids[first:last] = flat[np.repeat(start[some] - ends[a : a + len(some)] + first, size[some]) + np.arange(last - first)]
        return ids, ends[rows]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit values."""
        return self.batch(pa.array([text], pa.large_string()))[0].tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; it keeps its words from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
