"""Encoding of a corpus by a byte-level BPE vocabulary, through a tokenization automaton.

The automaton reads tokens: its states are the tokens read last, and there is
an arc from s over t where the merges would leave the boundary between s and t
alone. Merges are compiled one after the other, as merge gadgets: the gadget of
u+v takes the arc u->v away, and the new token w inherits u's entering and v's
leaving arcs as they are at that time. So an arc holds if, on the way down
through the gadgets that made s and t, no merge across the boundary comes
before the one that is undone. The arcs of a 50k vocabulary are 2.5 billion, of
which few ever occur; a gadget's arcs are therefore worked out when first met
and kept in the transition table.

Exactly one path of the automaton spells a word, so encoding is a walk over the
byte trie of the vocabulary under the transition table. Texts are pre-split by
the tokenizer's pattern. Lines and words that a worker has met before are
taken from bounded tables: between a character that isn't white
space and one that is there is always a word boundary, so these can be encoded
alone.

Defined cases: a null and an empty text give an empty list; strings of special
tokens are ordinary text; texts of any length are encoded whole; repeated rows
give repeated rows; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte_bpe_50k splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that the tables of known lines and of known words may hold in a worker; a full one is emptied.
KNOWN_CHARS = 16_000_000
#: Arcs that a worker remembers; a full table is emptied.
ARCS = 1_000_000
#: Rows of an output batch.
ROWS = 500
#: A line's text with the white space before it. It ends before white space, so the next begins at a word boundary.
_LINE = re.compile(r"\s*+\S++(?:[^\S\n]++\S++)*+|\s++")
#: The pattern again, for texts in which Python's own classes of letters, digits and white space are those of the pattern.
_ASCII_WORD = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_PLAIN_WORD = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER_CLASSES = frozenset([*"\x1c\x1d\x1e\x1f", *(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())])
_NEVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = DEFAULT_PATH) -> tuple[list[bytes | None], list[tuple[int, int, int]]]:
    """The bytes of each id, and the merges as (left, right, made) in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    words: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for w, i in vocab.items():
        if all(c in letters for c in w):
            words[i] = bytes(letters[c] for c in w)
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return words, merges


class Automaton:
    """The tokenization automaton of a vocabulary and its ordered merges."""

    def __init__(self, words: list[bytes | None], merges: list[tuple[int, int, int]]):
        self.words = words
        self.born = {}  # token: the number of the gadget that made it
        self.parts = {}  # token: the two tokens of its gadget
        self.gadget = {}  # (left, right): number of the gadget that takes this arc away
        base = {words.index(bytes([b])) for b in range(256)}
        self.longest = max(len(w) for w in words if w is not None)
        for k, (a, b, made) in enumerate(merges):
            # where no arc a->b is left the gadget finds nothing to join
            if made not in self.born and all(x in base or x in self.born for x in (a, b)) and self._arc(a, b, k):
                self.born[made], self.parts[made] = k, (a, b)
            self.gadget.setdefault((a, b), k)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t in base | set(self.parts):
            at = 0
            for byte in words[t]:
                nxt = self.trie[at].get(byte)
                if nxt is None:
                    nxt = self.trie[at][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = t

    def arc(self, s: int, t: int) -> bool:
        """Whether the finished automaton goes from state s over token t."""
        known = self.arcs.get((s, t))
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[s, t] = self._arc(s, t)
        return known

    def _arc(self, s: int, t: int, before: int = _NEVER) -> bool:
        """``before``: gadgets from this number on come too late to join s and t."""
        while True:
            if self.gadget.get((s, t), _NEVER) < before:
                return False
            a, b = self.born.get(s, -1), self.born.get(t, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, s = a, self.parts[s][1]
            else:  # of two equal pairs the left one is merged first, so the gadget itself still counts
                before, t = b + 1, self.parts[t][0]

    def _tokens_at(self, word: bytes, at: int) -> list[int]:
        found, node = [], 0
        for byte in word[at : at + self.longest]:
            node = self.trie[node].get(byte)
            if node is None:
                break
            if self.ends[node] >= 0:
                found.append(self.ends[node])
        return found  # the longest last

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        n, lengths = len(word), self.words
        path: list[int] = []
        starts, open_at, dead = [0], [self._tokens_at(word, 0)] if n else [], set()
        while open_at:
            at, options, s = starts[-1], open_at[-1], path[-1] if path else -1
            while options:
                t = options.pop()
                end = at + len(lengths[t])
                if (s < 0 or self.arc(s, t)) and (end, t) not in dead:
                    path.append(t)
                    if end == n:
                        return path
                    starts.append(end)
                    open_at.append(self._tokens_at(word, end))
                    break
            else:
                open_at.pop()
                starts.pop()
                if path:
                    dead.add((at, path.pop()))
        if n:
            raise ValueError(f"no path of the automaton spells {word!r}")
        return path

    def decode(self, ids: list[int]) -> bytes:
        """The bytes on the arcs of ``ids``."""
        return b"".join(self.words[i] for i in ids)


class Encoder:
    """Whole texts into ids, as little-endian int32 bytes."""

    def __init__(self, words, merges, pattern: str = PATTERN, known_chars: int = KNOWN_CHARS):
        self.automaton = Automaton(words, merges)
        self.pattern = regex.compile(pattern).findall
        self.usual = pattern == PATTERN
        self.words, self.lines = _Known(known_chars, self._word), _Known(known_chars, self._line)

    def split(self, line: str) -> list[str]:
        if not self.usual:
            return self.pattern(line)
        if line.isascii():
            return _ASCII_WORD.findall(line)
        return _PLAIN_WORD.findall(line) if _OTHER_CLASSES.isdisjoint(line) else self.pattern(line)

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.encode(word.encode()), "<i4").tobytes()

    def _line(self, line: str) -> bytes:
        known = self.words
        return b"".join([known[w] for w in self.split(line)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known = self.lines
        return b"".join([known[p] for p in _LINE.findall(text)])


class _Known(dict):
    """Results by piece of text, emptied when the pieces reach a number of characters."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.room = self.limit = limit
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        made = self.make(piece)
        if len(piece) > self.limit // 16:
            return made
        self.room -= len(piece) + 20
        if self.room < 0:
            self.clear()
            self.room = self.limit
        self[piece] = made
        return made


_encoders: dict[tuple, Encoder] = {}


def _encoder(key: tuple, sent) -> Encoder:
    """One encoder a worker process."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*sent.value)
    return _encoders[key]


def _encode(batches: Iterator[pa.RecordBatch], key: tuple, sent) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(key, sent)
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            parts = [encoder.encode(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])


def encode_corpus(docs: DataFrame, path: str = DEFAULT_PATH, doc_id: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every row. One narrow pass, no shuffle; the vocabulary (a fixed size) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((*read_vocabulary(path), pattern))
    run = partial(_encode, key=(path, pattern), sent=sent)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, text) of encoded rows; bytes that are no UTF-8 come as U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else b"".join(sent.value[i] for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
