"""Test passages that stand, whole or in part, in training texts.

Each task makes a suffix array of its shard of the texts, ordered by the first
``n`` words of every suffix (by prefix doubling) and, among equal ones, by the
word before; suffixes that hold a word of no passage among their first ``n``
can't match and are left out, which changes no result. Every suffix of the
test passages is searched in it by bisection. A suffix of the text that has
the same word before it as the passage's suffix only continues a longer match,
so that of each interval just the part with another word before it is a hit,
and runs of equal words don't multiply. Hits are extended to the longest
verbatim match, word by word, and given with their place. The texts stay where
they are and are read and cut into words once: only passages are sent to the
tasks, in blocks of a bounded number of words of which a task holds one at a
time, and only hits come back.

Words are runs of letters and digits as a reader sees the page: tags separate
words, of ``[[target|shown]]`` only shown counts, entities stand for their
characters, invisible format characters are dropped, and the rest is compared
in lower case and NFC.

Defined cases: null and empty texts and passages shorter than ``n`` words match
nothing; texts of any length are searched whole; a repeated row gives its hit
once for each row (``leaks`` has distinct ones); items with the same passage
all hit; null ids stay null; empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
MIN_WORDS = 12
#: Words of passages that are sent to the tasks at once.
BLOCK_WORDS = 500_000
#: Characters of a shard (a longer text is one of its own).
SHARD_CHARS = 8_000_000
#: Hits that are extended at once, by so many words at a time.
HITS, AHEAD = 200_000, 16

_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_LINK = re.compile(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}
_HAS_INVISIBLE = re.compile("[" + "".join(map(re.escape, map(chr, (c for c in _INVISIBLE if c < 0x10000)))) + f"{chr(0x10000)}-{chr(sys.maxunicode)}]")


def words_of(text: str | None) -> list[str]:
    """The words of a text as its reader sees them."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[[" in text:
        text = _LINK.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if _HAS_INVISIBLE.search(text):
            text = text.translate(_INVISIBLE)
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


class Passages:
    """The words of test passages as ids, and all their suffixes of at least n words."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = MIN_WORDS):
        self.n, self.ids, self.vocab = n, [i for i, _ in items], {}
        flat: list[int] = []
        item_of: list[int] = []
        for k, (_, text) in enumerate(items):
            for w in [*words_of(text), None]:
                flat.append(0 if w is None else self.vocab.setdefault(w, len(self.vocab) + 1))
                item_of.append(k)
        self.flat, self.item_of = np.array(flat, np.int64), np.array(item_of, np.int64)
        self.lengths = np.bincount(self.item_of, self.flat > 0, len(items)).astype(np.int64) if items else np.zeros(0, np.int64)
        self.starts = suffixes(self.flat, n)


def suffixes(ids: np.ndarray, n: int) -> np.ndarray:
    """Where n ids stand that aren't 0; the array must end with 0."""
    if not len(ids):
        return np.zeros(0, np.int64)
    at = np.arange(len(ids))
    stop = np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1]
    return np.flatnonzero(stop - at >= n)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Of each place the rank of the n ids from there on, by prefix doubling; without meaning where 0 is among them."""

    def pair(rank: np.ndarray, ahead: int) -> np.ndarray:
        then = np.zeros_like(rank)
        then[: len(rank) - ahead] = rank[ahead:]
        return np.unique(rank * (rank.max() + 1) + then, return_inverse=True)[1]

    rank, size = ids, 1
    while 2 * size <= n:
        rank, size = pair(rank, size), 2 * size
    return pair(rank, n - size) if size < n else rank


def _extended(ids: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """How many ids from a and b on are equal and not 0, at least ``size``; the array must end with AHEAD zeros."""
    out = np.full(len(a), size)
    live = np.arange(len(a))
    while len(live):
        at = out[live, None] + np.arange(AHEAD)
        x, y = ids[np.minimum(a[live, None] + at, len(ids) - 1)], ids[np.minimum(b[live, None] + at, len(ids) - 1)]
        differ = (x != y) | (x == 0)
        ends = differ.any(1)
        out[live] += np.where(ends, differ.argmax(1), AHEAD)
        live = live[~ends]
    return out


def search(ids: np.ndarray, doc_of: np.ndarray, passages: Passages) -> tuple[np.ndarray, ...]:
    """(document, item, words, position in ids) of the longest match of each document and item, the first of several; ``ids`` must end with 0."""
    n, none = passages.n, np.zeros(0, np.int64)
    if not len(passages.starts) or not len(ids):
        return none, none, none, none
    # runs of n known words, and the 0 that ends each
    size = np.diff(np.r_[-1, np.flatnonzero(ids == 0)])
    where = np.flatnonzero(np.repeat(size > n, size))
    if not len(where):
        return none, none, none, none
    joint = np.concatenate([ids[where], passages.flat, np.zeros(AHEAD, np.int64)])
    rank = _windows(joint, n)
    before = np.r_[0, joint[:-1]]
    wide = int(joint.max()) + 1
    place = rank * wide + before
    text = suffixes(ids[where], n)
    text = text[np.argsort(place[text], kind="stable")]
    found, tests = place[text], passages.starts + len(where)
    low, high = np.searchsorted(found, rank[tests] * wide), np.searchsorted(found, (rank[tests] + 1) * wide)
    skip = before[tests] > 0
    same = np.where(skip, np.searchsorted(found, place[tests]), low)
    past = np.where(skip, np.searchsorted(found, place[tests], "right"), low)
    first, count = np.r_[low, past], np.r_[same - low, high - past]
    which = np.repeat(np.arange(len(count)), count)
    hit = text[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]]
    test = tests[which % len(tests)]
    order = np.argsort(hit, kind="stable")
    hit, test = hit[order], test[order]
    doc, item = doc_of[where[hit]], passages.item_of[test - len(where)]
    pair = doc * len(passages.ids) + item
    best: list[tuple[np.ndarray, ...]] = []
    whole = none
    for k in range(0, len(hit), HITS):
        mine = np.arange(k, min(k + HITS, len(hit)))
        if len(whole):  # nothing later can be better
            mine = mine[~np.isin(pair[mine], whole)]
        size = _extended(joint, hit[mine], test[mine], n)
        order = np.lexsort((hit[mine], -size, pair[mine]))
        mine, size = mine[order], size[order]
        top = np.r_[True, pair[mine][1:] != pair[mine][:-1]][: len(mine)]
        mine, size = mine[top], size[top]
        best.append((mine, size))
        whole = np.union1d(whole, pair[mine[size == passages.lengths[item[mine]]]])
    mine, size = (np.concatenate([b[i] for b in best] or [none]) for i in (0, 1))
    order = np.lexsort((hit[mine], -size, item[mine], doc[mine]))
    mine, size = mine[order], size[order]
    top = np.r_[True, pair[mine][1:] != pair[mine][:-1]][: len(mine)]
    mine, size = mine[top], size[top]
    return doc[mine], item[mine], size, where[hit[mine]]


_SCHEMA = "doc_id bigint, item_id bigint, n_words int, at_word int, whole boolean"


def _searcher(sent: list, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Passages(sent[0].value, n) if len(sent) == 1 else None

        def blocks() -> Iterator[Passages]:
            for block in [] if only else sent:
                yield Passages(block.value, n)
                vars(block).pop("_value", None)  # the next look reads it from its file again
            if only:
                yield only

        def shard(doc_ids: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            words = [words_of(t) for t in texts]
            sizes = np.array([len(w) + 1 for w in words], np.int64)
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(words)), sizes)
            for passages in blocks():
                known, items = passages.vocab.get, np.array(passages.ids, object)
                ids = np.fromiter((known(w, 0) for part in words for w in (*part, None)), np.int64, sizes.sum())
                doc, item, size, pos = search(ids, owner, passages)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(list(items[item]), pa.int64()), pa.array(size, pa.int32()), pa.array(pos - begin[doc], pa.int32()), pa.array(size == passages.lengths[item])],
                    names=["doc_id", "item_id", "n_words", "at_word", "whole"],
                )

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
                    if held > SHARD_CHARS:
                        yield from shard(ids, texts)
                        ids, texts, held = [], [], 0
        if ids:
            yield from shard(ids, texts)

    return run


def leaks(docs: DataFrame, items: DataFrame, n: int = MIN_WORDS, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, n_words, at_word, whole): the longest match of each document and item with at least ``n`` common words."""
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(passage).cast("string").alias("passage")).filter("passage is not null").dropDuplicates()
    size = tests.agg(F.sum(F.length("passage")).alias("n")).first().n or 0
    blocks = max(1, -(-size // (block_words * 4)))
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    mine = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)))
    sent = [spark.sparkContext.broadcast([(r.item_id, r.passage) for r in mine.filter(F.col("block") == k).orderBy("item_id", "passage").collect()]) for k in range(blocks)]
    return corpus.mapInArrow(_searcher(sent, n), _SCHEMA)


def leaked(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The distinct pairs of document and item."""
    return leaks(docs, items, **how).select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that hold no passage."""
    hit = leaks(docs, items, **how).select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")
