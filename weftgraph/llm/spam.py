"""Pages of repeated sales keywords, outside link lists or product tags, by a hidden Markov model over their lines.

A page is cut into pieces (a line, or even parts of one of at most ``PIECE``
words). Of each piece some quantities are observed that show in any language:
the shares of text in links to outside hosts and in wiki markup, of words that
are product tags, disguised, function words or sales words, the chance that
another word of the page, or of the piece, is the same one, and the number of
words. Each is rounded to a grid of powers of two (``GRID``), the same for
every piece and page; what isn't defined for a piece (shares of no words) says
nothing. No quantity decides anything by itself.

Four hidden states (prose, link list, tag list, menu) explain the pieces: a
state gives each quantity its own distribution, and steps from piece to piece
have probabilities. Both start from ``LEVELS`` and are fitted by Baum-Welch to
the pieces of a bounded sample of pages (``FIT_PAGES``); the starting values
weigh no more than ``PRIOR`` pieces, so that a sample overrules them. Every
page is then labelled by its most probable path, and flagged if link and tag
lists hold more than half of its words and of its characters. Menus (internal
links, tables, templates) are legitimate, so they count as neither.

Sales words are those that list pieces hold and others hardly do, counted over
all pages labelled without them; the model is then fitted again with them.

Words are runs of letters and digits; of scripts without spaces, which have no
such words, pairs of characters (Han, kana) or ``LONG_GRAM`` of them (Thai and
others). Lines that a worker met before come from a bounded table.

Every page that isn't blank is labelled.

Defined cases: null, empty and blank texts are never flagged; texts of any
length are labelled whole; repeated rows are each labelled alike; an empty
table gives no rows; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "link list", "tag list", "menu")
#: Words of a piece.
PIECE = 40
#: Pages whose pieces fit the model, and rounds of fitting.
FIT_PAGES = 1000
FIT_ROUNDS = 8
#: Pieces of each state that its starting values weigh as much as, for the quantities and for the steps.
PRIOR = 300.0
#: Characters of pages that are labelled at once (at least a page).
CHARS_AT_ONCE = 2_000_000
#: Characters of lines, and different words, that a worker remembers.
LINE_CHARS, WORDS = 6_000_000, 1_000_000

_SHARES = (1e-9, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
_CHANCES = (1e-9, 1 / 256, 1 / 128, 1 / 64, 1 / 32, 1 / 16)
#: The observed quantities and the grid each is rounded to.
GRID = {
    "links": _SHARES,
    "markup": _SHARES,
    "tags": _SHARES,
    "disguised": _SHARES,
    "function": _SHARES,
    "same on page": _CHANCES,
    "same in piece": _CHANCES,
    "words": (1, 3, 6, 12, 24),
    "sales": _SHARES,
}
#: The step of each quantity's grid around which a state starts, a row for each state.
LEVELS = np.array(
    [
        [0.0, 1.0, 0.0, 0.0, 4.0, 2.5, 0.5, 4.0, 0.0],
        [5.0, 1.0, 0.5, 0.0, 1.0, 3.5, 1.0, 3.0, 1.5],
        [0.5, 0.5, 1.5, 1.5, 0.5, 5.0, 3.0, 4.0, 4.0],
        [0.0, 4.0, 0.0, 0.0, 1.0, 3.0, 0.5, 2.0, 0.0],
    ]
)
START = np.array([0.5, 0.15, 0.15, 0.2])
MOVE = np.array([[0.85, 0.03, 0.03, 0.09], [0.06, 0.86, 0.04, 0.04], [0.06, 0.04, 0.86, 0.04], [0.16, 0.03, 0.03, 0.78]])

#: Frequent function words of some languages, of three letters or more or often at hand.
FUNCTION_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his in into is it its more not of on or our she that the their there they this to was were will with you your
    am auf aus bei bis das dem den der des die dort ein eine einem einen einer er es für im ist mit nach nicht noch oder sich sie sind und von vor war wurde zu zum zur
    al como con de del desde el en es esta está fue ha hoy la las lo los más no para pero por que se según su sus un una y
    au aux avec ce ces cette dans de des du elle en est et fut il la le les leur lui mais ne on ou par pas plus pour que qui sa se ses son sont sur un une à été
    в во для до же за из и к как на не но о от по с со также то у что был была было это""".split()
)
_LINK = re.compile(r"<a\s[^<>]*>?[^<>\n]*(?:</a>)?|\[(?:https?:)?//[^\]\n]*\]?|https?://[^\s<]+|www\.[^\s<]+", re.IGNORECASE)
_REF = re.compile(r"<ref[^<>]*>[^<>]*(?:</ref>)?|</?[a-z][^<>]*>|\{\{(?:cite|cleanup|expand|unreferenced|citation)[^{}]*\}\}", re.IGNORECASE)
_INNER = re.compile(r"\[\[[^\[\]]*\]\]?")
_TAG = re.compile(r"#\w+|SKU[-: ]?\d+|[€$£¥]\s?\d[\d.,]*|(?<![\d.,])\d[\d.,]*+\s?[€£¥]|[★☆✓✔]++|[-+]\d++ ?%|IN STOCK", re.IGNORECASE)
_DOTTED = re.compile(r"\b(?:\w[.·*_](?:[-][.·*_])?){2,}\w\b")
_BREAK = re.compile(r"\n|<br\s*/?>", re.IGNORECASE)
_WORD = re.compile(r"[\w@$]+")
_MARK = re.compile(r"\[\[[^\[\]]*\]\]|\{\{[^{}|]*|\|\||\|-|\{\||\|\}|!!|^[*#:;!|=]+|\|[\w ]++=|\}\}", re.MULTILINE)
_FOLD = str.maketrans("013457@$", "oieastas")
_DISGUISED = re.compile(r"(?=[^\W\d_]*[0134579@$])(?=.*[^\W\d_])[\w@$]{3,}$")
#: What any match of _DOTTED and of _TAG (besides sku, in stock) holds.
_SPREAD = re.compile(r"[.·*_](?:-[.·*_])?\w[.·*_]")
_SIGN = re.compile(r"[#€$£¥★☆✓✔%]")
#: Scripts without spaces, each run of them for itself; those (and Hangul) whose words are mostly two characters; pairs of grammar rather than of things.
_HAN = "\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_KANA = "\u3041-\u3096\u30a1-\u30fa\u30fc\u31f0-\u31ff\uff66-\uff9f"
_JOINED = "\u0e00-\u0e4e\u0e80-\u0ece\u0f40-\u0fbc\u1000-\u103f\u1050-\u108f\u1780-\u17d3"
_UNSPACED = re.compile(f"[{_HAN}{_KANA}{_JOINED}]")
_PAIRED = re.compile(f"[{_HAN}{_KANA}\uac00-\ud7a3]")
_RUN = re.compile(f"[{_HAN}{_KANA}]+|[{_JOINED}]+|(?:(?![{_HAN}{_KANA}{_JOINED}])(?:[^\\W_]|[@$]))+")
_GRAMMAR = re.compile("(?=.{1,2}$).?[\u3041-\u3096的了是在和与與为為之也于於]")
#: Characters of a word of the scripts without spaces that spell sounds.
LONG_GRAM = 5
#: A sales word stands in list pieces of so many pages, and so many times as often as elsewhere; at most so many are kept.
WORD_PAGES, WORD_RATIO, SALES_WORDS = 3, 4, 50_000


def _parts(run: str) -> list[str]:
    """The words of a run of letters and digits: itself without disguise, and n-grams of scripts without spaces."""
    out: list[str] = []
    for w in _RUN.findall(run):
        if _UNSPACED.match(w):
            size = 2 if _PAIRED.match(w) else LONG_GRAM
            out.extend([w[i : i + size] for i in range(max(1, len(w) - size + 1))])
        else:
            out.append(w)
    return out


def _counts(word: str) -> bool:
    """Whether repeating a word tells anything."""
    return (len(word) > 2 or len(word) == 2 and not word.isascii() and _PAIRED.match(word) is not None) and word not in FUNCTION_WORDS and not word.isdigit() and (word.isascii() or not _GRAMMAR.match(word))


class Words(dict):
    """Words as numbers, with what each is known to be; equal numbers in ``plain`` are one word, however disguised."""

    def __init__(self, sales: frozenset[str]):
        self.sales, self.text, self.plain = sales, [], np.zeros(1024, np.int64)
        self.flags = np.zeros((4, 1024), np.float32)  # tells something if repeated, function word, sales word, disguised

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self.text)
        self.text.append(w)
        if k == len(self.plain):
            self.plain = np.concatenate([self.plain, self.plain])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)], 1)
        real = w if w.isalpha() or w.isdigit() else w.replace("_", "").translate(_FOLD)
        self.plain[k] = k if real == w else self[real]
        grammar = not w.isascii() and _GRAMMAR.match(w) is not None
        self.flags[:, k] = _counts(real), real in FUNCTION_WORDS or grammar, real in self.sales, real != w and _DISGUISED.match(w) is not None
        return k


class Lines(dict):
    """Lines as they were read, by number (-1: blank), and the words of a worker; both of a bounded size."""

    def __init__(self, sales: frozenset[str] = frozenset()):
        self.sales = sales
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words = Words(self.sales)
        self.held = self.n = 0
        self.stats = np.zeros((1024, len(_STATS)))
        self.ids = np.zeros(1 << 15, np.int32)
        self.first = np.zeros(1025, np.int64)

    def __missing__(self, line: str) -> int:
        if not line or line.isspace():
            self[line] = -1
            return -1
        k = self.n
        self.n += 1
        if k == len(self.stats):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)])
            self.first = np.concatenate([self.first, np.zeros(k, np.int64)])
        words, self.stats[k] = self._read(line)
        begin, end = self.first[k], self.first[k] + len(words)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin:end] = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self.first[k + 1] = end
        self.held += len(line)
        self[line] = k
        return k

    def _read(self, line: str) -> tuple[list[str], tuple]:
        """The words that are no links and no markup, and the counts named by ``_STATS``."""
        # each pattern is tried only where something stands that any match of it holds
        low = line.lower()
        angle = "<" in line
        spread = _REF.sub(" ", line) if angle or "{{" in line else line
        links = sum([len(m) for m in _LINK.findall(line)]) if angle or "//" in line or "www." in low else 0
        rest = _LINK.sub(" ", spread) if links else spread
        inner = plain = _INNER.sub(" ", rest) if "[[" in rest else rest
        dotted = 0
        if ("." in plain or "*" in plain or "·" in plain) and _SPREAD.search(plain):
            dotted = len(_DOTTED.findall(plain))
            if dotted:
                plain = _DOTTED.sub(lambda m: re.sub(r"[.·*_]", "", m[0]), plain)
        tags = len(_TAG.findall(inner)) if _SIGN.search(inner) or "ku" in low or "tock" in low else 0
        words = every = _WORD.findall(low)
        if plain is not line:
            words = _WORD.findall(plain.lower())
        if not line.isascii() and _UNSPACED.search(line):
            words = [p for w in words for p in _parts(w)]
            every = max(every, words, key=len)
        marked = line[0] in "*#:;!|=" or "[[" in line or "{{" in line or "|" in line or "!!" in line or "}}" in line
        markup = sum([len(m) for m in _MARK.findall(line)]) if marked else 0
        return words, (len(line), len(every), links, markup, tags, dotted)


#: What is counted of a line.
_STATS = ("chars", "words", "links", "markup", "tags", "dotted")


@dataclass
class Observed:
    """The pieces of some pages: quantities as steps of their grids (-1: not defined), words and characters, and whose they are.

    ``word``, ``word_piece`` and ``word_page`` have the words that repeating
    tells something of, in order of page and word.
    """

    steps: np.ndarray
    words: np.ndarray
    chars: np.ndarray
    page: np.ndarray
    word: np.ndarray
    word_piece: np.ndarray
    word_page: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), np.nan)


def observe(texts: list[str], lines: Lines) -> Observed:
    """The pieces of pages, in order."""
    if lines.held > LINE_CHARS or len(lines.words) > WORDS:
        lines.forget()
    cut = [_BREAK.split(t) if "<b" in t or "<B" in t else t.split("\n") for t in texts]
    number = np.fromiter(map(lines.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
    on = np.repeat(np.arange(len(texts)), [len(c) for c in cut])[number >= 0]
    number = number[number >= 0]
    n = len(number)
    rows = dict(zip(_STATS, lines.stats[number].T))
    first = lines.first[number]
    own = lines.first[number + 1] - first
    cuts = np.maximum(1, -(-own // PIECE))
    line = np.repeat(np.arange(n), cuts)
    page = on[line]
    at = np.repeat(np.arange(n), own)
    place = np.arange(len(at)) - (np.cumsum(own) - own)[at]
    ids = lines.ids[first[at] + place]
    piece = (np.cumsum(cuts) - cuts)[at] + place * cuts[at] // np.maximum(own[at], 1)
    k = len(line)
    n_words = np.bincount(piece, minlength=k)
    counts, function, sales, disguised = (f[ids] for f in lines.words.flags)
    telling = counts > 0
    n_telling = np.bincount(piece[telling], minlength=k)
    word, where = lines.words.plain[ids[telling]], piece[telling]
    whose = page[where]
    order = np.argsort(whose * max(1, len(lines.words)) + word, kind="stable")
    word, where, whose = word[order], where[order], whose[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (whose[1:] != whose[:-1])][: len(word)]
    here = new | np.r_[True, where[1:] != where[:-1]][: len(word)]

    def chance(begins: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Of each piece, how probably another of ``total`` words is the same as one of its own; not defined if none is among fewer pairs than the grid's finest step."""
        run = np.cumsum(begins) - 1
        same = np.bincount(where, np.bincount(run)[run] - 1, k) if len(run) else np.zeros(k)
        of = n_telling * (total - 1)
        return np.where((same > 0) | (of * _CHANCES[1] >= 1), _share(same, of), np.nan)

    of_page = np.bincount(whose, minlength=len(texts))[page] if k else n_telling
    quantities = {
        "links": (rows["links"] / rows["chars"])[line],
        "markup": (rows["markup"] / rows["chars"])[line],
        "tags": _share(rows["tags"], own)[line],
        "disguised": _share(np.bincount(piece, disguised, k) + (rows["dotted"] / cuts)[line], n_words),
        "function": _share(np.bincount(piece, function, k), n_words),
        "same on page": chance(new, of_page),
        "same in piece": chance(here, n_telling),
        "words": n_words.astype(np.float64),
        "sales": _share(np.bincount(piece, sales, k), n_telling) if lines.sales else np.full(k, np.nan),
    }
    steps = np.stack([np.where(np.isnan(q), -1, np.searchsorted(GRID[name], q, "right")) for name, q in quantities.items()], 1).astype(np.int8)
    return Observed(steps, (rows["words"] / cuts)[line], (rows["chars"] / cuts)[line], page, word, where, whose)


def starting_emissions() -> np.ndarray:
    """(quantity, state, step): falling off by a factor e for each step away from the state's level."""
    widest = max(len(g) for g in GRID.values()) + 1
    out = np.zeros((len(GRID), len(STATES), widest + 1))
    for q, grid in enumerate(GRID.values()):
        steps = np.arange(len(grid) + 1)
        near = np.exp(-np.abs(steps - LEVELS[:, q, None]))
        out[q, :, : len(steps)] = near / near.sum(1, keepdims=True)
    out[:, :, -1] = 1  # what isn't defined
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    sales: frozenset[str] = frozenset()

    def likelihood(self, steps: np.ndarray) -> np.ndarray:
        """The log-likelihood of each piece in each state."""
        with np.errstate(divide="ignore"):
            table = np.log(self.emit)
        out = np.zeros((len(steps), len(STATES)))
        for q in range(len(GRID)):
            out += table[q].T[steps[:, q]]
        return out

    def label(self, seen: Observed) -> np.ndarray:
        """The state of each piece on its page's most probable path."""
        like = self.likelihood(seen.steps)
        path = np.zeros(len(like), np.int8)
        start, move = np.log(self.start), np.log(self.move)
        for rows, live in _together(seen.page):
            x = like[rows]
            back = np.zeros((x.shape[1], len(x), len(STATES)), np.int8)
            score = start + x[:, 0]
            for t in range(1, x.shape[1]):
                ways = score[:, :, None] + move
                best = ways.argmax(1)
                on = live[:, t, None]
                back[t] = np.where(on, best, np.arange(len(STATES)))
                score = np.where(on, ways.max(1) + x[:, t], score)
            state = score.argmax(1)
            mine = np.zeros(rows.shape, np.int8)
            pages = np.arange(len(x))
            for t in range(x.shape[1] - 1, -1, -1):
                mine[:, t] = state
                state = back[t, pages, state]
            path[rows[live]] = mine[live]
        return path


def _together(page: np.ndarray, cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pages of like length as rows of piece numbers, and which of these count."""
    if not len(page):
        return
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    size = np.diff(np.r_[first, len(page)])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and size[order[end]] * (end + 1 - at) <= cells and size[order[end]] <= 1.3 * size[order[at]] + 4:
            end += 1
        mine = order[at:end]
        t = np.arange(size[mine].max())
        live = t < size[mine, None]
        yield np.where(live, first[mine, None] + t, first[mine, None]), live
        at = end


def fit(seen: Observed, sales: frozenset[str] = frozenset(), rounds: int = FIT_ROUNDS, prior: float = PRIOR) -> Model:
    """Baum-Welch from the starting values, which stay in as ``prior`` pieces a state."""
    first = starting_emissions()
    model = Model(START, MOVE, first, sales)
    for _ in range(rounds):
        begin, move, held = START * prior / 10, MOVE * prior, np.zeros((len(seen.steps), len(STATES)))
        like = model.likelihood(seen.steps)
        like = np.exp(like - like.max(1, keepdims=True)) + 1e-300
        for rows, live in _together(seen.page):
            x = np.where(live[:, :, None], like[rows], 1.0)
            fore, rear, scale = np.zeros_like(x), np.ones_like(x), np.ones(x.shape[:2])
            for t in range(x.shape[1]):
                f = (model.start if t == 0 else fore[:, t - 1] @ model.move) * x[:, t]
                scale[:, t] = f.sum(1)
                fore[:, t] = f / scale[:, t, None]
            for t in range(x.shape[1] - 2, -1, -1):
                on = live[:, t + 1, None]
                rear[:, t] = np.where(on, (x[:, t + 1] * rear[:, t + 1] / scale[:, t + 1, None]) @ model.move.T, 1.0)
            at = fore * rear
            begin = begin + at[:, 0].sum(0)
            ahead = np.where(live[:, 1:, None], x[:, 1:] * rear[:, 1:] / scale[:, 1:, None], 0.0)
            move = move + model.move * np.einsum("pti,ptj->ij", fore[:, :-1], ahead)
            held[rows[live]] = at[live]
        emit = first * prior
        for q in range(len(GRID)):
            known = seen.steps[:, q] >= 0
            for s in range(len(STATES)):
                emit[q, s] += np.bincount(seen.steps[known, q], held[known, s], emit.shape[2])
        emit[:, :, :-1] /= emit[:, :, :-1].sum(2, keepdims=True)
        emit[:, :, -1] = 1
        model = Model(begin / begin.sum(), move / move.sum(1, keepdims=True), emit, sales)
    return model


def lists(states: np.ndarray) -> np.ndarray:
    return (states == 1) | (states == 2)


_SCHEMA = "doc_id bigint, n_words bigint, word_share double, char_share double"


def _some(b: pa.RecordBatch, text: int) -> Iterator[tuple[list[int], list[str]]]:
    """Rows that aren't blank and their texts, a bounded number of characters at once."""
    rows, texts, held = [], [], 0
    for i, t in enumerate(b.column(text).to_pylist()):
        if t and not t.isspace():
            rows.append(i)
            texts.append(t)
            held += len(t)
            if held > CHARS_AT_ONCE:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def shares(seen: Observed, states: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each page, and the shares of words and of characters in lists."""
    on = lists(states)
    words, chars = (np.bincount(seen.page, w, pages) for w in (seen.words, seen.chars))
    return words, np.bincount(seen.page, seen.words * on, pages) / np.maximum(words, 1), np.bincount(seen.page, seen.chars * on, pages) / np.maximum(chars, 1)


def _labeller(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        lines = Lines(model.sales)
        for b in batches:
            for rows, texts in _some(b, 1):
                seen = observe(texts, lines)
                words, by_words, by_chars = shares(seen, model.label(seen), len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.rint(words).astype(np.int64)), pa.array(by_words), pa.array(by_chars)], names=["doc_id", "n_words", "word_share", "char_share"])

    return run


def tally(seen: Observed, states: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of words numbered below n, the pages with each in list pieces and in others; and the pages that have such pieces."""
    inside = lists(states)
    pairs = [np.unique(seen.word_page[on] * n + seen.word[on]) % n for on in (inside[seen.word_piece], ~inside[seen.word_piece])]
    return *(np.bincount(p, minlength=n) for p in pairs), len(np.unique(seen.page[inside])), len(np.unique(seen.page[~inside]))


def _tallier(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        lines = Lines()
        counts = np.zeros((2, 0), np.int64)
        pages = [0, 0]
        words = lines.words.text

        def told() -> pa.RecordBatch:
            here = np.flatnonzero(counts.any(0))
            return pa.RecordBatch.from_arrays(
                [pa.array(["", *[words[i] for i in here]], pa.string()), *(pa.array(np.r_[pages[k], counts[k, here]], pa.int64()) for k in (0, 1))],
                names=["word", "inside", "outside"],
            )

        for b in batches:
            for _, texts in _some(b, 0):
                seen = observe(texts, lines)
                if lines.words.text is not words:  # they were forgotten, and numbered anew
                    yield told()
                    words, counts, pages = lines.words.text, np.zeros((2, 0), np.int64), [0, 0]
                n = len(words)
                inside, outside, a, z = tally(seen, model.label(seen), n)
                counts = np.pad(counts, ((0, 0), (0, n - counts.shape[1]))) + [inside, outside]
                pages = [pages[0] + a, pages[1] + z]
        yield told()

    return run


def sales_words(docs: DataFrame, model: Model) -> frozenset[str]:
    """The words of list pieces that other pieces hardly have, by the pages of all ``docs`` that hold them.

    A task sends each of its words once (once more for every ``WORDS``
    different ones); at most ``SALES_WORDS`` words, those of the most pages,
    are collected and become part of the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.filter("text is not null").select("text").mapInArrow(_tallier(sent), "word string, inside bigint, outside bigint")
    counts = found.groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).filter((F.col("inside") >= WORD_PAGES) | (F.col("word") == "")).persist()
    pages = counts.filter("word = ''").first()
    words: list = []
    if pages and pages.inside:
        often = F.col("inside") / pages.inside > WORD_RATIO * F.col("outside") / max(pages.outside, 1)
        words = counts.filter((F.col("word") != "") & often).orderBy(F.desc("inside"), "word").limit(SALES_WORDS).collect()
    counts.unpersist()
    sent.destroy()
    return frozenset(r.word for r in words)


def sample_pages(docs: DataFrame, fit_pages: int = FIT_PAGES) -> list[str]:
    """The texts of at most ``fit_pages`` pages, those of the smallest hash, in its order.

    Only pages below a hash that about four times as many pass are sorted, so
    that all tasks together send no more than a few times the sample.
    """
    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    few = docs.filter(F.col("text").isNotNull() & (place < int(min(1.0, 4 * fit_pages / max(n, 1)) * (1 << 40))))
    return [r.text for r in few.orderBy(place).limit(fit_pages).collect()]


def sample_model(docs: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """The model fitted to a sample of pages, with the sales words of all pages."""
    texts = sample_pages(docs, fit_pages)
    sales = sales_words(docs, fit(observe(texts, Lines())))
    return fit(observe(texts, Lines(sales)), sales)


def list_shares(docs: DataFrame, fit_pages: int = FIT_PAGES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_share, char_share) of the pages that aren't blank: the shares of link and tag lists."""
    pages = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(sample_model(pages, fit_pages))
    return pages.filter("text is not null").mapInArrow(_labeller(sent), _SCHEMA)


def spam_pages(docs: DataFrame, share: float = 0.5, **how) -> DataFrame:
    """doc_id of each page that is, by words and by characters, more than ``share`` link and tag lists."""
    return list_shares(docs, **how).filter((F.col("word_share") > share) & (F.col("char_share") > share)).select("doc_id").distinct()
