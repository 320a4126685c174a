import random
from pathlib import Path

import pytest

from weftgraph.llm import encoding as e

pytestmark = pytest.mark.skipif(not Path(e.DEFAULT_PATH).exists(), reason="no vocabulary files")
ODD = ["", " ", "a", "\n\n\n", "x  \n\n y \n", "aaaa " * 50 + "a" * 3000, "<|endoftext|> hi's 'S don't\n'll we'\nve", "日本語テキスト。 नमस्ते दुनिया ​👩‍👩‍👧 ½²٣", "a\x1cb \x1d\n c\x85d", "\r\n\r\n a \t\t b\t", "á é ﬁ Ⅷ", "1234567 a1b2 __x__"]


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(e.DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode(text), "<i4").tolist()


def test_same_as_library():
    encoder, want = e.Encoder(*e.read_vocabulary(), known_chars=2000), reference()
    rng = random.Random(1)
    letters = "abcdeéяΩ漢字 \n\t.,'s0123½ًि‍🙂"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    for t in texts:
        assert ids(encoder, t) == want(t), ascii(t)


def brute(word, merges):
    """Merging by priority, the definition of the encoding."""
    rank = {}
    for k, (a, b, made) in enumerate(merges):
        rank.setdefault((a, b), (k, made))
    parts = list(word)
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [rank[parts[i], parts[i + 1]][1]]


def test_automaton_of_random_merges():
    rng = random.Random(7)
    for _ in range(30):
        words = [bytes([b]) for b in range(256)]
        merges, known = [], [97, 98, 99]
        for _ in range(25):
            a, b = rng.choice(known), rng.choice(known)
            if words[a] + words[b] not in words:
                words.append(words[a] + words[b])
                merges.append((a, b, len(words) - 1))
                known.append(len(words) - 1)
        automaton = e.Automaton(words, merges)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            got = automaton.encode(w)
            assert got == brute(w, merges)
            assert automaton.decode(got) == w


def test_corpus(spark):
    rows = [(1, "hello world\nhello", "x"), (1, "hello world\nhello", "x"), (2, None, "y"), (3, "", "z"), (None, "a" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = e.encode_corpus(df)
    by = {r.doc_id: list(r.ids) for r in got.collect()}
    assert got.count() == 5 and by[2] == [] and by[3] == [] and by[1] == reference()("hello world\nhello")
    assert {r.doc_id: r.text for r in e.decode_corpus(got).collect()} == {1: "hello world\nhello", 2: "", 3: "", None: "a" * 200_000}
    assert e.encode_corpus(df.limit(0)).count() == 0


def test_long_runs_end_soon():
    encoder, want = e.Encoder(*e.read_vocabulary()), reference()
    for t in [" " * 100_000, "\n" * 100_000 + "x", "a" + " " * 100_000 + "\n" * 1000 + "b", " \n" * 50_000, "1" * 100_000, "é" * 100_000]:
        assert ids(encoder, t) == want(t)
    assert sum(len(encoder.automaton.words[i]) for i in ids(encoder, "ab" * 1_000_000)) == 2_000_000
