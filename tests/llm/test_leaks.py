import random

import numpy as np

from weftgraph.llm import leaks as m


def test_words():
    assert m.words_of("Caf&eacute; <b>no</b>thing [[Target page|shown text]] [[Plain]] soft­hy​phen a_b É") == ["café", "no", "thing", "shown", "text", "plain", "softhyphen", "a", "b", "é"]
    assert m.words_of("1 < 2 &lt;i&gt; x") == ["1", "2", "i", "x"]
    assert m.words_of(None) == m.words_of("") == m.words_of(" . ") == []


def brute(doc, passage, n):
    best = 0
    for i in range(len(doc)):
        for j in range(len(passage)):
            k = 0
            while i + k < len(doc) and j + k < len(passage) and doc[i + k] == passage[j + k]:
                k += 1
            best = max(best, k)
    return best if best >= n else 0


def test_search_against_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        word = lambda: rng.choice("abcd")
        items = [(k, " ".join(word() for _ in range(rng.randrange(12)))) for k in range(6)]
        docs = [[rng.choice(["a", "b", "c", "d", "zz"]) for _ in range(rng.randrange(40))] for _ in range(8)]
        p = m.Passages(items, 4)
        parts = [[*(p.vocab.get(w, 0) for w in d), 0] for d in docs]
        flat = np.array([w for x in parts for w in x], np.int64)
        doc_of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        got = {(int(d), items[i][0]): int(n) for d, i, n, _ in zip(*m.search(flat, doc_of, p))}
        want = {(d, k): n for d, x in enumerate(docs) for k, t in items if (n := brute(x, t.split(), 4))}
        assert got == want


def test_equal_and_periodic_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(12):
        period = [rng.choice("ab") for _ in range(rng.randrange(1, 4))]
        items = [(0, " ".join((period * 40)[: rng.randrange(5, 30)])), (1, " ".join(["a"] * 9)), (2, "a b " * 6)]
        docs = [(period * 60)[: rng.randrange(80)] for _ in range(3)] + [["a"] * rng.randrange(30) + ["zz"] + ["a"] * 7]
        p = m.Passages(items, 4)
        parts = [[*(p.vocab.get(w, 0) for w in d), 0] for d in docs]
        flat = np.array([w for x in parts for w in x], np.int64)
        begin = np.cumsum([0, *map(len, parts)])
        got = {(int(d), items[i][0]): (int(n), int(at - begin[d])) for d, i, n, at in zip(*m.search(flat, np.repeat(np.arange(len(parts)), [len(x) for x in parts]), p))}
        for d, x in enumerate(docs):
            for k, t in items:
                n = brute(x, t.split(), 4)
                assert got.get((d, k), (0,))[0] == n
                if n:  # the first place where so many words stand
                    assert got[d, k][1] == min(i for i in range(len(x)) if any(x[i : i + n] == t.split()[j : j + n] and len(t.split()) >= j + n for j in range(len(t.split()))))


def test_many_equal_words_need_little_memory(monkeypatch):
    import tracemalloc

    p = m.Passages([(1, "0 " * 400), (2, "0 1 " * 200), (3, "0 " * 399 + "2")])
    ids = np.array([*[1] * 4_000_000, 0], np.int64)
    tracemalloc.start()
    got = [x.tolist() for x in m.search(ids, np.zeros(len(ids), np.int64), p)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[0, 0], [0, 2], [400, 399], [0, 0]] and peak < 1 << 30


def test_corpus(spark):
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(words[:20])
    docs = [(1, "intro " + passage + " end", 1), (1, "intro " + passage + " end", 1), (2, " ".join(words[5:17]), 2), (3, " ".join(words[5:16]), 3), (4, None, 4), (5, "", 5), (6, "x " * 100_000 + " ".join(words[:12]).upper().replace(" ", "<br>"), 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long").repartition(2)
    items = spark.createDataFrame([(7, passage, "s"), (7, passage, "s"), (8, passage, "s"), (9, "too short", "s"), (10, None, "s"), (11, "", "s")], "item_id long, passage string, doc_id string")
    want = {(doc, item) for doc in (1, 2, 6) for item in (7, 8)}
    for block in (500_000, 5):
        assert {tuple(r) for r in m.leaked(d, items, block_words=block).collect()} == want
    whole = {(r.doc_id, r.n_words, r.whole, r.at_word) for r in m.leaks(d, items).collect()}
    assert whole == {(1, 20, True, 1), (2, 12, False, 0), (6, 12, False, 100_000)}
    assert sorted(r.doc_id for r in m.without_leaks(d, items).collect()) == [3, 4, 5]
    assert m.leaked(d.limit(0), items).count() == m.leaked(d, items.limit(0)).count() == 0


def test_long_runs_end_soon():
    for t in ["<a " * 50_000, "[[a|" * 50_000, "&amp" * 50_000, "<" * 100_000, "[[" * 50_000, "&" * 100_000, "x" * 1_000_000, "é " * 100_000]:
        m.words_of(t)
