import random

import pytest

from weftgraph.operators import hierarchy as h


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in parent:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = (min(seen[seen.index(x) :]), -1, None) if x in parent else (x, len(seen), [x, *seen[::-1]])
    return out


def chain(n, rng):
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, ids[1:]))


CASES = {
    "one block": (lambda r: [(i, r.randrange(30)) for i in range(30) if r.random() < 0.8], 1000),
    "many blocks": (lambda r: [(i, r.randrange(60)) for i in range(60) if r.random() < 0.8], 7),
    "tree": (lambda r: [(i, r.randrange(i)) for i in range(1, 150)], 20),
    "chain by doubling": (lambda r: chain(60, r), 7),
    "cycle by doubling": (lambda r: (c := chain(60, r)) + [(c[-1][1], c[20][0])], 7),
    "self loops and repeats": (lambda r: [(1, 1), (2, 1), (2, 1), (3, 2), (None, 4), (5, None), (6, 7), (6, 8)], 100),
    "empty": (lambda r: [], 10),
}


@pytest.mark.parametrize("case", CASES)
def test_forest(spark, case):
    make, block = CASES[case]
    links = make(random.Random(3))
    df = spark.createDataFrame([(*x, 1) for x in links], "c long, p long, depth int")
    got = {r.node: (r.root, r.depth, r.path) for r in h.forest(df, "c", "p", True, block).collect()}
    assert got == brute(links)


def test_corpus(spark):
    corpora = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "corpus_id long")
    texts = spark.createDataFrame([(2, 0), (2, 0), (3, 1), (9, 0), (2, None), (None, 1)], "corpus_ref long, text_id long")
    edges = [(2, 1, "PartOf", "annis", ""), (3, 3, "PartOf", "annis", ""), (10, 11, "Dominance", "syntax", ""), (11, 12, "Dominance", "syntax", ""), (None, 13, "Dominance", "syntax", ""), (10, 14, "Dominance", "syntax", "edge")]
    e = spark.createDataFrame(edges, "source long, target long, ctype string, anno_layer string, cname string")
    got = {(r.hier, r.node_key): (r.root_id, r.depth) for r in h.corpus_hierarchies(corpora, texts, e).collect()}
    assert got == {("corpus", "1"): (1, 0), ("corpus", "2"): (1, 1), ("corpus", "3"): (3, -1), ("corpus", "4"): (4, 0), ("text", "2/0"): (1, 2), ("text", "3/1"): (3, -1), ("syntax", "10"): (10, 0), ("syntax", "11"): (10, 1), ("syntax", "12"): (10, 2), ("syntax", "13"): (13, 0)}
    tree = h.hierarchy(corpora.selectExpr("corpus_id as node"), e.filter("ctype = 'PartOf'"), "source", "target", True)
    assert {tuple(r) for r in h.descendants(tree).collect()} == {(1, 2, 1)}


@pytest.mark.parametrize("case", ["many blocks", "cycle by doubling", "self loops and repeats", "empty"])
def test_ancestors(spark, case):
    make, block = CASES[case]
    links = make(random.Random(3))
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    want = set()
    for n in parent:
        seen, x = [n], parent[n]
        while x is not None and x not in seen:
            want.add((n, x, len(seen)))
            seen.append(x)
            x = parent.get(x)
    got = [tuple(r) for r in h.ancestors(spark.createDataFrame(links, "c long, p long"), "c", "p", block).collect()]
    assert set(got) == want and len(got) == len(want)
