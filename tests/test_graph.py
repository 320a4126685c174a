"""A small graph against a brute-force evaluator, and the store around it."""

import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from weftgraph.aql.analyze import parse
from weftgraph.plans import subgraph
from weftgraph.aql.model import Range
from weftgraph.plans.execute import count_extra, execute, find, frequency
from weftgraph.plans.reach import pairs
from weftgraph.sources.updates import EVENT_SCHEMA, apply_updates, empty_graph, event, graph_of_events
from weftgraph.store import CorpusStore
from weftgraph.streaming.ingest import follow

TOKENS = ["d1#t0", "d1#t1", "d1#t2", "d1#t3", "d1#t4", "d2#t0", "d2#t1", "d2#lone"]
SPANS = {"d1#s0": (0, 1), "d1#s1": (1, 3), "d1#s2": (2, 4), "d2#s0": (5, 6)}
DOM = [("d1#n0", "d1#n1"), ("d1#n0", "d1#t4"), ("d1#n1", "d1#t0"), ("d1#n1", "d1#t1"), ("d2#n0", "d2#t0")]
POINT = [("d1#t0", "d1#t1"), ("d1#t1", "d1#t2"), ("d1#t2", "d1#t0"), ("d1#t2", "d1#t3")]


def items():
    for c in ("root", "root/d1", "root/d2"):
        yield "node", c, "corpus"
    for c in ("root/d1", "root/d2"):
        yield "label", c, "annis", "doc", c[5:]
        yield "edge", c, "root", "PartOf", "annis", ""
    nodes = [*TOKENS, *SPANS, "d1#n0", "d1#n1", "d2#n0"]
    for n in nodes:
        yield "node", f"root/{n}", "node"
        yield "edge", f"root/{n}", "root/" + n[:2], "PartOf", "annis", ""
    for i, t in enumerate(TOKENS):
        yield "label", f"root/{t}", "annis", "tok", "ab"[i % 2]
        yield "label", f"root/{t}", "x", "pos", "NVN"[i % 3]
        yield "label", f"root/{t}", "y", "pos", "N"
    for s in SPANS:
        yield "label", f"root/{s}", "x", "span", s[-1]
    for n in ("d1#n0", "d1#n1", "d2#n0"):
        yield "label", f"root/{n}", "x", "cat", "S" if n.endswith("0") else "NP"
    for a, b in zip(TOKENS, TOKENS[1:]):
        if a[:2] == b[:2] and "lone" not in b:
            yield "edge", f"root/{a}", f"root/{b}", "Ordering", "annis", ""
    for s, (i, j) in SPANS.items():
        for t in TOKENS[i : j + 1]:
            yield "edge", f"root/{s}", f"root/{t}", "Coverage", "x", ""
    for a, b in DOM:
        yield "edge", f"root/{a}", f"root/{b}", "Dominance", "x", ""
        yield "edge_label", f"root/{a}", f"root/{b}", "Dominance", "x", "", "x", "func", "h" if b.endswith("t0") else "m"
    for a, b in POINT:
        yield "edge", f"root/{a}", f"root/{b}", "Pointing", "x", "dep"


@pytest.fixture(scope="module")
def graph(spark):
    return graph_of_events(spark, items(), "root")


class Brute:
    """The query language by its definitions, over all combinations of matches."""

    def __init__(self):
        self.labels, self.types, self.edges, self.edge_labels = {}, {}, set(), {}
        for kind, *x in items():
            if kind == "node":
                self.types[x[0]] = x[1]
                self.labels.setdefault(x[0], {}).update({("annis", "node_name"): x[0], ("annis", "node_type"): x[1]})
            elif kind == "label":
                self.labels.setdefault(x[0], {})[x[1], x[2]] = x[3]
            elif kind == "edge":
                self.edges.add(tuple(x))
            else:
                self.edge_labels[tuple(x[:5])] = (x[6], x[7])
        self.covering = {e[0] for e in self.edges if e[2] == "Coverage"}
        self.order = {e[0]: e[1] for e in self.edges if e[2] == "Ordering"}
        self.place = {}
        for t in [n for n in self.types if ("annis", "tok") in self.labels.get(n, {}) and n not in self.covering]:
            if t not in self.order.values():
                p, at = t, 0
                while p:
                    self.place[p] = (t, at)
                    p, at = self.order.get(p), at + 1
        down = {}
        for e in self.edges:
            if e[2] in ("Coverage", "Dominance"):
                down.setdefault(e[0], set()).add(e[1])
        self.cover = {}
        for n in self.types:
            seen, todo = set(), [n]
            while todo:
                c = todo.pop()
                for d in down.get(c, ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            toks = {t for t in seen | {n} if t in self.place}
            if toks:
                self.cover[n] = toks

    def span(self, n):
        on = sorted(self.place[t] for t in self.cover.get(n, ()))
        return (on[0][0], on[0][1], on[-1][1]) if on else None

    def paths(self, a, ctype, name):
        out, todo = {}, [(a, (a,))]
        while todo:
            at, path = todo.pop()
            for e in self.edges:
                if e[0] == at and e[2] == ctype and (name is None or e[4] == name) and e[1] not in path:
                    out.setdefault(e[1], set()).add(len(path))
                    todo.append((e[1], (*path, e[1])))
        return out

    def scan(self, s):
        import re

        hit = lambda v: s.value is None or (bool(re.fullmatch(s.value, v)) if s.regex else v == s.value) != s.negated
        for n, kind in self.types.items():
            own = self.labels.get(n, {})
            if s.kind == "any_node" and kind == "node" or s.kind == "any_token" and n in self.place:
                yield n, ("annis", "node_type"), own.get(("annis", "tok")) if s.kind == "any_token" else None
            elif s.kind == "token" and ("annis", "tok") in own and hit(own["annis", "tok"]) and not (s.leafs_only and n in self.covering):
                yield n, ("annis", "node_type"), own["annis", "tok"]
            elif s.kind == "value":
                for (ns, name), v in own.items():
                    if name == s.name and s.ns in (None, ns) and hit(v):
                        yield n, (ns, name), v

    def holds(self, op, a, b):
        within = lambda d: op.dist.low <= d and (op.dist.high is None or d <= op.dist.high)
        kind = op.kind
        if kind in ("dominance", "pointing", "part_of"):
            ctype = {"dominance": "Dominance", "pointing": "Pointing", "part_of": "PartOf"}[kind]
            if op.edge:
                e = (a[0], b[0], ctype, "x", op.name)
                return e in self.edges and self.edge_labels.get(e) == (op.edge.name, op.edge.value)
            return any(within(d) for d in self.paths(a[0], ctype, None if kind == "part_of" else op.name).get(b[0], ()))
        if kind == "ident_node":
            return a[0] == b[0]
        if kind in ("equal", "not_equal"):
            return a[2] is not None and b[2] is not None and (a[2] == b[2]) == (kind == "equal")
        if kind == "overlap":
            return bool(self.cover.get(a[0], set()) & self.cover.get(b[0], set()))
        x, y = self.span(a[0]), self.span(b[0])
        if not x or not y or x[0] != y[0]:
            return False
        return {"precedence": lambda: within(y[1] - x[2]), "near": lambda: within(y[1] - x[2]) or within(x[1] - y[2]), "inclusion": lambda: x[1] <= y[1] and y[2] <= x[2], "ident_cov": lambda: x == y, "left": lambda: x[1] == y[1], "right": lambda: x[2] == y[2]}[kind]()

    def query(self, text):
        out = []
        for c in parse(text).alternatives:
            shown = c.output()
            for row in product(*[list(self.scan(c.nodes[i].search)) for i in shown]):
                at = dict(zip(shown, row))
                ok = all(self.holds(j.op, at[j.left], at[j.right]) != j.negated for j in c.joins)
                ok = ok and all(j.negated or j.op.reflexive or at[j.left][:2] != at[j.right][:2] for j in c.joins)
                for i, r in c.arity:
                    n = len({e[1] for e in self.edges if e[0] == at[i][0] and e[2] in ("Dominance", "Pointing")})
                    ok = ok and r.low <= n and (r.high is None or n <= r.high)
                for x in c.absent:
                    ok = ok and not any(self.holds(x.op, t, at[x.node]) if x.target_left else self.holds(x.op, at[x.node], t) for t in self.scan(x.target))
                if ok:
                    out.append(tuple(x for i in shown for x in (at[i][0], *at[i][1])))
        return sorted(set(out)) if len(parse(text).alternatives) > 1 else sorted(out)


QUERIES = """tok
node
pos
x:pos="N"
pos!="N"
pos=/N|V/
pos!=/V.*/
tok="a"
tok!="a"
"b"
/a|b/
tok . tok
tok .2 tok
tok .2,3 tok
tok .* tok
tok .1,100 tok
span . tok
tok ^ tok
span ^1,2 tok
tok ^* tok
span _o_ span
span _o_ tok
span _i_ tok
span _i_ span
cat _i_ span
cat _=_ tok
span _l_ tok
span _r_ tok
x:pos _=_ y:pos
x:pos _=_ x:pos
pos _l_ pos
tok _=_ node
x:pos _ident_ y:pos
cat > cat
cat > tok
cat >* tok
cat >1,2 node
cat >2 tok
cat >[func="h"] tok
tok ->dep tok
tok ->dep 2 tok
tok ->dep 1,3 tok
tok ->dep * tok
tok @ annis:doc="d1"
tok @* annis:doc
node @* annis:node_name="root"
x:pos & x:pos & #1 . #2 & #1 == #2
tok & tok & #1 . #2 & #1 != #2
tok .1,3 tok & #1 !.2 #2
cat & tok & #1 >* #2 & #1 !> #2
span _o_ tok & #1 !_i_ #2
span & span & #1 . #2 & #1 !_o_ #2
span _o_ span & #1 !_l_ #2
tok? !. tok
tok !. tok?
span !_o_ tok="a"?
x:pos="V"? !_i_ span
cat !> tok?
tok !->dep tok?
tok !^1,2 span?
cat & #1:arity=2
cat & #1:arity=1,3
tok & #1:arity=*
tok . tok . tok
cat > cat > tok
span _i_ tok . tok & #1 _i_ #3
tok="a" . tok | tok="b" . tok
tok . tok | x:pos="N"
(tok="a" | tok="b") & x:pos="N" & #1 _=_ #2""".split("\n")


@pytest.mark.parametrize("text", QUERIES)
def test_against_brute_force(graph, text):
    try:
        want = Brute().query(text)
    except ValueError:  # numbered nodes of one alternative only
        with pytest.raises(ValueError):
            execute(graph, text)
        return
    names = {r.node_id: r.node_name for r in graph.node.collect()}
    got = []
    for r in execute(graph, text).collect():
        d = r.asDict()
        width = sum(c[0] == "m" and c[1:].isdigit() for c in d)
        got.append(tuple(x for p in range(1, width + 1) if d[f"m{p}"] is not None for x in (names[d[f"m{p}"]], d[f"ns{p}"], d[f"name{p}"])))
    assert sorted(got) == want


def test_verbs(graph):
    assert tuple(count_extra(graph, "tok").first()) == (8, 2)
    assert [r.match for r in find(graph, 'tok="a"').collect()] == ["root/d1#t0", "root/d1#t2", "root/d1#t4", "root/d2#t1"]
    assert [r.match for r in find(graph, "tok", order="inverted").collect()] == [r.match for r in find(graph, "tok").collect()][::-1]
    assert [r.match for r in find(graph, "tok", 2, 3).collect()] == ["root/d1#t2", "root/d1#t3", "root/d1#t4"]
    assert [r.match for r in find(graph, "x:pos . cat").collect()] == []
    assert {r.value2 for r in frequency(graph, 'tok . x:pos="N"', [(1, "annis", "tok"), (2, None, "cat")]).collect()} == {""}
    got = {(r.value1, r.n) for r in frequency(graph, "tok", [(1, "annis", "tok")]).collect()}
    assert got == {("a", 4), ("b", 4)}


def test_context(graph):
    names = {r.node_id: r.node_name for r in graph.node.collect()}
    match = execute(graph, 'annis:node_name="root/d1#t2"')
    g = subgraph.context(graph, match, 1, 9)
    toks = {names[r.node_id] for r in g.node.collect()} & {f"root/{t}" for t in TOKENS}
    assert toks == {f"root/d1#t{i}" for i in (1, 2, 3, 4)}
    assert {"root", "root/d1", "root/d1#s0", "root/d1#n1"} <= {names[r.node_id] for r in g.node.collect()}
    two = execute(graph, "annis:node_name=/root.d1#t[03]/")
    gaps = subgraph.context(graph, two, 0, 0).edge.filter(F.col("cname") == subgraph.GAP).collect()
    assert [(names[r.source], names[r.target]) for r in gaps] == [("root/d1#t0", "root/d1#t3")]


def test_segmentation_context(spark):
    def two_layers():
        for i in range(8):
            yield "node", f"t{i}", "node"
            yield "label", f"t{i}", "annis", "tok", str(i)
            if i:
                yield "edge", f"t{i - 1}", f"t{i}", "Ordering", "annis", ""
        for i, (a, b) in enumerate([(0, 1), (2, 2), (4, 6), (7, 7)]):
            yield "node", f"s{i}", "node"
            yield "label", f"s{i}", "annis", "tok", f"s{i}"
            for t in range(a, b + 1):
                yield "edge", f"s{i}", f"t{t}", "Coverage", "default_ns", ""
            if i:
                yield "edge", f"s{i - 1}", f"s{i}", "Ordering", "default_ns", "norm"

    g = graph_of_events(spark, two_layers(), "c")
    names = {r.node_id: r.node_name for r in g.node.collect()}
    of = lambda q, left, right, seg: {names[r.node_id] for r in subgraph.context(g, execute(g, q), left, right, seg).node.collect() if names[r.node_id][0] == "t"}
    assert of('tok="2"', 1, 1, "norm") == {f"t{i}" for i in range(7)}
    assert of('tok="7"', 1, 5, "norm") == {"t4", "t5", "t6", "t7"}
    assert execute(g, "node .norm,2 node").count() == 2 and execute(g, "node ^norm node").count() == 6
    assert execute(g, '"s0" .norm,1,3 "s3"').count() == 1 and execute(g, '"s0" .norm * "s3"').count() == 1 and execute(g, "tok .norm tok").count() == 0


def test_updates(spark, graph):
    evs = [
        event(0, "delete_node", node="root/d1#t4"), event(1, "add_node", node="root/d1#t4", node_type="node"), event(2, "add_node_label", node="root/d1#t4", ns="annis", name="tok", value="c"), event(3, "add_edge", source="root/d1#t3", target="root/d1#t4", ctype="Ordering", layer="annis", cname=""),
        event(4, "add_node_label", node="nobody", ns="a", name="b", value="c"), event(5, "add_edge", source="root/d1#t0", target="nobody", ctype="Pointing", layer="x", cname="dep"), event(6, "add_node_label", node="root/d1#t0", ns="x", name="pos", value="new"), event(7, "delete_node_label", node="root/d1#t1", ns="x", name="pos"),
        event(8, "delete_edge", source="root/d1#t0", target="root/d1#t1", ctype="Pointing", layer="x", cname="dep"), event(9, "add_edge_label", source="root/d1#t0", target="root/d1#t1", ctype="Pointing", layer="x", cname="dep", ns="", name="l", value="v"), event(10, "add_node", node="root/d1#t0", node_type="other"),
    ]
    g = apply_updates(graph, spark.createDataFrame(evs, EVENT_SCHEMA), "root")
    ids = {r.node_name: r.node_id for r in g.node.collect()}
    old = {r.node_name: r.node_id for r in graph.node.collect()}
    assert len(ids) == len(old) == len(set(ids.values())) and ids["root/d1#t0"] == old["root/d1#t0"]
    labels = {(r.node_id, r.ns, r.name): r.value for r in g.anno.collect()}
    assert labels[ids["root/d1#t0"], "x", "pos"] == "new" and (ids["root/d1#t1"], "x", "pos") not in labels
    assert {k[1:]: v for k, v in labels.items() if k[0] == ids["root/d1#t4"]} == {("annis", "tok"): "c"}
    assert execute(g, 'tok . tok="c"').count() == 1 and execute(g, "cat > tok").count() == 3
    assert execute(g, "tok ->dep tok").count() == 3 and g.edge_anno.filter("name = 'l'").count() == 0


def test_store(spark, graph, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "data"))
    store.save("root", graph)
    assert store.corpora() == ["root"] and store.create("other") and not store.create("other")
    for q in ("tok . tok", "cat >* tok", "span _o_ tok"):
        assert store.count("root", q).first()[0] == execute(graph, q).count()
    assert store.count(["root", "other"], "tok").first()[0] == 8
    assert {r.corpus for r in store.find(["root", "other"], "tok", order="random").collect()} == {"root"}
    assert store.find("root", "tok", order="unsorted").count() == 8
    (tmp_path / "a" / "sub").mkdir(parents=True)
    (tmp_path / "a" / "sub" / "f.txt").write_text("linked")
    store.apply_updates("files", spark.createDataFrame([event(0, "add_node", node="r/f", node_type="file"), event(1, "add_node_label", node="r/f", ns="annis", name="file", value="sub/f.txt")], EVENT_SCHEMA))
    store.export_to("files", str(tmp_path / "a" / "files.graphml"))
    assert store.import_from(str(tmp_path / "a" / "files.graphml"), corpus="linked") == "linked"
    store.export_to("linked", str(tmp_path / "l.zip"))
    assert store.import_from(str(tmp_path / "l.zip"), corpus="again") == "again"
    assert [p.read_text() for p in store.linked_files("again").values()] == ["linked"]
    store.delete("linked")
    store.delete("files")
    store.export_to("root", str(tmp_path / "x.zip"))
    again = store.import_from(str(tmp_path / "x.zip"), corpus="again")
    assert again == "again" and store.count("again", "cat >* tok").first()[0] == execute(graph, "cat >* tok").count()
    assert store.frequency("root", "tok", ["1:annis::tok"]).count() == 2 and "Exchange" in store.plan("root", "tok . tok")
    assert store.with_timeout(store.count("root", "node"), 60)[0][0] == 15
    with pytest.raises(TimeoutError):
        store.with_timeout(spark.range(1).select(F.udf(lambda i: time.sleep(20))("id")), 0.5)
    store.configure("other", "[context]\ndefault = 5\n")
    assert store.configuration("other").startswith("[context]") and store.configuration("root") == ""
    assert {(r.name, r.n) for r in store.info("root").collect()} >= {("node", 18), ("Dominance/x/", 5)}
    assert store.graph("root").depth == {"PartOf": 2} and not store.graph("root").texts_are_tokens == any(s in TOKENS for s in SPANS)
    folder = tmp_path / "in"
    spark.createDataFrame([event(0, "add_node", node="root/d1#new", node_type="node")], EVENT_SCHEMA).write.json(str(folder))
    follow(spark.readStream.schema(EVENT_SCHEMA).json(str(folder)), store, "root", str(tmp_path / "cp")).awaitTermination()
    assert store.count("root", "node").first()[0] == 16
    assert store.delete("again") and store.corpora() == ["other", "root"]
    with pytest.raises(KeyError):
        store.count("again", "tok")


def test_paths_of_any_length(spark):
    links = [("a", i, i + 1) for i in range(66)] + [("a", 100, 66)]  # node 66 has two parents
    found = pairs(spark.createDataFrame(links, "corpus string, source long, target long"), Range(65, 70))
    assert {tuple(r) for r in found.collect()} == {("a", 0, 65), ("a", 1, 66), ("a", 0, 66)}


def test_paths_of_several_corpora(spark):
    links = [(c, i, i + 1) for c, n in (("a", 70), ("b", 68)) for i in range(n)] + [("b", 200, 201), ("b", 201, 200), ("b", 201, 202)]
    df = spark.createDataFrame(links, "corpus string, source long, target long")
    one = {tuple(r) for c in "ab" for r in pairs(df.filter(df.corpus == c), Range(7, 80)).collect()}
    assert one == {(c, i, j) for c, n in (("a", 70), ("b", 68)) for i in range(n + 1) for j in range(i + 7, n + 1)}
    assert {tuple(r) for r in pairs(df, Range(7, 80)).collect()} == one
    near = {tuple(r) for r in pairs(df, Range(2, 8)).collect()}
    assert {t for t in near if t[1] >= 200} == {("b", 200, 202)} and ("a", 0, 8) in near and ("b", 60, 68) in near


def test_zip_of_several_corpora(spark, graph, tmp_path):
    import zipfile

    store = CorpusStore(spark, str(tmp_path / "data"))
    store.save("root", graph)
    for name in ("one", "two"):
        store.export_to("root", str(tmp_path / f"{name}.graphml"))
    with zipfile.ZipFile(tmp_path / "both.zip", "w") as z:
        z.write(tmp_path / "one.graphml", "x/one.graphml")
        z.write(tmp_path / "two.graphml", "two.GraphML")
    with pytest.raises(ValueError):
        store.import_from(str(tmp_path / "both.zip"), corpus="single")
    assert store.corpora() == ["root"]
    assert sorted(store.import_from(str(tmp_path / "both.zip"))) == ["one", "two"]
    assert store.corpora() == ["one", "root", "two"] and {store.count(c, "tok").first()[0] for c in ("one", "two")} == {8}


def _simple_paths(links):
    out = set()
    for start in {x for link in links for x in link}:
        todo = [(start, (start,))]
        while todo:
            at, path = todo.pop()
            for a, b in links:
                if a == at and b not in path:
                    out.add((start, b, len(path)))
                    todo.append((b, (*path, b)))
    return out


@pytest.mark.parametrize("shape", ["tree and cycles", "reversed", "joint", "joint and cycles"])
def test_paths_of_every_shape(spark, shape):
    tree = [(0, 1), (1, 2), (2, 3), (1, 4), (20, 21), (21, 22), (22, 23), (23, 20), (21, 30), (30, 31), (40, 40), (40, 41)]
    links = {
        "tree and cycles": tree,
        "reversed": [(b, a) for a, b in tree],
        "joint": [(0, 1), (1, 2), (2, 3), (5, 2), (3, 6), (7, 6), (6, 8), (8, 9), (0, 9)],
        "joint and cycles": [*tree, (3, 21), (23, 50), (4, 50), (50, 51), (51, 1)],
    }[shape]
    df = spark.createDataFrame([(c, a, b) for c in "xy" for a, b in links], "corpus string, source long, target long")
    paths = _simple_paths(set(links))
    wanted = {"starts": {1, 21, 50, 8}, "ends": {3, 31, 20, 9, 41}}
    starts, ends = (spark.createDataFrame([(c, n) for c in "xy" for n in wanted[k]], f"corpus string, {k2} long") for k, k2 in (("starts", "source"), ("ends", "target")))
    for dist in (Range(1, None), Range(2, None), Range(3, 9)):
        want = {(c, a, b) for a, b, d in paths for c in "xy" if dist.low <= d and (dist.high is None or d <= dist.high)}
        got = [tuple(r) for r in pairs(df, dist).collect()]
        assert set(got) == want and len(got) == len(want)
    want = {(c, a, b) for a, b, _ in paths for c in "xy" if a in wanted["starts"] and b in wanted["ends"]}
    got = {tuple(r) for r in pairs(df, Range(1, None), starts, ends).collect()}
    assert {r for r in got if r[1] in wanted["starts"] and r[2] in wanted["ends"]} == want
