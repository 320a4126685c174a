import pytest

from weftgraph.plans.execute import execute
from weftgraph.sources import updates
from weftgraph.sources.graphml import export_graphml, import_graphml
from weftgraph.sources.relannis import NULL_VALUE, import_relannis

FILES = {
    "annis.version": "3.3\n",
    "corpus.annis": "2\troot: x\tCORPUS\tNULL\t0\t5\tTRUE\n0\td\tDOCUMENT\tNULL\t1\t2\tFALSE\n1\td\tDOCUMENT\tNULL\t3\t4\tFALSE\n",
    "text.annis": "0\t0\tt\tOne  two.\n1\t0\tt\tx\n",
    "node.annis": "0\t0\t0\tNULL\tt1\t0\t3\t0\t0\t0\tNULL\tNULL\tOne\tFALSE\n1\t0\t0\tmorph\tt2\t5\t8\t1\t1\t1\tNULL\tNULL\ttwo\tFALSE\n2\t0\t0\tNULL\ts1\t0\t8\tNULL\t0\t1\tNULL\tNULL\tNULL\tTRUE\n3\t0\t0\tNULL\tg1\t0\t3\tNULL\t0\t0\t0\tnorm\tone\\\\1\tFALSE\n4\t0\t0\tNULL\tg2\t5\t8\tNULL\t1\t1\t1\tnorm\tNULL\tFALSE\n5\t0\t1\tNULL\tt1\t0\t1\t0\t0\t0\tNULL\tNULL\tx\tFALSE\n",
    "node_annotation.annis": "0\tns\tpos\tN\n2\tNULL\tcat\tS\\tT\n4\tNULL\tnorm\ttwo2\n5\tns\tpos\tNULL\n",
    "component.annis": "0\td\tlay\tNULL\n1\tc\tlay\tcov\n2\tp\tlay\tdep\n",
    "rank.annis": "0\t0\t1\t2\t0\tNULL\t0\n1\t0\t1\t0\t0\t0\t1\n2\t0\t1\t2\t1\tNULL\t0\n3\t0\t1\t0\t2\tNULL\t0\n4\t0\t1\t1\t2\t3\t1\n",
    "edge_annotation.annis": "4\tx\tfunc\tsubj\n",
}


@pytest.fixture(scope="module")
def relannis(tmp_path_factory):
    d = tmp_path_factory.mktemp("rel")
    for name, text in FILES.items():
        (d / name).write_text(text)
    return str(d)


def told(g):
    n = {r.node_id: r.node_name for r in g.node.collect()}
    return (
        {(r.node_name, r.node_type) for r in g.node.collect()},
        {(n[r.node_id], r.ns, r.name, r.value) for r in g.anno.collect()},
        {(n[r.source], n[r.target], r.ctype, r.layer, r.cname) for r in g.edge.collect()},
        {(n[r.source], n[r.target], r.ctype, r.layer, r.cname, r.ns, r.name, r.value) for r in g.edge_anno.collect()},
    )


def test_relannis_and_graphml(spark, relannis, tmp_path, monkeypatch):
    g = import_relannis(spark, relannis)
    nodes, labels, edges, edge_labels = told(g)
    a, b = "root%3A%20x/d", "root%3A%20x/d_duplicated_document_name_2"
    assert {n for n, t in nodes if t == "corpus"} == {"root%3A%20x", a, b} and len(nodes) == 11
    assert {(f"{a}#t1", "annis", "tok-whitespace-after", "  "), (f"{a}#t2", "annis", "tok-whitespace-after", "."), (f"{a}#t2", "annis", "layer", "morph"), (f"{a}#s1", "", "cat", "S\tT"), (f"{a}#g1", "annis", "tok", "one\\1"), (f"{a}#g2", "annis", "tok", "two2"), (f"{b}#t1", "ns", "pos", NULL_VALUE), (a, "annis", "doc", "d")} <= labels
    assert {(f"{a}#t1", f"{a}#t2", "Ordering", "annis", ""), (f"{a}#g1", f"{a}#g2", "Ordering", "default_ns", "norm"), (f"{a}#s1", f"{a}#t1", "Coverage", "lay", "cov"), (f"{a}#s1", f"{a}#t2", "Coverage", "lay", "cov"), (f"{a}#g1", f"{a}#t1", "Coverage", "", ""), (f"{a}#s1", f"{a}#t1", "Dominance", "lay", ""), (f"{a}#t1", f"{a}#t2", "Pointing", "lay", "dep"), (f"{a}#t1", f"{a}#t", "PartOf", "annis", ""), (f"{a}#t", a, "PartOf", "annis", ""), (a, "root%3A%20x", "PartOf", "annis", "")} <= edges
    assert edge_labels == {(f"{a}#t1", f"{a}#t2", "Pointing", "lay", "dep", "x", "func", "subj")}
    assert execute(g, "tok").count() == 3 and execute(g, '"one\\1" .norm "two2"').count() == 1 and execute(g, 'tok ->dep[func="subj"] tok').count() == 1
    export_graphml(g, str(tmp_path / "a.graphml"), stable=True)
    with monkeypatch.context() as m:
        m.setattr(updates.graph_of_events, "__defaults__", (7,))  # events in batches of seven
        again = import_graphml(spark, str(tmp_path / "a.graphml"), "root: x")
    assert told(again) == (nodes, labels, edges, edge_labels)
    export_graphml(again, str(tmp_path / "b.graphml"), stable=True)
    assert (tmp_path / "a.graphml").read_text() == (tmp_path / "b.graphml").read_text()


def test_missing_corpus(spark, tmp_path):
    (tmp_path / "node.annis").write_text("")
    with pytest.raises(ValueError):
        import_relannis(spark, str(tmp_path))
