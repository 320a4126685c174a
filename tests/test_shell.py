import io

from weftgraph.__main__ import run
from weftgraph.sources.graphml import export_graphml
from weftgraph.sources.updates import graph_of_events


def test_commands(spark, tmp_path):
    def items():
        yield "node", "c", "corpus"
        yield "label", "c", "annis", "doc", "c"
        for i in range(3):
            yield "node", f"c#t{i}", "node"
            yield "label", f"c#t{i}", "annis", "tok", "ab"[i % 2]
            yield "edge", f"c#t{i}", "c", "PartOf", "annis", ""
            if i:
                yield "edge", f"c#t{i - 1}", f"c#t{i}", "Ordering", "annis", ""

    export_graphml(graph_of_events(spark, items(), "c"), str(tmp_path / "c.graphml"))
    data = str(tmp_path / "data")

    def said(*argv, code=0):
        out = io.StringIO()
        assert run([data, *argv], spark, out) == code
        return out.getvalue().strip()

    assert said("import", str(tmp_path / "c.graphml")) == "c" and said("list") == "c"
    assert said("count", "tok . tok") == "2 matches in 1 documents"
    assert said("find", 'tok="a"', "--limit", "1", "--order", "inverted") == "c#t2"
    assert said("frequency", "1:annis::tok", "tok", "-c", "c") == "a\t2\nb\t1"
    assert said("validate", "tok . tok") == "valid" and said("validate", "tok &", code=1) == "" and said("count", "tok", "-c", "none", code=1) == ""
    assert "PartOf/annis/: 3 edges" in said("info", "c")
    (tmp_path / "s").write_text("# comment\nlist\nfind 'tok=\"b\"'\n")
    assert said("script", str(tmp_path / "s")) == "c\nc#t1"
    assert said("delete", "c") == "" and said("delete", "c", code=1) == ""
