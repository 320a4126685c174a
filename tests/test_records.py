import pytest

from weftgraph.operators import records

NODE = "1\t0\t7\tNULL\tn\t0\t4\tNULL\t0\t1\tNULL\tNULL\tx\tTRUE"


@pytest.mark.parametrize(
    "raw,src,want",
    [
        ("1\t0\tn\tval", "text.annis", None),
        ('1\t0\tn\t"a\tb ""c"""', "text.annis", None),
        ('1\t0\tn\t"open', "text.annis", "quoting"),
        ('1\t0\tn\t"a"b', "text.annis", "quoting"),
        ('1\t0\tn\t"a" ', "text.annis", "quoting"),
        ('1\t0\tn\ta"b', "text.annis", None),
        ('1\t0\tn\t\\"b', "text.annis", None),
        ('1\t0\t"x', "text.annis", "quoting"),
        ("1\t0\tn", "text.annis", "columns"),
        ("", "text.annis", "columns"),
        (None, "text.annis", "columns"),
        ("1\t0\tn\tv", "other", "columns"),
        ("1\t0\tn\tv", None, "columns"),
        ("4294967295\t0\tn\tv", "text.annis", None),
        ("4294967296\t0\tn\tv", "text.annis", "value"),
        ("00000000001\t0\tn\tv", "text.annis", "value"),
        ("１\t0\tn\tv", "text.annis", "value"),
        ("-1\t0\tn\tv", "text.annis", "value"),
        (" 1\t0\tn\tv", "text.annis", "value"),
        ("1\t0\tNULL\tv", "text.annis", "value"),
        ('1\t0\t"NULL"\tv', "text.annis", None),
        ("1\t0\t \tv", "text.annis", "value"),
        ("1\t0\t\tv", "text.annis", "value"),
        ("1\t0\tn\tNULL", "text.annis", "value"),
        ('1\t0\tn\t"NULL"', "text.annis", None),
        ("1\t0\tn\t", "text.annis", None),
        ("1\t0\tn\ta\x7fb", "text.annis", "value"),
        ("1\t0\tn\ta\nb", "text.annis", "value"),
        ("1\t0\tn\ta\r", "text.annis", "value"),
        ('1\t0\tn\t"a\rb"c', "text.annis", "quoting"),
        ("1\t0\tn\ta�", "text.annis", "value"),
        ("1\t0\tn\t" + "x" * 300_000, "text.annis", None),
        (NODE, "node.annis", None),
        (NODE.replace("\t0\t4\t", "\t5\t4\t"), "node.annis", "value"),
        (NODE.replace("NULL\tNULL\tx", "NULL\tline\tx"), "node.annis", "value"),
        (NODE.replace("NULL\tNULL\tx", "3\tline\tx"), "node.annis", None),
        (NODE.replace("NULL\tNULL\tx", "3\t1line\tx"), "node.annis", "value"),
        (NODE.replace("NULL\tNULL\tx", "3\t\tx"), "node.annis", "value"),
        (NODE + "\t", "node.annis", "columns"),
    ],
)
def test_reason(raw, src, want):
    fields = next(records.read_records([raw]))
    assert records.construct(fields, records.LAYOUTS.get(src))[1] == want


def test_tables(spark):
    rows = [(1, "text.annis", '1\t2\t"NULL"\tv', "x"), (1, "text.annis", '1\t2\t"NULL"\tv', "x"), (2, "node.annis", NODE, "y"), (3, "node.annis", "a", "z"), (None, "text.annis", None, None)]
    df = spark.createDataFrame(rows, "line_id long, src_file string, raw string, reason string")
    parsed = records.parse_lines(df)
    assert [tuple(r) for r in records.loaded(parsed, "text.annis").collect()] == [(1, 1, 2, "NULL", "v")] * 2
    node = records.loaded(parsed, "node.annis").first()
    assert (node.node_id, node.anno_layer, node.segmentation, node.right_char) == (1, None, None, 4)
    assert sorted((r.line_id or 0, r.reason) for r in records.rejected(parsed).collect()) == [(0, "columns"), (3, "columns")]
    assert records.parse_lines(df.limit(0)).count() == 0
