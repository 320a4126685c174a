import random
from collections import defaultdict

import pyarrow as pa
import pytest

from weftgraph.functions.values import clean, typed
from weftgraph.operators import terms, wide


def test_clean():
    got = clean(pa.array(["  á\t", "NULL", " NULL ", "", "\t", None, "null", "a b", "é"]))
    assert got.to_pylist() == ["á", None, None, None, None, None, "null", "a b", "é"]


@pytest.mark.parametrize(
    "kind,val,want",
    [
        ("integer", "+012", "12"), ("integer", "-0", "0"), ("integer", "1234567890", None), ("integer", "", None), ("integer", "1.0", None),
        ("decimal", "1,50", "1.5"), ("decimal", "+1.5", "1.5"), ("decimal", "-0.0", "0"), ("decimal", "1.", None), ("decimal", ".5", None), ("decimal", "00012345678901234567890123456789012345678901.10", "12345678901234567890123456789012345678901.1"),
        ("boolean", "Yes", "true"), ("boolean", "0", "false"), ("boolean", "2", None),
        ("date", "2020-02-29", "2020-02-29"), ("date", "29.02.2020", "2020-02-29"), ("date", "20200229", "2020-02-29"), ("date", "2021-02-29", None), ("date", "31.04.2020", None), ("date", "1900-02-29", None), ("date", "2000-02-29", "2000-02-29"),
        ("string", "anything", "anything"), (None, "x", "x"), ("integer", None, None),
    ],
)
def test_typed(kind, val, want):
    assert typed(pa.array([val], pa.string()), pa.array([kind], pa.string())).to_pylist() == [want]


KEYS = [(1, "a", "n", "integer"), (2, "a", "n", "integer"), (3, "", "s", "string"), (4, None, "d", "decimal")]


def _keys(spark):
    return spark.createDataFrame(KEYS, "anno_key int, anno_ns string, anno_name string, val_type string")


def _annos(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "node_id long, anno_key int, val string, corpus_ref long, anno_ns string").repartition(3)


def test_terms(spark):
    rows = [(i, 1, "7", i % 4) for i in range(300)] + [(i, 3, f"v{i % 50}", None if i % 2 else i) for i in range(200)] + [(1, 3, "x", 1), (1, 3, "x", 1), (2, 3, " x ", 2), (3, 9, "x", 3), (4, 3, None, 4), (5, 3, "NULL", 5), (None, 3, "x", 9), (6, 4, "", 1), (7, 2, "7", None)]
    found, keys = _annos(spark, rows), _keys(spark)
    want = defaultdict(lambda: [0, set()])
    names = {k: (ns, n) for k, ns, n, _ in KEYS}
    for _, k, v, c in set(rows):
        v = (v or "").strip(" \t ")
        if k in names and v not in ("", "NULL"):
            want[*names[k], v][0] += 1
            want[*names[k], v][1].add(c)
    plain = {k: (n, len(c - {None})) for k, (n, c) in want.items()}
    heavy = terms.heavy_terms(found, keys, max_heavy=3, share=0.1)
    assert (1, "7") in heavy
    for h in (heavy, []):  # the way a term goes doesn't change its count
        counts = terms.term_counts(found, keys, h)
        got = {(r.anno_ns, r.anno_name, r.val): (r.n_rows, r.n_records) for r in terms.banded(counts, keys).collect()}
        assert got == plain
    bands = {(r.anno_ns, r.anno_name, r.val): r.band for r in terms.banded(terms.term_counts(found, keys, heavy), keys).collect()}
    assert bands["a", "n", "7"] == "common" and bands["", "s", "x"] is None and bands["", "s", "v1"] == "rare"
    assert terms.all_terms(found.limit(0), keys).count() == 0


def test_wide(spark):
    rows = [(1, 1, "5", 1), (1, 2, "+5", 1), (1, 3, "x", 1), (2, 1, "5", 1), (2, 1, "6", 1), (3, 1, "bad", 1), (4, 1, "bad", 1), (4, 1, "7", 1), (5, 3, "NULL", 1), (6, 9, "x", 1), (7, 4, "1,50", 1), (7, 4, "1.5", 1), (None, 3, "y", 1)]
    run = wide.sorted_run(wide.deltas(_annos(spark, rows), _keys(spark)))
    assert {tuple(r) for r in wide.conflicts(run, _keys(spark)).collect()} == {(2, "a", "n"), (3, "a", "n")}
    got = {r.node_id: (r["a__n"], r["s"], r["d"]) for r in wide.widen(run, _keys(spark)).collect()}
    assert {k: (a, s, d and float(d)) for k, (a, s, d) in got.items()} == {1: (5, "x", None), 2: (None, None, None), 3: (None, None, None), 4: (7, None, None), 7: (None, None, 1.5), None: (None, "y", None)}
    few = {r.node_id: (r["d"], r.further) for r in wide.widen(run, _keys(spark), max_columns=1).collect()}
    assert {k: (d and float(d), f) for k, (d, f) in few.items()} == {1: (None, {"a__n": "5", "s": "x"}), 2: (None, None), 3: (None, None), 4: (None, {"a__n": "7"}), 7: (1.5, None), None: (None, {"s": "y"})}
    assert wide.sorted_run(wide.deltas(_annos(spark, rows).limit(0), _keys(spark))).count() == 0


def test_wide_decimals_that_do_not_fit(spark):
    rows = [(1, 4, "1" * 29, 1), (2, 4, "0,12345678901", 1), (3, 4, "1" * 28, 1)]
    run = wide.sorted_run(wide.deltas(_annos(spark, rows), _keys(spark)))
    assert {r.node_id: r.d is None for r in wide.widen(run, _keys(spark)).collect()} == {1: True, 2: True, 3: False}
    assert {tuple(r) for r in wide.unfit(run, _keys(spark)).collect()} == {(1, None, "d", "1" * 29), (2, None, "d", "0.12345678901")}


def _latest(batches):
    """Of each cell the values of the latest version that has valid ones, by plain dicts."""
    valid = {"n": lambda v: v.lstrip("+").isdigit() and str(int(v)), "s": lambda v: v, "d": lambda v: v.lstrip("+").isdigit() and v.lstrip("+")}
    cells = defaultdict(lambda: defaultdict(set))
    for version, rows in batches:
        for node, key, val, _ in rows:
            name = {1: "n", 2: "n", 3: "s", 4: "d"}[key]
            at = cells[node, name]
            if v := valid[name](val):
                at[version].add(v)
            else:
                at.setdefault(-1, set())
    last = {k: vs[max(vs)] for k, vs in cells.items()}
    return {k: v.pop() if len(v) == 1 else None for k, v in last.items()}


def _state(run, keys):
    names = {"n": 1, "s": 3, "d": 4}
    got = {(r.node_id, c.attr): None if c.lo is None or c.hi is not None else c.lo for r in run.collect() for c in r.cells}
    return {(node, name): got[node, a] for name, a in names.items() for node in {n for n, b in got if b == a}}


def test_runs_in_any_order(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    batches = [(v, [(rng.choice([None, *range(40)]), rng.choice([1, 2, 3, 4]), rng.choice(["1", "+1", "2", "bad", "3"]), 1) for _ in range(150)]) for v in (5, 7, 7, 2)]
    want = _latest(batches)
    monkeypatch.setattr(wide, "HELD_CELLS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name, order in (("a", batches), ("b", batches[::-1])):
            runs = wide.Runs(spark, str(tmp_path / name))
            for k, (version, rows) in enumerate(order):
                runs.upsert(_annos(spark, rows), _keys(spark), version)
                if k == 2 and name == "a":
                    runs.compact()
                    assert len(runs.names()) == 1
            if name == "b":
                runs.compact()
                runs.upsert(_annos(spark, order[0][1]), _keys(spark), order[0][0])
            assert _state(runs.run(), KEYS) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_entity(spark):
    rows = [(1, k, str(i % 3), 1) for i in range(3000) for k in (1, 3)] + [(i, 1, "4", 1) for i in range(2, 100)]
    run = wide.sorted_run(wide.deltas(_annos(spark, rows), _keys(spark)))
    assert sorted(r.node_id for r in run.collect()) == list(range(1, 100))
    assert {tuple(r) for r in wide.conflicts(run, _keys(spark)).collect()} == {(1, "a", "n"), (1, "", "s")}
