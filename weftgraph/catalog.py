"""Queries for every operator of the query language, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .aql.model import Range
from .plans import execute as run
from .plans import index, subgraph
from .plans.reach import pairs
from .sources.updates import apply_updates, empty_graph
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_VIEWS = {"evt": views.events_graph, "ord": views.orders_graph, "gra": views.corpus_graph}

#: Events as tokens with chain and position; sessions as spans.
_EVT = """WITH e0 AS (SELECT event_id, user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
e1 AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nr FROM e0),
e AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, nr) + 1000000000000 AS sid FROM e1),
s AS (SELECT sid, user_id, min(pos) AS l, max(pos) AS r, min_by(event_id, pos) AS lt, max_by(event_id, pos) AS rt FROM e GROUP BY sid, user_id),
x AS (SELECT event_id AS id, user_id, pos AS l, pos AS r, event_id AS lt, event_id AS rt FROM e UNION ALL SELECT sid, user_id, l, r, lt, rt FROM s)
"""
#: Lineitems as tokens of their order.
_ORD = """WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem),
i AS (SELECT l_orderkey * 1000 + pos AS id, l_orderkey + 1000000000000000 AS oid, l_suppkey + 5000000000000000 AS sid, l_partkey + 6000000000000000 AS pid, * FROM li),
o AS (SELECT o_orderkey + 1000000000000000 AS id, o_custkey + 2000000000000000 AS cid, * FROM orders),
c AS (SELECT c_custkey + 2000000000000000 AS id, c_nationkey + 3000000000000000 AS nid, * FROM customer),
n AS (SELECT n_nationkey + 3000000000000000 AS id, n_regionkey + 4000000000000000 AS rid, * FROM nation),
r AS (SELECT r_regionkey + 4000000000000000 AS id, * FROM region)
"""
#: The cleaned graph of nodes, edges and node_annos.
_GRA = """WITH RECURSIVE nd AS (SELECT node_id, min(corpus_ref) AS corpus_ref, min(text_id) AS text_id, min(token_index) AS pos, min(left_token) AS l, min(right_token) AS r FROM nodes GROUP BY node_id),
a AS (SELECT node_id AS id, anno_ns AS ns, anno_name AS name, min(trim(nfc_normalize(val), ' ' || chr(9) || chr(160))) AS value FROM node_annos JOIN anno_keys USING (anno_key) WHERE trim(nfc_normalize(val), ' ' || chr(9) || chr(160)) NOT IN ('', 'NULL') GROUP BY ALL),
d AS (SELECT DISTINCT source, target FROM edges WHERE ctype = 'Dominance' AND cname = '' AND source IS NOT NULL AND target IS NOT NULL)
"""


def _spark_query(view: str, aql: str, cols: list[str], quirks: bool) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return run.execute(_VIEWS[view](spark, d), aql, quirks).select(*cols)

    return f


def match(name: str, view: str, aql: str, sql: str, cols: str = "m1", quirks: bool = False) -> None:
    QUERIES[name] = _spark_query(view, aql, cols.split(), quirks)
    SQL[name] = {"evt": _EVT, "ord": _ORD, "gra": _GRA}[view] + sql


# Node searches
match("n1_exact", "evt", 'type="view"', "SELECT event_id AS m1 FROM e WHERE event_type = 'view'")
match("n1_exact_ns", "evt", 'evt:bucket="1"', "SELECT event_id AS m1, 'evt' AS ns1 FROM e WHERE event_id % 5 = 1", "m1 ns1")
_BUCKETS = "FROM (SELECT event_id, 'evt' AS ns, CAST(event_id % 5 AS VARCHAR) AS v FROM e UNION ALL SELECT event_id, 'val', CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) FROM e WHERE value IS NOT NULL)"
match("n1_exact_any_ns", "evt", 'bucket="1"', f"SELECT event_id AS m1, ns AS ns1 {_BUCKETS} WHERE v = '1'", "m1 ns1")
match("n2_any", "evt", "bucket", f"SELECT event_id AS m1, ns AS ns1 {_BUCKETS}", "m1 ns1")
match("n3_not_exact", "evt", 'type!="view"', "SELECT event_id AS m1 FROM e WHERE event_type <> 'view'")
match("n4_regex", "evt", "type=/(v|cl).*/", "SELECT event_id AS m1 FROM e WHERE regexp_full_match(event_type, '(v|cl).*')")
match("n4_regex_literal", "evt", "type=/view/", "SELECT event_id AS m1 FROM e WHERE event_type = 'view'")
match("n5_not_regex", "evt", "type!=/(v|cl).*/", "SELECT event_id AS m1 FROM e WHERE NOT regexp_full_match(event_type, '(v|cl).*')")
match("n6_token", "evt", 'tok="error"', "SELECT event_id AS m1 FROM e WHERE event_type = 'error'")
match("n7_not_token", "evt", 'tok!="error"', "SELECT event_id AS m1 FROM e WHERE event_type <> 'error'")
match("n8_token_regex", "evt", "tok=/.*i.*/", "SELECT event_id AS m1 FROM e WHERE event_type LIKE '%i%'")
match("n9_not_token_regex", "evt", "tok!=/.*i.*/", "SELECT event_id AS m1 FROM e WHERE event_type NOT LIKE '%i%'")
match("n10_text", "evt", '"click"', "SELECT event_id AS m1 FROM e WHERE event_type = 'click'")
match("n11_tokens", "evt", "tok", "SELECT event_id AS m1 FROM e")
match("n12_nodes", "evt", "node", "SELECT id AS m1 FROM x")
match("n14_legacy_meta", "evt", 'type="view" & meta::doc="u7"', "SELECT event_id AS m1 FROM e WHERE event_type = 'view' AND user_id = 7", quirks=True)

# Edges
match("b1_dominance_direct", "ord", 'priority="1-URGENT" > tok="R"', "SELECT o.id AS m1, i.id AS m2 FROM o JOIN i ON i.oid = o.id WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'", "m1 m2")
match("b1_dominance_range", "ord", 'segment="BUILDING" >1,2 status="F"', "SELECT c.id AS m1, o.id AS m2 FROM c JOIN o ON o.cid = c.id WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' UNION ALL SELECT c.id, i.id FROM c JOIN o ON o.cid = c.id JOIN i ON i.oid = o.id WHERE c_mktsegment = 'BUILDING' AND l_linestatus = 'F'", "m1 m2")
match("b1_dominance_unbounded", "ord", 'reg:name="ASIA" >* quantity="10"', "SELECT r.id AS m1, i.id AS m2 FROM r JOIN n ON n.rid = r.id JOIN c ON c.nid = n.id JOIN o ON o.cid = c.id JOIN i ON i.oid = o.id WHERE r_name = 'ASIA' AND CAST(l_quantity AS INT) = 10", "m1 m2")
match("b1_dominance_corpus", "gra", 'cat="NP" >* pos="NN"', ", t AS (SELECT source, target, [source, target] AS p FROM d WHERE source <> target UNION ALL SELECT t.source, d.target, list_append(t.p, d.target) FROM t JOIN d ON d.source = t.target WHERE NOT list_contains(t.p, d.target)) SELECT DISTINCT t.source AS m1, t.target AS m2 FROM t JOIN a x ON x.id = t.source AND x.name = 'cat' AND x.value = 'NP' JOIN a y ON y.id = t.target AND y.name = 'pos' AND y.value = 'NN'", "m1 m2")
match("b1_dominance_corpus_direct", "gra", 'cat="S" > cat="NP"', "SELECT source AS m1, target AS m2 FROM d JOIN a x ON x.id = source AND x.name = 'cat' AND x.value = 'S' JOIN a y ON y.id = target AND y.name = 'cat' AND y.value = 'NP'", "m1 m2")
match("b3_pointing", "ord", "quantity=\"7\" ->part size=\"15\"", "SELECT i.id AS m1, pid AS m2 FROM i JOIN part ON p_partkey = l_partkey WHERE CAST(l_quantity AS INT) = 7 AND p_size = 15", "m1 m2")
match("b3_pointing_chain", "ord", 'quantity="3" ->sup supp:name ->loc nat:name=/.*A.*/', "SELECT i.id AS m1, sid AS m2, n.id AS m3 FROM i JOIN supplier ON s_suppkey = l_suppkey JOIN n ON n_nationkey = s_nationkey WHERE CAST(l_quantity AS INT) = 3 AND n_name LIKE '%A%'", "m1 m2 m3")
match("b3_pointing_range", "gra", "node ->anaphoric 1,3 node", ", p AS (SELECT DISTINCT source, target FROM edges WHERE ctype = 'Pointing' AND cname = 'anaphoric' AND source IS NOT NULL AND target IS NOT NULL), t AS (SELECT source, target, [source, target] AS p FROM p WHERE source <> target UNION ALL SELECT t.source, p.target, list_append(t.p, p.target) FROM t JOIN p ON p.source = t.target WHERE len(t.p) < 4 AND NOT list_contains(t.p, p.target)) SELECT DISTINCT source AS m1, target AS m2 FROM t WHERE source IN (SELECT node_id FROM nd) AND target IN (SELECT node_id FROM nd)", "m1 m2")
match("b4_pointing_edge_anno", "ord", 'tok ->sup[flag="R"] supp:name', "SELECT i.id AS m1, sid AS m2 FROM i WHERE l_returnflag = 'R'", "m1 m2")
match("b4_pointing_edge_anno_regex", "ord", "quantity=\"1\" ->sup[li:flag!=/(R|N)/] supp:name", "SELECT i.id AS m1, sid AS m2 FROM i WHERE l_returnflag NOT IN ('R', 'N') AND CAST(l_quantity AS INT) = 1", "m1 m2")
match("b14_part_of", "evt", 'type="error" @ doc="u7"', "SELECT event_id AS m1, user_id + 2000000000000 AS m2 FROM e WHERE event_type = 'error' AND user_id = 7", "m1 m2")
match("b14_part_of_star", "evt", 'type="error" @* annis:node_name="evt"', "SELECT event_id AS m1, 3000000000000 AS m2 FROM e WHERE event_type = 'error'", "m1 m2")

# Positions
_PAIR = "SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = '{}' AND b.event_type = '{}' AND {}"
match("b5_prec_direct", "evt", 'type="view" . type="purchase"', _PAIR.format("view", "purchase", "b.pos = a.pos + 1"), "m1 m2")
match("b5_prec_range", "evt", 'type="view" .2,5 type="purchase"', _PAIR.format("view", "purchase", "b.pos - a.pos BETWEEN 2 AND 5"), "m1 m2")
match("b5_prec_wide", "evt", 'type="view" .3,80 type="error"', _PAIR.format("view", "error", "b.pos - a.pos BETWEEN 3 AND 80"), "m1 m2")
match("b5_prec_unbounded", "evt", 'type="error" .* type="purchase"', _PAIR.format("error", "purchase", "b.pos > a.pos"), "m1 m2")
match("b5_prec_spans", "evt", 'session . type="error"', "SELECT sid AS m1, event_id AS m2 FROM s JOIN e USING (user_id) WHERE event_type = 'error' AND pos = r + 1".replace("sid AS", "s.sid AS"), "m1 m2")
match("b7_near", "evt", 'type="view" ^ type="click"', _PAIR.format("view", "click", "abs(b.pos - a.pos) = 1"), "m1 m2")
match("b7_near_range", "evt", 'type="view" ^2,4 type="click"', _PAIR.format("view", "click", "abs(b.pos - a.pos) BETWEEN 2 AND 4"), "m1 m2")
match("b7_near_unbounded", "evt", 'type="signup" ^* type="error"', _PAIR.format("signup", "error", "b.pos <> a.pos"), "m1 m2")
match("b8_overlap", "evt", 'session _o_ type="error"', "SELECT sid AS m1, event_id AS m2 FROM e WHERE event_type = 'error'", "m1 m2")
match("b9_inclusion", "evt", 'session _i_ type="error"', "SELECT sid AS m1, event_id AS m2 FROM e WHERE event_type = 'error'", "m1 m2")
match("b9_inclusion_corpus", "gra", 'cat="NP" _i_ pos="NN"', "SELECT x.id AS m1, y.id AS m2 FROM a x JOIN nd u ON u.node_id = x.id JOIN a y ON y.name = 'pos' AND y.value = 'NN' JOIN nd v ON v.node_id = y.id AND v.corpus_ref = u.corpus_ref AND v.text_id = u.text_id WHERE x.name = 'cat' AND x.value = 'NP' AND coalesce(u.pos, u.l) <= coalesce(v.pos, v.l) AND coalesce(v.pos, v.r) <= coalesce(u.pos, u.r)", "m1 m2")
match("b10_identcov", "evt", "session _=_ tok", "SELECT s.sid AS m1, event_id AS m2 FROM s JOIN e ON lt = event_id AND rt = event_id", "m1 m2")
match("b11_left", "evt", 'session _l_ type="view"', "SELECT s.sid AS m1, event_id AS m2 FROM s JOIN e ON lt = event_id WHERE event_type = 'view'", "m1 m2")
match("b12_right", "evt", 'session _r_ type="view"', "SELECT s.sid AS m1, event_id AS m2 FROM s JOIN e ON rt = event_id WHERE event_type = 'view'", "m1 m2")
match("b13_ident", "evt", 'type="view" _ident_ evt:bucket="2"', "SELECT event_id AS m1, event_id AS m2 FROM e WHERE event_type = 'view' AND event_id % 5 = 2", "m1 m2")
match("b8_not_itself", "evt", 'type _=_ type', "SELECT event_id AS m1, event_id AS m2 FROM e WHERE false", "m1 m2")
match("b8_other_key", "evt", 'type="view" _=_ evt:bucket', "SELECT event_id AS m1, event_id AS m2 FROM e WHERE event_type = 'view'", "m1 m2")

# Values, negation, arity
match("b15_equal", "evt", "evt:type & evt:type & #1 .3 #2 & #1 == #2", "SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 3 AND a.event_type = b.event_type", "m1 m2")
match("b16_not_equal", "evt", "tok & tok & #1 .2 #2 & #1 != #2", "SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 2 AND a.event_type <> b.event_type", "m1 m2")
match("b17_negated", "evt", 'type="view" .1,4 type="click" & #1 !.2,3 #2', _PAIR.format("view", "click", "b.pos - a.pos IN (1, 4)"), "m1 m2")
match("b17_negated_edge", "ord", 'quantity="50" & part:brand & #1 ->part #2 & supp:name & #1 ->sup #3 & #1 !->sup[flag="R"] #3', "SELECT i.id AS m1, pid AS m2, sid AS m3 FROM i WHERE CAST(l_quantity AS INT) = 50 AND l_returnflag <> 'R'", "m1 m2 m3")
match("b18_optional", "evt", 'type="error" !. type="view"?', "SELECT event_id AS m1 FROM e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.pos = e.pos + 1 AND b.event_type = 'view')")
match("b18_optional_left", "evt", 'type="view"? !.1,3 type="error"', "SELECT event_id AS m1 FROM e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND e.pos - b.pos BETWEEN 1 AND 3 AND b.event_type = 'view')")
match("b18_optional_dominance", "ord", "ord:status !> tok?", "SELECT id AS m1 FROM o WHERE id NOT IN (SELECT oid FROM i)")
match("u1_arity", "ord", "priority & #1:arity=3,4", "SELECT o.id AS m1 FROM o JOIN i ON i.oid = o.id GROUP BY o.id HAVING count(*) BETWEEN 3 AND 4")
match("u1_arity_any", "ord", "priority & #1:arity=*", "SELECT DISTINCT oid AS m1 FROM i")

# Structure
match("l1_three_nodes", "evt", 'session & type="view" & type="purchase" & #1 _i_ #2 & #1 _i_ #3 & #2 . #3', "SELECT a.sid AS m1, a.event_id AS m2, b.event_id AS m3 FROM e a JOIN e b ON a.sid = b.sid AND b.pos = a.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'purchase'", "m1 m2 m3")
match("l2_or_dedup", "evt", '(type="view" . type="click") | (evt:type=/v.*/ . evt:type="click")', _PAIR.format("view", "click", "b.pos = a.pos + 1"), "m1 m2")
match("l2_or_widths", "evt", 'type="signup" . type="error" | type="error"', "SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'signup' AND b.event_type = 'error' UNION ALL SELECT event_id, NULL FROM e WHERE event_type = 'error'", "m1 m2")
match("l4_variables", "evt", 'v#type="view" & c#type="click" & #v . #c', _PAIR.format("view", "click", "b.pos = a.pos + 1"), "m1 m2")
match("l5_chain3", "evt", 'type="view" . type="click" . type="view"', "SELECT a.event_id AS m1, b.event_id AS m2, c.event_id AS m3 FROM e a JOIN e b ON b.user_id = a.user_id AND b.pos = a.pos + 1 JOIN e c ON c.user_id = a.user_id AND c.pos = b.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'view'", "m1 m2 m3")
match("l8_quirks_distance", "evt", 'type="error" .* type="purchase"', _PAIR.format("error", "purchase", "b.pos - a.pos BETWEEN 1 AND 50"), "m1 m2", quirks=True)


def verb(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@verb("r1_count", _EVT + "SELECT count(*) AS n_matches FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def r1_count(spark: SparkSession, d: str) -> DataFrame:
    return run.count(views.events_graph(spark, d), 'type="view" . type="purchase"')


@verb("r2_count_extra", _EVT + "SELECT count(*) AS n_matches, count(DISTINCT a.user_id) AS n_documents FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def r2_count_extra(spark: SparkSession, d: str) -> DataFrame:
    return run.count_extra(views.events_graph(spark, d), 'type="view" . type="purchase"')


_FOUND = (
    _EVT
    + """, f AS (SELECT a.user_id, a.pos, 'evt::type::evt/u' || a.user_id || '#e' || a.event_id || ' evt::type::evt/u' || b.user_id || '#e' || b.event_id AS match FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'purchase')
SELECT 'evt' AS corpus, match FROM f ORDER BY 'u' || user_id {0}, user_id {0}, pos {0} LIMIT 20 OFFSET 10"""
)


@verb("r3_find_page", _FOUND.format("ASC"))
def r3_find_page(spark: SparkSession, d: str) -> DataFrame:
    return run.find(views.events_graph(spark, d), 'type="view" . type="purchase"', 10, 20)


@verb("r5_find_inverted", _FOUND.format("DESC"))
def r5_find_inverted(spark: SparkSession, d: str) -> DataFrame:
    return run.find(views.events_graph(spark, d), 'type="view" . type="purchase"', 10, 20, "inverted")


@verb("r10_frequency", _EVT + "SELECT CAST(hour(a.ts) AS VARCHAR) AS value1, b.event_type AS value2, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'view' GROUP BY ALL")
def r10_frequency(spark: SparkSession, d: str) -> DataFrame:
    return run.frequency(views.events_graph(spark, d), 'type="view" . tok', [(1, "evt", "hour"), (2, None, "tok")])


@verb("r10_frequency_missing", _EVT + "SELECT coalesce(CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR), '') AS value1, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY ALL")
def r10_frequency_missing(spark: SparkSession, d: str) -> DataFrame:
    return run.frequency(views.events_graph(spark, d), 'type="error"', [(1, "val", "bucket")])


@verb("s1_context_window", _EVT + "SELECT DISTINCT b.event_id AS node_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 3 WHERE a.event_type = 'error' UNION SELECT b.sid FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 3 WHERE a.event_type = 'error' UNION SELECT user_id + 2000000000000 FROM e WHERE event_type = 'error' UNION SELECT 3000000000000")
def s1_context_window(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.context(g, run.execute(g, 'type="error"'), 2, 3).node.select("node_id")


@verb("s4_gaps", _EVT + ", w AS (SELECT DISTINCT b.user_id, b.pos, b.event_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 1 AND a.pos + 1 WHERE a.event_type = 'error'), v AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS p, lag(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS q FROM w) SELECT q AS source, event_id AS target FROM v WHERE pos - p > 1")
def s4_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.context(g, run.execute(g, 'type="error"'), 1, 1).edge.filter("cname = 'datasource-gap'").select("source", "target")


@verb("s5_subgraph_for_query", _EVT + "SELECT DISTINCT unnest([sid, event_id]) AS node_id FROM e WHERE event_type = 'error'")
def s5_subgraph_for_query(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.for_query(g, 'session _i_ type="error"').node.select("node_id")


@verb("s6_subcorpus_graph", _EVT + "SELECT event_id AS node_id FROM e WHERE user_id IN (7, 9) UNION SELECT sid FROM e WHERE user_id IN (7, 9)")
def s6_subcorpus_graph(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.subcorpus(views.events_graph(spark, d), ["evt/u7", "evt/u9"]).node.filter("node_type = 'node'").select("node_id")


@verb("s7_corpus_graph", "SELECT DISTINCT user_id + 2000000000000 AS source, 3000000000000 AS target FROM events")
def s7_corpus_graph(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.corpora(views.events_graph(spark, d)).edge.select("source", "target")


@verb("s8_anno_values", "SELECT 'evt' AS ns, 'type' AS name, event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def s8_anno_values(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.node_values(views.events_graph(spark, d)).filter("ns = 'evt' and name = 'type'")


@verb("s8_most_frequent", "SELECT ns, name, value FROM (SELECT 'ord' AS ns, 'status' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, value LIMIT 1) UNION ALL SELECT * FROM (SELECT 'ord', 'priority', o_orderpriority, FROM orders GROUP BY ALL ORDER BY count(*) DESC, o_orderpriority LIMIT 1)")
def s8_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.node_values(views.orders_graph(spark, d), only_most_frequent=True).filter("ns = 'ord'").select("ns", "name", "value")


@verb("s8_components", "SELECT ctype, anno_layer AS layer, cname, count(DISTINCT (source, target)) AS n_edges FROM edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def s8_components(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.components(views.corpus_graph(spark, d)).select("ctype", "layer", "cname", "n_edges")


@verb("reach_partof", "SELECT DISTINCT event_id AS source, unnest([user_id + 2000000000000, 3000000000000]) AS target FROM events")
def reach_partof(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    found = pairs(g.component("PartOf"), Range(1, None))
    return found.filter(F.col("source") < views.SESSION).select("source", "target")


@verb("s2_clipped_window", _EVT + ", z AS (SELECT user_id, max(pos) AS high FROM e GROUP BY user_id) SELECT DISTINCT user_id AS chain_id, greatest(pos - 3, 0) AS first, least(pos + 3, high) AS last FROM e JOIN z USING (user_id) WHERE event_type = 'signup'")
def s2_clipped_window(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.windows(g, subgraph.matched_nodes(run.execute(g, 'type="signup"')), 3, 3).select("chain_id", "first", "last")


@verb("s8_edge_values", "SELECT 'li' AS ns, 'flag' AS name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def s8_edge_values(spark: SparkSession, d: str) -> DataFrame:
    return subgraph.edge_values(views.orders_graph(spark, d), "Pointing", "tpch", "sup")


@verb("i4_chain_positions", _EVT + "SELECT event_id AS node_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS chain_id, pos FROM e")
def i4_chain_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions from nothing but ordering edges."""
    return index.chains(views.events_graph(spark, d)).select("node_id", "chain_id", "pos")


@verb("i10_inherited_coverage", _ORD + "SELECT i.id AS node_id, i.id AS tok_id FROM i UNION ALL SELECT o.id, i.id FROM o JOIN i ON i.oid = o.id UNION ALL SELECT c.id, i.id FROM c JOIN o ON o.cid = c.id JOIN i ON i.oid = o.id UNION ALL SELECT n.id, i.id FROM n JOIN c ON c.nid = n.id JOIN o ON o.cid = c.id JOIN i ON i.oid = o.id UNION ALL SELECT r.id, i.id FROM r JOIN n ON n.rid = r.id JOIN c ON c.nid = n.id JOIN o ON o.cid = c.id JOIN i ON i.oid = o.id")
def i10_inherited_coverage(spark: SparkSession, d: str) -> DataFrame:
    return index.coverage(views.orders_graph(spark, d)).select("node_id", "tok_id")


@verb("i9_updates", "WITH k AS (SELECT user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS nr FROM events), l AS (SELECT user_id, max_by(event_type, nr) FILTER (event_type <> 'signup') AS value FROM k GROUP BY user_id) SELECT 'u' || user_id AS node, value FROM l WHERE value <> 'error'")
def i9_updates(spark: SparkSession, d: str) -> DataFrame:
    """Users as nodes whose label follows their events: an error takes it away, a signup adds the node again and changes nothing."""
    ev = table(spark, d, "events")
    nr = (F.col("ts").cast("timestamp").cast("double") * 1_000_000).cast("bigint")
    text = [F.lit(None).cast("string").alias(c) for c in ("source", "target", "ctype", "layer", "cname")]
    node = F.concat(F.lit("u"), F.col("user_id")).alias("node")
    users = ev.select("user_id").distinct().select(F.lit(-10).cast("bigint").alias("nr"), F.lit("add_node").alias("kind"), node, F.lit("node").alias("node_type"), *text, *[F.lit(None).cast("string").alias(c) for c in ("ns", "name", "value")])
    gone = F.col("event_type") == "error"
    again = F.col("event_type") == "signup"
    labels = ev.select(nr.alias("nr"), F.when(again, "add_node").when(gone, "delete_node_label").otherwise("add_node_label").alias("kind"), node, F.lit(None).cast("string").alias("node_type"), *text, F.lit("evt").alias("ns"), F.lit("last").alias("name"), F.when(~gone, F.col("event_type")).alias("value"))
    g = apply_updates(empty_graph(spark), users.unionByName(labels), "users")
    return g.anno.join(g.node, ["corpus", "node_id"]).select(F.col("node_name").alias("node"), "value")
