"""Further forms of operators, verbs and updates, each with its SQL twin; they join the queries of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .aql.analyze import node_descriptions
from .catalog import _EVT, _PAIR, match, verb
from .plans import execute as run
from .plans import subgraph
from .plans.graph import united
from .sources.updates import EVENT_SCHEMA, apply_updates, empty_graph
from .tables import table

# Regular expressions beyond ASCII, over the cleaned values
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
for _name, _aql, _re, _not in (
    ("n4_regex_word", r"salt:lemma=/\w+/", f"{_WORD}+", ""),
    ("n4_regex_letters", r"salt:lemma=/\pL*[^\p{ASCII}]\p{Ll}+/", r"\p{L}*[^\x00-\x7F]\p{Ll}+", ""),
    ("n4_regex_dot", r"grammar:lemma=/n.x.*/", r"(?s)n[^\n]x[^\n]*", ""),
    ("n4_regex_case", r"salt:lemma=/(?i).*û.*/", r"(?i)[^\n]*û[^\n]*", ""),
    ("n4_regex_class", r"salt:lemma=/[\w--a-m]+/", r"[n-zA-Z\p{Lu}0-9_\x{80}-\x{10FFFF}]+", ""),
    ("n5_not_regex_word", r"salt:lemma!=/\p{Ll}+/", r"\p{Ll}+", "NOT "),
):
    _ns, _, _key = _aql.split("=")[0].rstrip("!").partition(":")
    match(_name, "gra", _aql, f"SELECT id AS m1 FROM a WHERE ns = '{_ns}' AND name = '{_key}' AND {_not}regexp_full_match(value, '{_re}')")
match("n8_token_regex_word", "evt", r"tok=/[\pL&&[^aeiou]]\w*/", "SELECT event_id AS m1 FROM e WHERE regexp_full_match(event_type, '[b-df-hj-np-tv-z][a-z_]*')")
match("n9_not_token_regex_digit", "evt", r"tok!=/\D*k\D*/", "SELECT event_id AS m1 FROM e WHERE NOT event_type LIKE '%k%'")
match("n10_text_regex", "evt", "/(cl|v).*/", "SELECT event_id AS m1 FROM e WHERE event_type LIKE 'cl%' OR event_type LIKE 'v%'")

# Edges
match("b2_dominance_edge_anno", "ord", 'priority="1-URGENT" >[status="F"] tok', "SELECT o.id AS m1, i.id AS m2 FROM o JOIN i ON i.oid = o.id WHERE o_orderpriority = '1-URGENT' AND l_linestatus = 'F'", "m1 m2")
match("b2_dominance_edge_anno_not", "ord", 'priority="2-HIGH" >[li:status!="F"] tok="A"', "SELECT o.id AS m1, i.id AS m2 FROM o JOIN i ON i.oid = o.id WHERE o_orderpriority = '2-HIGH' AND l_linestatus <> 'F' AND l_returnflag = 'A'", "m1 m2")
match(
    "b3_pointing_far", "evt", 'node ->next 67,75 type="error"', "SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id WHERE b.pos - a.pos BETWEEN 67 AND 75 AND b.event_type = 'error'", "m1 m2"
)
match(
    "b3_pointing_far_corpus", "evt", 'doc ->next 40,70 type="error"', "SELECT user_id + 2000000000000 AS m1, event_id AS m2 FROM e WHERE event_type = 'error' AND pos - 4 BETWEEN 40 AND 70", "m1 m2"
)
match(
    "b3_pointing_cycle_far", "evt", 'type="signup" ->round 66,80 type="purchase"',
    ", z AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) SELECT a.event_id AS m1, b.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id JOIN z ON z.user_id = a.user_id WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND (b.pos - a.pos + n) % n BETWEEN 66 AND 80",
    "m1 m2",
)
match(
    "b3_pointing_cycle_unbounded", "evt", 'type="signup" ->round * type="error"', _PAIR.format("signup", "error", "a.event_id <> b.event_id"), "m1 m2"
)
match("b3_pointing_joint_unbounded", "evt", 'doc ->next * type="signup"', "SELECT user_id + 2000000000000 AS m1, event_id AS m2 FROM e WHERE event_type = 'signup' AND pos >= 5", "m1 m2")
match(
    "b14_part_of_range", "evt", 'type="error" @1,2 annis:node_type="corpus"',
    "SELECT event_id AS m1, unnest([user_id + 2000000000000, 3000000000000]) AS m2 FROM e WHERE event_type = 'error'", "m1 m2",
)
match("b14_part_of_second", "evt", 'type="error" @2,2 annis:node_type="corpus"', "SELECT event_id AS m1, 3000000000000 AS m2 FROM e WHERE event_type = 'error'", "m1 m2")

# Segmentations
_BUY = ", p AS (SELECT user_id, event_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS k FROM e WHERE event_type = 'purchase') "
match("b5_prec_segment", "evt", 'type="purchase" .buy type="purchase"', _BUY + "SELECT a.event_id AS m1, b.event_id AS m2 FROM p a JOIN p b ON a.user_id = b.user_id AND b.k = a.k + 1", "m1 m2")
match("b5_prec_segment_range", "evt", "tok .buy,2,4 node", _BUY + "SELECT a.event_id AS m1, b.event_id AS m2 FROM p a JOIN p b ON a.user_id = b.user_id AND b.k - a.k BETWEEN 2 AND 4", "m1 m2")
match("b6_inverse", "evt", 'type="view" & type="purchase" & #2 .1,3 #1', "SELECT b.event_id AS m1, a.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN 1 AND 3 WHERE b.event_type = 'view' AND a.event_type = 'purchase'", "m1 m2")
match("b7_near_segment", "evt", 'type="purchase" ^buy,1,2 type="purchase"', _BUY + "SELECT a.event_id AS m1, b.event_id AS m2 FROM p a JOIN p b ON a.user_id = b.user_id AND abs(b.k - a.k) BETWEEN 1 AND 2", "m1 m2")

# Structure
match("l7_numbering", "evt", 'type="click" & type="view" & #2 . #1', "SELECT b.event_id AS m1, a.event_id AS m2 FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.event_type = 'view' AND b.event_type = 'click'", "m1 m2")
match("l8_quirks_extra_node", "ord", 'priority="1-URGENT" & quantity="4" & supp:name & #1 > #2 & #2 ->sup #3', "SELECT o.id AS m1, i.id AS m2, sid AS m3, i.id AS m4 FROM o JOIN i ON i.oid = o.id WHERE o_orderpriority = '1-URGENT' AND CAST(l_quantity AS INT) = 4", "m1 m2 m3 m4", quirks=True)
match("n13_part_of_component", "ord", "node ->loc node", "SELECT s_suppkey + 5000000000000000 AS m1, s_nationkey + 3000000000000000 AS m2 FROM supplier", "m1 m2")


def _found(order: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return run.find(views.events_graph(spark, d), 'type="error"', order=order)

    return f


_IDS = "SELECT 'evt' AS corpus, 'evt::type::evt/u' || user_id || '#e' || event_id AS match FROM events WHERE event_type = 'error'"
verb("r6_find_random", _IDS)(_found("random"))
verb("r7_find_unsorted", _IDS)(_found("unsorted"))


@verb("r3_find_beyond", _EVT + "SELECT corpus, match FROM (SELECT 'evt' AS corpus, 'evt::type::evt/u' || user_id || '#e' || event_id AS match, row_number() OVER (ORDER BY 'u' || user_id, user_id, pos) AS nr FROM e WHERE event_type = 'error') WHERE nr > 25")
def r3_find_beyond(spark: SparkSession, d: str) -> DataFrame:
    """All but the first rows of the order."""
    return run.find(views.events_graph(spark, d), 'type="error"', 25)


@verb(
    "r9_find_in_corpora",
    _EVT + "SELECT corpus, match FROM (SELECT 'evt' AS corpus, 'evt::type::evt/u' || user_id || '#e' || event_id AS match, 'u' || user_id AS a, pos AS b, '' AS c FROM e WHERE event_type = 'signup' UNION ALL SELECT 'ord', 'nat::name::ord#n' || n_nationkey, '', 0, 'n' || n_nationkey FROM nation) ORDER BY corpus DESC, a DESC, b DESC, c DESC LIMIT 30 OFFSET 10",
)
def r9_find_in_corpora(spark: SparkSession, d: str) -> DataFrame:
    """A page over two corpora, the last first."""
    both = united([views.events_graph(spark, d), views.orders_graph(spark, d)])
    return run.find(both, 'evt:type="signup" | nat:name', 10, 30, "inverted")


@verb("r9_count_in_corpora", "SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) AS n_matches")
def r9_count_in_corpora(spark: SparkSession, d: str) -> DataFrame:
    return run.count(united([views.events_graph(spark, d), views.orders_graph(spark, d)]), "tok")


@verb("r12_node_descriptions", "SELECT * FROM (VALUES (0, 1, 'x', false), (0, 2, '2', true), (1, 3, '3', false)) t(alternative, number, variable, optional)")
def r12_node_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(node_descriptions('x#type="view" !. tok? | sku'), "alternative int, number int, variable string, optional boolean")


@verb(
    "s3_segmentation_window",
    _EVT + _BUY + ", w AS (SELECT a.user_id, a.event_id, min(b.pos) AS first, max(b.pos) AS last FROM p a JOIN p b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 1 AND a.k + 2 GROUP BY ALL) SELECT DISTINCT user_id AS chain_id, first, last FROM w",
)
def s3_segmentation_window(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.windows(g, subgraph.matched_nodes(run.execute(g, 'type="purchase"')), 1, 2, "buy").select("chain_id", "first", "last")


@verb("s3_segmentation_context", _EVT + _BUY + ", w AS (SELECT a.user_id, a.event_id, min(b.pos) AS first, max(b.pos) AS last FROM p a JOIN p b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 1 AND a.k + 1 GROUP BY ALL) SELECT DISTINCT e.event_id AS node_id FROM e JOIN w ON w.user_id = e.user_id AND e.pos BETWEEN w.first AND w.last")
def s3_segmentation_context(spark: SparkSession, d: str) -> DataFrame:
    g = views.events_graph(spark, d)
    return subgraph.context(g, run.execute(g, 'type="purchase"'), 1, 1, "buy").node.filter(F.col("node_id") < views.SESSION).select("node_id")


_NR = "k AS (SELECT user_id AS u, event_id % 5 AS p, event_type, CAST(hour(ts) AS VARCHAR) AS h, row_number() OVER (ORDER BY ts, event_id) AS nr FROM events)"


@verb(
    "i9_updates_edges",
    f"WITH {_NR}, o AS (SELECT u, p, max(nr) FILTER (event_type = 'error') AS off FROM k GROUP BY ALL), b AS (SELECT u, p, min(nr) AS born FROM k JOIN o USING (u, p) WHERE event_type = 'view' AND nr > coalesce(off, 0) GROUP BY ALL), "
    "l AS (SELECT u, p, max_by(event_type, nr) AS t, max_by(h, nr) AS h FROM k JOIN b USING (u, p) WHERE event_type IN ('click', 'signup') AND nr > born GROUP BY ALL) "
    "SELECT 'u' || u AS source, 'p' || p AS target, CASE WHEN t = 'click' THEN h END AS value FROM b LEFT JOIN l USING (u, p)",
)
def i9_updates_edges(spark: SparkSession, d: str) -> DataFrame:
    """Views link users to products, errors unlink them; clicks label the link by their hour, signups take the label away. Purchases delete products nobody knows."""
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").withColumn("at", F.col("ts").cast("timestamp"))
    nr = (F.col("at").cast("double") * 1_000_000).cast("bigint")
    of = F.col("event_type")
    kind = F.when(of == "view", "add_edge").when(of == "error", "delete_edge").when(of == "click", "add_edge_label").when(of == "signup", "delete_edge_label").otherwise("delete_node")
    u, p = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("p"), F.col("event_id") % 5)
    gone = of == "purchase"
    edge = lambda c: F.when(~gone, c)
    label = lambda c: F.when(of.isin("click", "signup"), c)
    named = {
        "nr": nr, "kind": kind, "node": F.when(gone, F.concat(F.lit("x"), F.col("event_id"))), "node_type": F.lit(None).cast("string"), "source": edge(u), "target": edge(p), "ctype": edge(F.lit("Pointing")), "layer": edge(F.lit("evt")),
        "cname": edge(F.lit("likes")), "ns": label(F.lit("evt")), "name": label(F.lit("hour")), "value": F.when(of == "click", F.hour("at").cast("string")),
    }
    changes = ev.select(*[c.alias(k) for k, c in named.items()])
    names = ev.select(F.explode(F.array(u, p)).alias("node")).distinct()
    nodes = names.select(*[{"nr": F.lit(-(10**15)).cast("bigint"), "kind": F.lit("add_node"), "node": F.col("node"), "node_type": F.lit("node")}.get(c.split()[0], F.lit(None).cast("string")).alias(c.split()[0]) for c in EVENT_SCHEMA.split(", ")])
    g = apply_updates(empty_graph(spark), nodes.unionByName(changes), "likes")
    name = lambda end: g.node.select(F.col("node_id").alias(end), F.col("node_name").alias(f"{end}_name"))
    out = g.edge.join(g.edge_anno.select("source", "target", "value"), ["source", "target"], "left").join(name("source"), "source").join(name("target"), "target")
    return out.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "value")


@verb("i9_updates_nodes", f"WITH {_NR}, g AS (SELECT u, max(nr) FILTER (event_type = 'error') AS gone FROM k GROUP BY u), b AS (SELECT u, min(nr) AS born FROM k JOIN g USING (u) WHERE event_type <> 'error' AND nr > coalesce(gone, 0) GROUP BY u), l AS (SELECT u, max_by(h, nr) AS value FROM k JOIN b USING (u) WHERE event_type = 'click' AND nr >= born GROUP BY u) SELECT 'u' || u AS node, value FROM b LEFT JOIN l USING (u)")
def i9_updates_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Errors delete users with all that was said of them, other events add them again, clicks label those that live by their hour."""
    ev = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    nr = (F.col("at").cast("double") * 1_000_000).cast("bigint") * 2
    null = F.lit(None).cast("string")
    of = F.col("event_type")
    user = F.concat(F.lit("u"), F.col("user_id"))

    def said(df: DataFrame, at, **columns) -> DataFrame:
        return df.select(*[(at if c == "nr" else columns.get(c, null)).alias(c) for c in (x.split()[0] for x in EVENT_SCHEMA.split(", "))])

    lives = said(ev, nr, kind=F.when(of == "error", "delete_node").otherwise("add_node"), node=user, node_type=F.when(of != "error", "node"))
    labels = said(ev.filter(of == "click"), nr + 1, kind=F.lit("add_node_label"), node=user, ns=F.lit("evt"), name=F.lit("hour"), value=F.hour("at").cast("string"))
    g = apply_updates(empty_graph(spark), lives.unionByName(labels), "users")
    return g.node.join(g.anno.select("node_id", "value"), "node_id", "left").select(F.col("node_name").alias("node"), "value")


