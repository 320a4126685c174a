"""Annotation graphs over the driver's tables.

``events``: every event is a token of its user's chain, in order of time;
sessions (no gap over 30 minutes) are spans; users are documents. Purchases
are the segmentation "buy". Events point to the next ("next", to which users
point too, and "round", closed to a cycle).
``orders``: every lineitem is a token of its order's chain and order; regions
dominate nations, customers, orders and lineitems; lineitems point to
suppliers and parts.
``corpus``: the tables nodes, edges, corpora and node_annos, cleaned of
repetitions; tokens stand in the chain of their text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions.skew import lookup_join
from .functions.values import cleaned
from .plans.graph import ANNIS, SCHEMAS, Graph
from .session import intact, stored
from .tables import table

#: Numbers of other kinds of nodes begin here.
SESSION, USER, ROOT = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000
ORDER, CUSTOMER, NATION, REGION, SUPPLIER, PART, CORPUS = (k * 1_000_000_000_000_000 for k in range(1, 8))


def _labels(df: DataFrame, corpus: str, node: Column, *labels: tuple[str, str, Column]) -> DataFrame:
    """The labels of each row, one projection for each key: a search by name then reads only its own columns, and its condition reaches the scan."""
    return _all(*[df.select(F.lit(corpus).alias("corpus"), node.cast("bigint").alias("node_id"), F.lit(ns).alias("ns"), F.lit(name).alias("name"), value.cast("string").alias("value")).filter("value is not null") for ns, name, value in labels])


def _edges(df: DataFrame, corpus: str, ctype: str, layer: str, cname: str, source: Column, target: Column, *more: str) -> DataFrame:
    lit = [F.lit(v).alias(n) for n, v in zip(("corpus", "ctype", "layer", "cname"), (corpus, ctype, layer, cname))]
    return df.select(*lit, source.cast("bigint").alias("source"), target.cast("bigint").alias("target"), *more)


def _nodes(df: DataFrame, corpus: str, node: Column, name: Column, kind: str = "node") -> DataFrame:
    return df.select(F.lit(corpus).alias("corpus"), node.cast("bigint").alias("node_id"), name.alias("node_name"), F.lit(kind).alias("node_type"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS[name]))


_graphs: dict[tuple, Graph] = {}


def _kept(make: Callable[[SparkSession, str], Graph]) -> Callable[[SparkSession, str], Graph]:
    """One graph for each session and directory, made again if someone took its stored tables away."""

    def view(spark: SparkSession, d: str) -> Graph:
        key = (make, spark, d)
        if not intact(spark):
            for k in [k for k in _graphs if k[1] is spark]:
                del _graphs[k]
        if key not in _graphs:
            _graphs[key] = make(spark, d)
        return _graphs[key]

    return view


def _self_spans(chain: DataFrame) -> DataFrame:
    """Spans of tokens, which begin and end with themselves."""
    return chain.select("corpus", "node_id", F.lit(True).alias("is_token"), "chain_id", F.col("pos").alias("left_pos"), F.col("pos").alias("right_pos"), F.col("node_id").alias("left_tok"), F.col("node_id").alias("right_tok"))


def _wide_spans(members: DataFrame) -> DataFrame:
    """Spans from (corpus, node_id, chain_id, pos, tok_id): the first and last token of the first chain."""
    first, last = F.min(F.struct("chain_id", "pos", "tok_id")).alias("a"), F.max(F.struct("pos", "tok_id")).alias("b")
    on = members.groupBy("corpus", "node_id", "chain_id").agg(first, last)
    one = on.groupBy("corpus", "node_id").agg(F.min("chain_id").alias("chain_id"), F.min_by("a", "chain_id").alias("a"), F.min_by("b", "chain_id").alias("b"))
    return one.select("corpus", "node_id", F.lit(False).alias("is_token"), "chain_id", F.col("a.pos").alias("left_pos"), F.col("b.pos").alias("right_pos"), F.col("a.tok_id").alias("left_tok"), F.col("b.tok_id").alias("right_tok"))


@_kept
def events_graph(spark: SparkSession, d: str) -> Graph:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(by_time).cast("timestamp").cast("double")
    new = F.when(gap.isNull() | (gap > 1800), 1).otherwise(0)
    seq = ev.withColumn("pos", (F.row_number().over(by_time) - 1).cast("bigint")).withColumn("new", new).withColumn("session", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("event_id").over(Window.partitionBy("user_id", "session"))
    seq = seq.withColumn("session_id", (first + SESSION).cast("bigint"))
    before = F.lag("event_id").over(by_time)
    last = F.when(F.col("pos") == 0, F.last("event_id").over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seq = stored(seq.select("event_id", "user_id", "pos", "session_id", before.alias("before"), last.alias("last")))
    users = ev.select("user_id").distinct()
    c = "evt"
    user = F.col("user_id") + USER
    node = _all(
        _nodes(ev, c, F.col("event_id"), F.concat(F.lit("evt/u"), F.col("user_id"), F.lit("#e"), F.col("event_id"))),
        _nodes(seq.select("session_id", "user_id").distinct(), c, F.col("session_id"), F.concat(F.lit("evt/u"), F.col("user_id"), F.lit("#s"), F.col("session_id"))),
        _nodes(users, c, user, F.concat(F.lit("evt/u"), F.col("user_id")), "corpus"),
        _nodes(spark.range(1), c, F.lit(ROOT), F.lit("evt"), "corpus"),
    )
    anno = _all(
        _labels(
            ev, c, F.col("event_id"), (ANNIS, "tok", F.col("event_type")), ("evt", "type", F.col("event_type")), ("evt", "hour", F.hour("ts")), ("val", "bucket", F.floor(F.col("value") / 50).cast("bigint")), ("evt", "bucket", (F.col("event_id") % 5))
        ),
        _labels(seq.select("session_id").distinct(), c, F.col("session_id"), ("evt", "session", F.lit("yes"))),
        _labels(users, c, user, (ANNIS, "doc", F.concat(F.lit("u"), F.col("user_id")))),
    )
    edge = _all(
        _edges(seq.filter("before is not null"), c, "Ordering", ANNIS, "", F.col("before"), F.col("event_id")),
        _edges(seq, c, "Coverage", ANNIS, "", F.col("session_id"), F.col("event_id")),
        _edges(seq.filter("before is not null"), c, "Pointing", "evt", "next", F.col("before"), F.col("event_id")),
        _edges(seq.filter("pos = 5"), c, "Pointing", "evt", "next", user, F.col("event_id")),
        _edges(seq, c, "Pointing", "evt", "round", F.coalesce("before", "last"), F.col("event_id")),
        _edges(ev, c, "PartOf", ANNIS, "", F.col("event_id"), user),
        _edges(seq.select("session_id", "user_id").distinct(), c, "PartOf", ANNIS, "", F.col("session_id"), user),
        _edges(users, c, "PartOf", ANNIS, "", user, F.lit(ROOT)),
    )

    def chain() -> DataFrame:
        return seq.select(F.lit(c).alias("corpus"), F.lit("").alias("seg"), F.col("user_id").alias("chain_id"), "pos", F.col("event_id").alias("node_id"))

    def chains() -> DataFrame:
        bought = ev.filter("event_type = 'purchase'").withColumn("pos", (F.row_number().over(by_time) - 1).cast("bigint"))
        return chain().unionByName(bought.select(F.lit(c).alias("corpus"), F.lit("buy").alias("seg"), F.col("user_id").alias("chain_id"), "pos", F.col("event_id").alias("node_id")))

    def spans() -> DataFrame:
        members = seq.select(F.lit(c).alias("corpus"), F.col("session_id").alias("node_id"), F.col("user_id").alias("chain_id"), "pos", F.col("event_id").alias("tok_id"))
        return _self_spans(chain()).unionByName(stored(_wide_spans(members)))

    def coverage() -> DataFrame:
        own = ev.select(F.lit(c).alias("corpus"), F.col("event_id").alias("node_id"), F.col("event_id").alias("tok_id"))
        return own.unionByName(seq.select(F.lit(c).alias("corpus"), F.col("session_id").alias("node_id"), F.col("event_id").alias("tok_id")))

    return Graph(node, anno, edge, _empty(spark, "edge_anno"), {"tok_pos": chains, "span": spans, "coverage": coverage}, {"PartOf": 2}, False, True)


@_kept
def orders_graph(spark: SparkSession, d: str) -> Graph:
    li, orders, customer, nation, region, supplier, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part"))
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", (F.row_number().over(by_line) - 1).cast("bigint").alias("pos")).withColumn("item", F.col("l_orderkey") * 1000 + F.col("pos"))
    li = stored(li)
    order, cust, nat, reg, supp, prt = F.col("o_orderkey") + ORDER, F.col("c_custkey") + CUSTOMER, F.col("n_nationkey").cast("bigint") + NATION, F.col("r_regionkey").cast("bigint") + REGION, F.col("s_suppkey") + SUPPLIER, F.col("p_partkey") + PART
    c, item = "ord", F.col("item")
    node = _all(
        *[_nodes(df, c, key, F.concat(F.lit(f"ord#{letter}"), name.cast("string"))) for df, key, letter, name in ((li, item, "l", item), (orders, order, "o", F.col("o_orderkey")), (customer, cust, "c", F.col("c_custkey")), (nation, nat, "n", F.col("n_nationkey")), (region, reg, "r", F.col("r_regionkey")), (supplier, supp, "s", F.col("s_suppkey")), (part, prt, "p", F.col("p_partkey")))]
    )
    anno = _all(
        _labels(li, c, item, (ANNIS, "tok", F.col("l_returnflag")), ("li", "status", F.col("l_linestatus")), ("li", "quantity", F.col("l_quantity").cast("int"))),
        _labels(orders, c, order, ("ord", "status", F.col("o_orderstatus")), ("ord", "priority", F.col("o_orderpriority"))),
        _labels(customer, c, cust, ("cust", "segment", F.col("c_mktsegment"))),
        _labels(nation, c, nat, ("nat", "name", F.col("n_name"))),
        _labels(region, c, reg, ("reg", "name", F.col("r_name"))),
        _labels(supplier, c, supp, ("supp", "name", F.col("s_name"))),
        _labels(part, c, prt, ("part", "brand", F.col("p_brand")), ("part", "size", F.col("p_size"))),
    )
    line_order = F.col("l_orderkey") + ORDER
    dom = partial(_edges, corpus=c, ctype="Dominance", layer="tpch", cname="")
    edge = _all(
        dom(nation, source=F.col("n_regionkey").cast("bigint") + REGION, target=nat),
        dom(customer, source=F.col("c_nationkey").cast("bigint") + NATION, target=cust),
        dom(orders, source=F.col("o_custkey") + CUSTOMER, target=order),
        dom(li, source=line_order, target=item),
        _edges(li, c, "Coverage", "tpch", "", line_order, item),
        _edges(li, c, "Pointing", "tpch", "sup", item, F.col("l_suppkey") + SUPPLIER),
        _edges(li, c, "Pointing", "tpch", "part", item, F.col("l_partkey") + PART),
        _edges(supplier, c, "Pointing", "tpch", "loc", supp, F.col("s_nationkey").cast("bigint") + NATION),
    )
    labelled = lambda e, name, value: e.withColumns({"ns": F.lit("li"), "name": F.lit(name), "value": F.col(value)}).drop(value)
    edge_anno = _all(
        labelled(_edges(li, c, "Pointing", "tpch", "sup", item, F.col("l_suppkey") + SUPPLIER, "l_returnflag"), "flag", "l_returnflag"),
        labelled(_edges(li, c, "Dominance", "tpch", "", line_order, item, "l_linestatus"), "status", "l_linestatus"),
    )

    def chain() -> DataFrame:
        return li.select(F.lit(c).alias("corpus"), F.lit("").alias("seg"), F.col("l_orderkey").alias("chain_id"), "pos", item.alias("node_id"))

    def spans() -> DataFrame:
        members = li.select(F.lit(c).alias("corpus"), line_order.alias("node_id"), F.col("l_orderkey").alias("chain_id"), "pos", item.alias("tok_id"))
        return _self_spans(chain()).unionByName(stored(_wide_spans(members)))

    def coverage() -> DataFrame:
        return li.select(F.lit(c).alias("corpus"), item.alias("node_id"), item.alias("tok_id")).unionByName(li.select(F.lit(c).alias("corpus"), line_order.alias("node_id"), item.alias("tok_id")))

    return Graph(node, anno, edge, edge_anno, {"tok_pos": chain, "span": spans, "coverage": coverage}, {"Dominance": 4}, False, True)


@_kept
def corpus_graph(spark: SparkSession, d: str) -> Graph:
    nodes, edges, annos, keys, corpora = (table(spark, d, t) for t in ("nodes", "edges", "node_annos", "anno_keys", "corpora"))
    own = nodes.groupBy("node_id").agg(*[F.min(c).alias(c) for c in ("corpus_ref", "text_id", "node_name", "token_index", "left_token", "right_token", "span_text")])
    own = stored(own)
    c = "gra"
    placed = own.filter("corpus_ref is not null and text_id is not null")
    chain_id = (F.col("corpus_ref") * 100_000 + F.col("text_id")).cast("bigint")
    toks = placed.filter("token_index is not null")
    node = _nodes(own, c, F.col("node_id"), F.concat(F.lit("gra/"), F.coalesce(F.col("corpus_ref").cast("string"), F.lit("")), F.lit("#"), F.coalesce("node_name", F.lit("")), F.lit("_"), F.col("node_id")))
    top = corpora.select((F.col("corpus_id") + CORPUS).alias("id")).filter("id is not null").distinct()
    node = node.unionByName(_nodes(top, c, F.col("id"), F.concat(F.lit("gra/c"), F.col("id") - CORPUS), "corpus"))
    named = lookup_join(annos.select("node_id", "anno_key", "val"), keys.select("anno_key", F.col("anno_ns").alias("ns"), F.col("anno_name").alias("name")), ["anno_key"])
    labels = cleaned(named.select("node_id", "ns", "name", F.col("val").alias("value")), "value").filter("value is not null").groupBy("node_id", "ns", "name").agg(F.min("value").alias("value"))
    labels = stored(labels)
    anno = labels.select(F.lit(c).alias("corpus"), "node_id", "ns", "name", "value").unionByName(_labels(own.filter("token_index is not null"), c, F.col("node_id"), (ANNIS, "tok", F.col("span_text"))))
    offset = F.when(F.col("ctype") == "PartOf", F.lit(CORPUS)).otherwise(0)
    real = edges.filter("source is not null and target is not null")
    edge = real.select(F.lit(c).alias("corpus"), "ctype", F.col("anno_layer").alias("layer"), "cname", (F.col("source") + offset).alias("source"), (F.col("target") + offset).alias("target")).dropDuplicates()
    edge = stored(edge)

    def chain() -> DataFrame:
        return toks.select(F.lit(c).alias("corpus"), F.lit("").alias("seg"), chain_id.alias("chain_id"), F.col("token_index").cast("bigint").alias("pos"), "node_id")

    def spans() -> DataFrame:
        at = toks.select(chain_id.alias("chain_id"), F.col("token_index").alias("pos"), F.col("node_id").alias("tok")).groupBy("chain_id", "pos").agg(F.min("tok").alias("tok"))
        wide = placed.filter("token_index is null and left_token is not null and right_token is not null").select("node_id", chain_id.alias("chain_id"), "left_token", "right_token")
        left = wide.join(at.select("chain_id", F.col("pos").alias("left_token"), F.col("tok").alias("left_tok")), ["chain_id", "left_token"], "left")
        both = left.join(at.select("chain_id", F.col("pos").alias("right_token"), F.col("tok").alias("right_tok")), ["chain_id", "right_token"], "left")
        spans_wide = both.select(F.lit(c).alias("corpus"), "node_id", F.lit(False).alias("is_token"), "chain_id", F.col("left_token").cast("bigint").alias("left_pos"), F.col("right_token").cast("bigint").alias("right_pos"), "left_tok", "right_tok")
        return _self_spans(chain()).unionByName(stored(spans_wide))

    def coverage() -> DataFrame:
        own_toks = own.filter("token_index is not null").select(F.lit(c).alias("corpus"), "node_id", F.col("node_id").alias("tok_id"))
        return own_toks.unionByName(edge.filter("ctype = 'Coverage'").select("corpus", F.col("source").alias("node_id"), F.col("target").alias("tok_id"))).dropDuplicates()

    return Graph(node, anno, edge, _empty(spark, "edge_anno"), {"tok_pos": chain, "span": spans, "coverage": coverage})
