"""Update events applied to graphs.

Events are rows (nr, kind, node, node_type, source, target, ctype, layer,
cname, ns, name, value) with the kinds ``add_node delete_node add_node_label
delete_node_label add_edge delete_edge add_edge_label delete_edge_label``.
They take effect in the order of ``nr``. For each thing that an event touches
its last one decides; a node's deletion also ends what was said before about
its labels and edges, so those only count if they come later, and things said
of a node that doesn't live at that time are ignored. All of it is joins and
aggregates over the events, no loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import Files
from ..plans.graph import SCHEMAS, Graph
from ..plans.index import indexed
from ..session import checkpoint_dir, cut

EVENT_SCHEMA = "nr bigint, kind string, node string, node_type string, source string, target string, ctype string, layer string, cname string, ns string, name string, value string"
#: Events that are held before they are written, and the number from which on those of edges are counted.
BATCH, EDGES_FROM = 100_000, 1 << 50
_EDGE = ["source", "target", "ctype", "layer", "cname"]


def event(nr: int, kind: str, **of) -> tuple:
    return (nr, kind, *(of.get(c) for c in ("node", "node_type", "source", "target", "ctype", "layer", "cname", "ns", "name", "value")))


def events_of(items: Iterable[tuple]) -> Iterator[tuple]:
    """Update events from a reader's items; those of edges come after all of nodes by their numbers."""
    for i, (kind, *x) in enumerate(items):
        if kind == "node":
            yield event(i, "add_node", node=x[0], node_type=x[1])
        elif kind == "label":
            yield event(i, "add_node_label", node=x[0], ns=x[1], name=x[2], value=x[3])
        elif kind in ("edge", "edge_label"):
            of = dict(zip(("source", "target", "ctype", "layer", "cname"), x[:5]))
            if kind == "edge_label":
                of |= {"ns": x[5], "name": x[6], "value": x[7]}
            yield event(i + EDGES_FROM, f"add_{kind}", **of)


def graph_of_events(spark: SparkSession, items: Iterable[tuple], corpus: str, batch: int = BATCH) -> Graph:
    """The graph that a reader's items tell of; they are written to the shared folder by batches as they are read."""
    files = Files(spark, f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}")
    events = events_of(items)
    while rows := list(islice(events, batch)):
        spark.createDataFrame(rows, EVENT_SCHEMA).write.mode("append").parquet(files.root)
    told = spark.read.schema(EVENT_SCHEMA).parquet(files.root) if files.exists(files.root) else spark.createDataFrame([], EVENT_SCHEMA)
    graph = apply_updates(empty_graph(spark), told, corpus)
    files.delete(files.root)  # they were read into checkpoints
    return graph


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], SCHEMAS[t]) for t in ("node", "anno", "edge", "edge_anno")))


def _as_events(graph: Graph, corpus: str) -> DataFrame:
    """What a graph says, as events before all others."""
    null = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    node = graph.node.filter(F.col("corpus") == corpus)
    names = node.select("node_id", "node_name")
    a, b = (names.select(F.col("node_id").alias(f"{k}_id"), F.col("node_name").alias(k)) for k in ("source", "target"))

    def ends(df: DataFrame) -> DataFrame:
        e = df.filter(F.col("corpus") == corpus).withColumnsRenamed({"source": "source_id", "target": "target_id"})
        return e.join(a, "source_id").join(b, "target_id")

    nr = lambda k: F.lit(k).cast("bigint").alias("nr")
    parts = [
        node.select(nr(-4), F.lit("add_node").alias("kind"), F.col("node_name").alias("node"), "node_type", *null("source", "target", "ctype", "layer", "cname", "ns", "name", "value")),
        graph.anno.filter(F.col("corpus") == corpus).join(names, "node_id").select(nr(-3), F.lit("add_node_label").alias("kind"), F.col("node_name").alias("node"), *null("node_type", "source", "target", "ctype", "layer", "cname"), "ns", "name", "value"),
        ends(graph.edge).select(nr(-2), F.lit("add_edge").alias("kind"), *null("node", "node_type"), *_EDGE, *null("ns", "name", "value")),
        ends(graph.edge_anno).select(nr(-1), F.lit("add_edge_label").alias("kind"), *null("node", "node_type"), *_EDGE, "ns", "name", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _last(df: DataFrame, key: list[str], *values: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(F.struct("nr", "kind", *values), "nr").alias("_l"), F.count(F.lit(1)).alias("_n")).select(*key, "_l.*")


def apply_updates(graph: Graph, events: DataFrame, corpus: str) -> Graph:
    """The graph of ``corpus`` after the events, with its derived tables built anew."""
    ev = cut(_as_events(graph, corpus).unionByName(events.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")])))
    # the life of a node begins with the first addition after its last deletion
    of_node = ev.filter(F.col("kind").isin("add_node", "delete_node")).select("nr", "kind", "node", "node_type")
    gone = of_node.filter("kind = 'delete_node'").groupBy("node").agg(F.max("nr").alias("gone"))
    born = of_node.filter("kind = 'add_node'").join(gone, "node", "left").filter("gone is null or nr > gone").groupBy("node").agg(F.min("nr").alias("born"), F.min_by("node_type", "nr").alias("node_type"))
    old = graph.node.filter(F.col("corpus") == corpus).select(F.col("node_name").alias("node"), "node_id")
    top = old.agg(F.max("node_id")).first()[0]
    known = born.join(old, "node", "left")
    fresh = _numbered(known.filter("node_id is null"), -1 if top is None else top)
    alive = cut(known.filter("node_id is not null").unionByName(fresh))
    label_key = ["node", "ns", "name"]
    of_label = ev.filter(F.col("kind").isin("add_node_label", "delete_node_label")).select("nr", "kind", *label_key, "value").join(alive, "node").filter("nr > born")
    labels = _last(of_label, ["node_id", "ns", "name"], "value").filter("kind = 'add_node_label'")
    a, b = (alive.select(F.col("node").alias(k), F.col("node_id").alias(f"{k}_id"), F.col("born").alias(f"{k}_born")) for k in ("source", "target"))

    def living(kinds: tuple[str, ...], *more: str) -> DataFrame:
        e = ev.filter(F.col("kind").isin(*kinds)).select("nr", "kind", *_EDGE, *more)
        return e.join(a, "source").join(b, "target").filter("nr > source_born and nr > target_born").select("nr", "kind", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "ctype", "layer", "cname", *more)

    edges = living(("add_edge", "delete_edge"))
    off = edges.filter("kind = 'delete_edge'").groupBy(*_EDGE).agg(F.max("nr").alias("off"))
    on = edges.filter("kind = 'add_edge'").join(off, _EDGE, "left").filter("off is null or nr > off").groupBy(*_EDGE).agg(F.min("nr").alias("on"))
    on = cut(on)
    of_edge_label = living(("add_edge_label", "delete_edge_label"), "ns", "name", "value").join(on, _EDGE).filter("nr > on")
    edge_labels = _last(of_edge_label, [*_EDGE, "ns", "name"], "value").filter("kind = 'add_edge_label'")
    c = F.lit(corpus).alias("corpus")

    def merged(whole: DataFrame, mine: DataFrame, name: str) -> DataFrame:
        cols = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        return whole.filter(F.col("corpus") != corpus).select(*cols).unionByName(mine.select(*cols))

    return indexed(
        Graph(
            merged(graph.node, cut(alive.select(c, "node_id", F.col("node").alias("node_name"), "node_type")), "node"),
            merged(graph.anno, cut(labels.select(c, "node_id", "ns", "name", "value")), "anno"),
            merged(graph.edge, on.select(c, *_EDGE), "edge"),
            merged(graph.edge_anno, cut(edge_labels.select(c, *_EDGE, "ns", "name", "value")), "edge_anno"),
        )
    )


def _numbered(df: DataFrame, top: int) -> DataFrame:
    """Ids from top + 1 on in the order of birth: counted by ranges of the order, so no task numbers all rows."""
    ranged = cut(df.drop("node_id").repartitionByRange(F.col("born"), F.col("node")).sortWithinPartitions("born", "node").withColumn("_p", F.spark_partition_id()))
    sizes = {r._p: r.n for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, at = {}, top + 1
    for p in sorted(sizes):
        begin[p], at = at, at + sizes[p]
    if not begin:
        return ranged.select("node", "born", "node_type", F.lit(None).cast("bigint").alias("node_id"))
    from pyspark.sql.window import Window

    start = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[F.col("_p")]
    return ranged.withColumn("node_id", (start + F.row_number().over(Window.partitionBy("_p").orderBy("born", "node")) - 1).cast("bigint")).select("node", "born", "node_type", "node_id")
