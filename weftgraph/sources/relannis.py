"""Graphs from relANNIS directories (tab-separated exports of PostgreSQL).

Versions 3.3 (``.annis`` files) and 3.2 (``.tab``) differ in columns. Files
are read as lines by all tasks; everything derived (token order, coverage,
white space, corpus paths) is joins and windows within a text. A missing file
counts as empty.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import ANNIS, Graph
from ..session import cut
from .updates import EVENT_SCHEMA, apply_updates, empty_graph

#: Fixed value: stands for a NULL annotation value, so that a search by name still finds it.
NULL_VALUE = chr(0x10FFFF)
#: Component types by letter.
LETTERS = {"c": "Coverage", "d": "Dominance", "p": "Pointing", "o": "Ordering"}
#: Characters of a name that are written as %XX.
RESERVED = ':/ %\\<>"|?*'
#: Columns of the node table by version: with the segmentation's index, name and text.
NODE_COLUMNS = {True: {"left_al": 8, "right_al": 9, "seg_index": 10, "seg": 11, "span": 12}, False: {"left_al": 5, "right_al": 6, "seg_index": 9, "seg": 8, "span": 9}}


def encoded(c: Column) -> Column:
    out = F.replace(c, F.lit("%"), F.lit("%25"))
    for ch in RESERVED:
        if ch != "%":
            out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return out


def _unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for escape, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v")):
        out = F.replace(out, F.lit(escape), F.lit(char))
    return F.replace(F.regexp_replace(out, r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)
        version = self.path / "annis.version"
        self.v33 = version.exists() and version.read_text().strip() == "3.3"

    def table(self, file: str, /, **columns: int) -> DataFrame:
        """The named columns by position; NULL is null."""
        f = self.path / f"{file}.{'annis' if self.v33 else 'tab'}"
        if not f.exists():
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        parts = self.spark.read.option("lineSep", "\n").text(str(f)).select(F.split("value", "\t", -1).alias("p"))
        field = lambda i: F.get("p", F.lit(i))
        return parts.select(*[F.when(field(i) != "NULL", _unescaped(field(i))).alias(c) for c, i in columns.items()])


def _events(df: DataFrame, nr: int, kind: str, **of: Column | str) -> DataFrame:
    value = lambda c: F.col(of[c]) if isinstance(of.get(c), str) else of[c] if c in of else F.lit(None)
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return df.select(F.lit(nr).cast("bigint").alias("nr"), F.lit(kind).alias("kind"), *[value(c).cast("string").alias(c) for c in names[2:]])


def corpus_tree(files: _Files) -> DataFrame:
    """(id, name, path, parent, pre, post, top): paths from the nesting of pre- and post-orders."""
    c = files.table("corpus", id=0, name=1, type=2, pre=4, post=5).select(F.col("id").cast("bigint").alias("id"), "name", "type", F.col("pre").cast("bigint").alias("pre"), F.col("post").cast("bigint").alias("post"))
    again = F.row_number().over(Window.partitionBy("name", F.col("type") == "DOCUMENT").orderBy("pre"))
    c = cut(c.withColumn("_k", again).withColumn("name", F.when((F.col("type") == "DOCUMENT") & (F.col("_k") > 1), F.concat("name", F.lit("_duplicated_document_name_"), "_k")).otherwise(F.col("name"))).drop("_k"))
    inner = c.filter("post > pre + 1").select(F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("name").alias("a_name"))
    inner = F.broadcast(inner) if inner.limit(100_001).count() <= 100_000 else inner
    above = c.join(inner, (F.col("a_pre") < F.col("pre")) & (F.col("post") < F.col("a_post")), "left")
    names = above.groupBy("id", "name", "pre", "post").agg(F.sort_array(F.collect_list(F.struct("a_pre", "a_name"))).alias("up"))
    parts = F.transform(F.filter("up", lambda x: x["a_pre"].isNotNull()), lambda x: encoded(x["a_name"]))
    return names.select("id", "name", "pre", "post", (F.size(parts) == 0).alias("top"), F.concat_ws("/", parts).alias("parent"), F.concat_ws("/", F.concat(parts, F.array(encoded(F.col("name"))))).alias("path"))


def import_relannis(spark: SparkSession, path: str, corpus: str | None = None) -> Graph:
    files = _Files(spark, path)
    v33 = files.v33
    tree = cut(corpus_tree(files))
    top = tree.filter("top").orderBy("pre").first()
    if top is None:
        raise ValueError(f"{path} has no corpus")
    at = NODE_COLUMNS[v33]
    n = files.table("node", id=0, text_ref=1, corpus_ref=2, layer=3, name=4, left=5, right=6, index=7, **at)
    long = lambda *cs: [F.col(c).cast("bigint").alias(c) for c in cs]
    n = n.select(*long("id", "text_ref", "corpus_ref", "left", "right", "index", "left_al", "right_al", "seg_index"), "layer", "name", "seg", "span")
    n = cut(n.join(tree.select(F.col("id").alias("corpus_ref"), "path"), "corpus_ref").withColumn("node", F.concat("path", F.lit("#"), "name")))
    texts = files.table("text", **({"corpus_ref": 0, "text_ref": 1, "text_name": 2, "text": 3} if v33 else {"text_ref": 0, "text_name": 1, "text": 2}))
    texts = texts.withColumn("text_ref", F.col("text_ref").cast("bigint"))
    if v33:
        texts = texts.withColumn("corpus_ref", F.col("corpus_ref").cast("bigint"))
    else:
        texts = texts.join(n.select("text_ref", "corpus_ref").distinct(), "text_ref")
    texts = cut(texts.join(tree.select(F.col("id").alias("corpus_ref"), "path"), "corpus_ref").withColumn("source", F.concat("path", F.lit("#"), encoded(F.col("text_name")))))
    annos = files.table("node_annotation", id=0, ns=1, name=2, value=3).select(*long("id"), F.coalesce("ns", F.lit("")).alias("ns"), "name", "value")
    lit, annis = F.lit, F.lit(ANNIS)
    parts = [
        _events(tree, 0, "add_node", node="path", node_type=lit("corpus")),
        _events(tree.filter("top"), 1, "add_node_label", node="path", ns=annis, name=lit("relannis-version"), value=lit("3.3" if v33 else "3.2")),
        _events(tree.filter("not top and pre + 1 = post"), 1, "add_node_label", node="path", ns=annis, name=lit("doc"), value="name"),
        _events(tree.filter("not top"), 2, "add_edge", source="path", target="parent", ctype=lit("PartOf"), layer=annis, cname=lit("")),
        _events(texts, 0, "add_node", node="source", node_type=lit("datasource")),
        _events(texts, 2, "add_edge", source="source", target="path", ctype=lit("PartOf"), layer=annis, cname=lit("")),
        _events(n.join(texts.select("corpus_ref", "text_ref", "source"), ["corpus_ref", "text_ref"]), 2, "add_edge", source="node", target="source", ctype=lit("PartOf"), layer=annis, cname=lit("")),
        _events(n, 0, "add_node", node="node", node_type=lit("node")),
        _events(n.filter("layer <> ''"), 1, "add_node_label", node="node", ns=annis, name=lit("layer"), value="layer"),
    ]
    meta = files.table("corpus_annotation", id=0, ns=1, name=2, value=3).withColumn("id", F.col("id").cast("bigint")).join(tree.select("id", "path"), "id")
    parts.append(_events(meta, 1, "add_node_label", node="path", ns=F.coalesce("ns", lit("")), name="name", value="value"))
    # texts of tokens and of segmentation spans, the latter else from the annotation of that name
    toks = n.filter("index is not null")
    segs = n.filter("index is null and seg is not null and seg_index is not null")
    own_text = toks.select("node", "span").unionByName(segs.filter("span is not null").select("node", "span") if v33 else segs.limit(0).select("node", "span"))
    missing = segs.filter("span is null") if v33 else segs
    from_anno = missing.join(annos.select("id", F.col("name").alias("seg"), "value"), ["id", "seg"]).select("node", F.col("value").alias("span"))
    parts.append(_events(own_text.unionByName(from_anno), 1, "add_node_label", node="node", ns=annis, name=lit("tok"), value="span"))
    parts.append(_events(annos.join(n.select("id", "node"), "id"), 1, "add_node_label", node="node", ns="ns", name="name", value=F.coalesce("value", lit(NULL_VALUE))))
    parts += _whitespace(toks, texts)
    # order of tokens and segments
    follow = Window.partitionBy("corpus_ref", "text_ref", "seg").orderBy("_at")
    seq = toks.select("corpus_ref", "text_ref", lit("").alias("seg"), F.col("index").alias("_at"), "node").unionByName(segs.select("corpus_ref", "text_ref", "seg", F.col("seg_index").alias("_at"), "node"))
    nxt = seq.withColumn("next", F.lead("node").over(follow)).filter("next is not null")
    parts.append(_events(nxt, 2, "add_edge", source="node", target="next", ctype=lit("Ordering"), layer=F.when(F.col("seg") == "", ANNIS).otherwise("default_ns"), cname="seg"))
    # explicit edges
    letter = F.create_map(*[lit(x) for kv in LETTERS.items() for x in kv])
    comp = files.table("component", id=0, letter=1, layer=2, cname=3).select(F.col("id").alias("component"), letter[F.lower("letter")].alias("ctype"), F.coalesce("layer", lit("")).alias("layer"), F.coalesce("cname", lit("")).alias("cname")).filter("ctype is not null")
    rank = files.table("rank", **({"pre": 0, "node_ref": 3, "component": 4, "parent": 5} if v33 else {"pre": 0, "node_ref": 2, "component": 3, "parent": 4}))
    rank = rank.join(comp, "component").withColumn("node_ref", F.col("node_ref").cast("bigint"))
    ends = n.select(F.col("id").alias("node_ref"), "node")
    up = rank.select(F.col("pre").alias("parent"), F.col("node_ref").alias("up_ref"))
    edges = rank.filter("parent is not null").join(up, "parent").join(ends.withColumnRenamed("node", "target"), "node_ref").join(ends.select(F.col("node_ref").alias("up_ref"), F.col("node").alias("source")), "up_ref")
    edges = cut(edges.select("pre", "source", "target", "ctype", "layer", "cname"))
    parts.append(_events(edges, 2, "add_edge", source="source", target="target", ctype="ctype", layer="layer", cname="cname"))
    marked = files.table("edge_annotation", pre=0, ns=1, name=2, value=3).join(edges, "pre")
    parts.append(_events(marked, 3, "add_edge_label", source="source", target="target", ctype="ctype", layer="layer", cname="cname", ns=F.coalesce("ns", lit("")), name="name", value=F.coalesce("value", lit(NULL_VALUE))))
    lone = rank.filter("parent is null and ctype = 'Coverage'").join(ends, "node_ref").groupBy("node").agg(F.max(F.struct("pre", "layer", "cname")).alias("c")).select("node", "c.layer", "c.cname")
    parts.append(_coverage(n, toks, edges.filter("ctype = 'Coverage'"), lone))
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    return apply_updates(empty_graph(spark), events, corpus or top["name"])


def _whitespace(toks: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Labels for the text between tokens, and before the first."""
    by_index = Window.partitionBy("corpus_ref", "text_ref").orderBy("index")
    t = toks.join(texts.select("corpus_ref", "text_ref", "text"), ["corpus_ref", "text_ref"]).withColumn("_next", F.lead("left").over(by_index)).withColumn("_first", F.row_number().over(by_index) == 1)
    after = F.substring(F.col("text"), F.col("right").cast("int") + 1, F.greatest(F.coalesce(F.col("_next"), F.length("text")) - F.col("right"), F.lit(0)).cast("int"))
    before = F.substring(F.col("text"), F.lit(1), (F.col("left") - 1).cast("int"))
    label = lambda df, name, value: _events(df, 1, "add_node_label", node="node", ns=F.lit(ANNIS), name=F.lit(name), value=value)
    return [label(t, "tok-whitespace-after", after), label(t.filter("_first and left > 0"), "tok-whitespace-before", before)]


def _coverage(n: DataFrame, toks: DataFrame, explicit: DataFrame, lone: DataFrame) -> DataFrame:
    """Coverage of spans that follows from their borders and isn't explicit."""
    place = ["corpus_ref", "text_ref"]
    spans = n.filter("index is null").select("id", "node", *place, "left_al", "right_al")
    left = toks.groupBy(*place, "left_al").agg(F.max_by("index", "id").alias("li"))
    right = toks.groupBy(*place, "right_al").agg(F.max_by("index", "id").alias("ri"))
    b = spans.join(left, [*place, "left_al"], "left").join(right, [*place, "right_al"], "left").withColumns({"a": F.coalesce("li", "ri"), "b": F.coalesce("ri", "li")}).filter("a is not null and a <= b")
    each = b.withColumn("index", F.explode(F.sequence("a", "b"))).join(toks.select(*place, "index", F.col("node").alias("target")), [*place, "index"]).select(F.col("node").alias("source"), "target")
    known = explicit.select("source", "target").distinct()
    new = each.join(known, ["source", "target"], "left_anti")
    has = known.select("source").distinct().withColumn("_has", F.lit(True))
    named = new.join(has, "source", "left").join(lone.withColumnRenamed("node", "source"), "source", "left")
    layer = F.when(F.col("_has"), ANNIS).otherwise(F.coalesce("layer", F.lit("")))
    cname = F.when(F.col("_has"), "autogenerated-coverage").otherwise(F.coalesce("cname", F.lit("")))
    return _events(named, 2, "add_edge", source="source", target="target", ctype=F.lit("Coverage"), layer=layer, cname=cname)
