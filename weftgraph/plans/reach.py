"""Paths through components: pairs of nodes at a distance.

A component in which no node has two parents is a forest (or holds cycles
below one parent each); its paths come from the hierarchy operator, which
unites links by tasks and not by joins. In any other component, what is
reached at all comes from the forest that is left without the links into nodes
of several parents, and from a closure over these nodes alone. Distances there
are walked from the wanted ends, one join a step; a walk never enters a node
again that is on its path, so that it ends by itself whatever the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..aql.model import Range
from ..operators.hierarchy import around, forest, numbered
from ..session import cut

#: Up to so many steps a walk is one plan of joins, without writing between them.
UNROLLED = 6
#: Steps between two writings of a longer one.
STRIDE = 4


def pairs(edges: DataFrame, dist: Range, starts: DataFrame | None = None, ends: DataFrame | None = None, depth: int | None = None, layered: bool = True, parent: str = "source") -> DataFrame:
    """Distinct (corpus, source, target) with a path of ``dist`` steps.

    ``starts`` (corpus, source) and ``ends`` (corpus, target) limit what is
    looked for; pairs beyond them may come too. ``depth`` is the longest path
    of a component known to be without cycles; without ``layered`` the edges
    are distinct already. ``parent`` says which end of an edge is above the
    other: steps to it spread least.
    """
    direct = edges.select("corpus", "source", "target").na.drop(subset=["source", "target"])
    if layered:
        direct = direct.dropDuplicates()
    if dist.high is not None and dist.high < dist.low:
        return direct.limit(0)
    if dist.low == 1 and dist.high == 1:
        return direct
    if depth is not None and depth <= UNROLLED and (dist.high is None or dist.high > depth):
        dist = Range(dist.low, depth)
    if dist.high is not None and dist.high < max(dist.low, 1):
        found = direct.limit(0)
    elif dist.high is not None and dist.high <= UNROLLED:
        found = _unrolled(direct, dist, starts, ends, parent) if depth is not None else _by_steps(direct, dist, starts, ends)
    else:
        child = _child_end(direct)
        if child:
            found = _by_paths(direct, dist, child, starts, ends)
        elif dist.high is None and dist.low <= 1:
            found = _closure(direct, ends)
        else:
            found = _by_steps(direct, dist, starts, ends)
    if dist.low == 0:
        ends = direct.select("corpus", F.col("source").alias("n")).unionByName(direct.select("corpus", F.col("target").alias("n"))).distinct()
        found = found.unionByName(ends.select("corpus", F.col("n").alias("source"), F.col("n").alias("target"))).distinct()
    return found


def _flipped(df: DataFrame) -> DataFrame:
    return df.select("corpus", F.col("target").alias("source"), F.col("source").alias("target"))


def _among(df: DataFrame, wanted: DataFrame | None, end: str) -> DataFrame:
    return df if wanted is None else df.join(wanted.select("corpus", end).distinct(), ["corpus", end], "left_semi")


def _child_end(direct: DataFrame) -> str | None:
    """The end of an edge at which every node stands once."""
    for end in ("target", "source"):
        if (direct.groupBy("corpus", end).count().agg(F.max("count").alias("n")).first().n or 0) <= 1:
            return end
    return None


def _unrolled(direct: DataFrame, dist: Range, starts: DataFrame | None, ends: DataFrame | None, parent: str) -> DataFrame:
    """Chained joins of a component without cycles; a step needs no path to look back on."""
    if ends is not None and (starts is None or parent == "source"):
        return _flipped(_unrolled(_flipped(direct), dist, ends.select("corpus", F.col("target").alias("source")), None, "target"))
    nxt = direct.select("corpus", F.col("source").alias("at"), F.col("target").alias("to"))
    walk = _among(direct, starts, "source")
    out = walk if dist.low <= 1 else None
    for length in range(2, dist.high + 1):
        walk = walk.select("corpus", "source", F.col("target").alias("at")).join(nxt, ["corpus", "at"]).select("corpus", "source", F.col("to").alias("target"))
        if length >= dist.low:
            out = walk if out is None else out.unionByName(walk)
    return out.distinct()


def _by_paths(direct: DataFrame, dist: Range, child: str, starts: DataFrame | None, ends: DataFrame | None) -> DataFrame:
    """Of a forest; each wanted child meets its ancestors."""
    parent, wanted, above = ("source", ends, starts) if child == "target" else ("target", starts, ends)
    n = numbered(direct.filter("source <> target"), ["corpus"], child, parent)
    tree = cut(forest(n.links, "node", "up", paths=True))
    far = F.col("depth") - F.col("pos")
    named = n.named(tree.filter("not cyclic").select(F.col("node").alias(child), "depth", "path"), child)
    steps = _among(named, wanted, child).select("corpus", child, F.posexplode("path").alias("pos", "above"), "depth").select("corpus", child, "above", far.alias("far"))
    loops = around(n.links, tree)
    if loops is not None:
        turns = n.named(loops.select(F.col("node").alias(child), "above", "far"), child)
        steps = steps.unionByName(_among(turns, wanted, child).select(*steps.columns))
    out = steps.filter((F.col("far") >= max(dist.low, 1)) & (F.lit(True) if dist.high is None else F.col("far") <= dist.high)).select("corpus", child, F.col("above").alias(parent))
    if n.ids is not None:
        out = out.join(n.ids.select(F.col("_id").alias(parent), "_node"), parent).select("corpus", child, F.col("_node").alias(parent))
    return _among(out, above, parent).select("corpus", "source", "target")


def _closure(direct: DataFrame, ends: DataFrame | None) -> DataFrame:
    """All pairs with a path between them.

    Nodes with several parents are tops of a forest of the other links. Above a
    node lie its path to its top and, if that has several parents, these with
    what lies above them; only the tops are walked.
    """
    n = numbered(direct, ["corpus"], "target", "source")
    links = cut(n.links.select("node", "up").filter("node <> up").distinct())
    joint = links.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    into = cut(links.join(joint, "node", "left_semi").select(F.col("node").alias("top"), F.col("up").alias("entry")))
    tree = cut(forest(links.join(joint, "node", "left_anti"), "node", "up", paths=True))
    single = tree.filter("not cyclic").select("node", F.explode("path").alias("above")).filter("node <> above")
    loops = around(links, tree)
    if loops is not None:
        single = single.unionByName(loops.select("node", "above"))
    single = cut(single)
    tops = tree.filter("not cyclic").select("node", F.col("root").alias("top"))
    # entries above each top: one step is from an entry to its own top and from there to its entries
    up = cut(_hops(into, tops))
    levels, new = [up.select("top", "entry")], up
    while new.limit(1).count():
        step = new.select("top", F.col("at").alias("mid")).join(up.select(F.col("top").alias("mid"), "entry", "at"), "mid").select("top", "entry", "at").distinct()
        for level in levels:
            step = step.join(level, ["top", "entry"], "left_anti")
        new = cut(step)
        levels.append(new.select("top", "entry"))
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    over = cut(reached.unionByName(reached.withColumnRenamed("entry", "node").join(single, "node").select("top", F.col("above").alias("entry"))).distinct())
    mine = links.select("node").distinct().join(tops, "node", "left").select("node", F.coalesce("top", "node").alias("top"))
    found = single.unionByName(mine.join(over, "top").select("node", F.col("entry").alias("above"))).filter("node <> above").distinct()
    out = n.named(found.select(F.col("above").alias("source"), F.col("node").alias("target")), "target", "source")
    return _among(out, ends, "target").select("corpus", "source", "target")


def _hops(into: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, entry, at): the parents of each top, and the tops of these."""
    own = tops.withColumnsRenamed({"node": "entry", "top": "at"})
    return into.join(own, "entry", "left").select("top", "entry", F.coalesce("at", "entry").alias("at"))


def _by_steps(direct: DataFrame, dist: Range, starts: DataFrame | None, ends: DataFrame | None = None) -> DataFrame:
    if starts is None and ends is not None:
        return _flipped(_by_steps(_flipped(direct), dist, ends.select("corpus", F.col("target").alias("source"))))
    nxt = direct.select("corpus", F.col("source").alias("at"), F.col("target").alias("to"))
    begin = _among(direct, starts, "source").filter("source <> target")
    walk = begin.select("corpus", "source", F.col("target").alias("at"), F.array("source", "target").alias("path"))
    out = walk.select("corpus", "source", F.col("at").alias("target")) if dist.low <= 1 else None
    length = 1
    unrolled = dist.high is not None and dist.high <= UNROLLED
    while dist.high is None or length < dist.high:
        walk = walk.join(nxt, ["corpus", "at"]).filter(~F.array_contains("path", F.col("to"))).select("corpus", "source", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        length += 1
        written = not unrolled and length % STRIDE == 0
        if written:
            walk = cut(walk)
        if length >= dist.low:
            hit = walk.select("corpus", "source", F.col("at").alias("target"))
            out = hit if out is None else out.unionByName(hit)
        if written:
            if not walk.limit(1).count():
                break
            if out is not None:
                out = cut(out.distinct())
    return direct.limit(0) if out is None else out.distinct()
