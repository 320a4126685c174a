"""Parent-child rows into hierarchies: root, depth, path and descendants of every node, and cycles.

Weighted disjoint-set forests: each task takes a range of the links, unites
them locally (path doubling over an index of its nodes) and gives every node
the top it reaches there, with the offset to it. A top that is a child in
another range is a link of the next, much smaller level; the levels merge until
no top has a parent, and the offsets are added on the way back. A level that
fits one task's bound is finished in one; one that doesn't shrink is doubled by
joins instead, so that any shape ends after a logarithmic number of rounds.

Defined cases: rows with a null end make no link; a node with several parents
keeps the smallest; repeated rows are one link; a node on a cycle, or whose
parents lead into one, has depth -1, the smallest id of that cycle as its root
and no path; a link to itself is a cycle; a node without a link is a root of
depth 0; empty inputs give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join, salted_join
from ..session import cut

#: Links that one task unites.
BLOCK_LINKS = 1_000_000
#: A level that keeps more than this share of its links is doubled by joins.
SHRINK = 0.8


def _ascend(parent: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the furthest ancestor within the block, the weight to it, and the least id met; parent is -1 at tops."""
    inner = parent >= 0
    anc = np.where(inner, parent, np.arange(len(parent)))
    far = np.where(inner, weight, 0)
    least = ids.copy()
    for _ in range(max(1, len(parent)).bit_length() + 1):
        far = far + far[anc]
        least = np.minimum(least, least[anc])
        jump = anc[anc]
        if np.array_equal(jump, anc) and not inner[anc].any():
            break
        anc = jump
    return anc, far, least


def _segments(parent: np.ndarray, far: np.ndarray, own: list[list[int]], cyclic: np.ndarray) -> list[list[int] | None]:
    """The ids from below the block's top down to each node, parents before children."""
    out: list[list[int] | None] = [None] * len(own)
    for i in np.argsort(far, kind="stable"):
        if not cyclic[i]:
            p = parent[i]
            out[i] = own[i] if p < 0 else out[p] + own[i]
    return out


def _block(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).sort_by("node")
        ids, ups, w = (t.column(c).to_numpy() for c in ("node", "up", "w"))
        at = np.searchsorted(ids, ups)
        parent = np.where((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == ups), at, -1)
        anc, far, least = _ascend(parent, w, ids)
        cyclic = parent[anc] >= 0
        out = {
            "node": pa.array(ids),
            "top": pa.array(np.where(cyclic, least[anc], ups[anc])),
            "off": pa.array(np.where(cyclic, 0, far + w[anc])),
            "cyclic": pa.array(cyclic),
        }
        if paths:
            out["seg"] = pa.array(_segments(parent, far, t.column("seg").to_pylist(), cyclic), pa.list_(pa.int64()))
        yield from pa.table(out).to_batches(max_chunksize=10_000)

    return run


def _united(links: DataFrame, n: int, block: int, paths: bool) -> DataFrame:
    blocks = math.ceil(n / block)
    placed = links.repartitionByRange(blocks, "node") if blocks > 1 else links.coalesce(1)
    return cut(placed.mapInArrow(_block(paths), "node bigint, top bigint, off bigint, cyclic boolean" + ", seg array<bigint>" * paths))


def _doubled(links: DataFrame, n: int, paths: bool) -> DataFrame:
    """The same by joins: every round doubles the reach of each link."""
    if paths:  # paths are only followed where they end
        ends = _doubled(links, n, False)
        loops = ends.filter("cyclic").select("*", F.lit(None).cast("array<bigint>").alias("seg"))
        links = links.join(loops.select("node"), "node", "left_anti")
    seg = ["seg"] * paths
    cur = links.select("node", F.col("up").alias("top"), F.col("w").alias("off"), F.col("node").alias("least"), *seg)
    still_open = True
    for _ in range(n.bit_length() + 1):
        ahead = cur.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("off").alias("off2"), F.col("least").alias("least2"), *[F.col("seg").alias("seg2")] * paths)
        hit = F.col("top2").isNotNull()
        cur = cut(
            salted_join(cur, ahead, ["top"], "left").select(
                "node", F.coalesce("top2", "top").alias("top"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), F.least("least", F.coalesce("least2", "least")).alias("least"), hit.alias("open"),
                *[F.when(hit, F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg")] * paths,
            )
        )
        still_open = bool(cur.filter("open").limit(1).count())
        cur = cur.drop("open")
        if not still_open:
            break
    if not still_open:
        flat = cur.select("node", "top", "off", F.lit(False).alias("cyclic"), *seg)
        return cut(flat.unionByName(loops)) if paths else flat
    # what is still open after so many rounds leads into a cycle, and its top is on it
    on = salted_join(cur, cur.select(F.col("node").alias("top"), F.col("least").alias("on_cycle")), ["top"], "left")
    cyclic = F.col("on_cycle").isNotNull()
    return cut(on.select("node", F.when(cyclic, F.col("on_cycle")).otherwise(F.col("top")).alias("top"), F.when(cyclic, F.lit(0)).otherwise(F.col("off")).cast("bigint").alias("off"), cyclic.alias("cyclic")))


def _resolved(united: DataFrame, above: DataFrame, rows: int, paths: bool) -> DataFrame:
    """``united`` with each top replaced by what is known of it one level further."""
    ahead = above.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("off").alias("off2"), F.col("cyclic").alias("cyclic2"), *[F.col("seg").alias("seg2")] * paths)
    j = lookup_join(united, ahead, ["top"], "left", rows=rows)
    hit = F.col("top2").isNotNull() & ~F.col("cyclic")
    into = hit & F.coalesce(F.col("cyclic2"), F.lit(False))
    return cut(
        j.select(
            "node", F.when(hit, F.col("top2")).otherwise(F.col("top")).alias("top"), F.when(into, F.lit(0)).when(hit, F.col("off") + F.col("off2")).otherwise(F.col("off")).cast("bigint").alias("off"), (F.col("cyclic") | into).alias("cyclic"),
            *[F.when(into, F.lit(None)).when(hit, F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg")] * paths,
        )
    )


def forest(links: DataFrame, node: str, parent: str, paths: bool = False, block: int = BLOCK_LINKS) -> DataFrame:
    """(node, root, depth, cyclic) of every node with a parent, and its path from the root if ``paths``."""
    seg = [F.array("node").alias("seg")] * paths
    real = links.select(F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("up")).na.drop()
    level = cut(real.groupBy("node").agg(F.min("up").alias("up")).select("node", "up", F.lit(1).cast("bigint").alias("w"), *seg))
    n = level.count()
    #: Each level's result and, with their number, the tops that it settled as cyclic
    done: list[tuple[DataFrame, DataFrame | None, int, int]] = []
    while n:
        united = _united(level, n, block, paths)
        if n <= block:
            done.append((united, None, 0, n))
            break
        tops = united.filter(~F.col("cyclic")).select(F.col("top").alias("node")).distinct()
        parents = cut(united.join(tops, "node", "left_semi"))
        settled, k = parents.filter("cyclic"), parents.filter(~F.col("cyclic")).count()
        done.append((united, settled, parents.count() - k, n))
        level = parents.filter(~F.col("cyclic")).select("node", F.col("top").alias("up"), F.col("off").alias("w"), *["seg"] * paths)
        if k > block and k > SHRINK * n:
            done.append((_doubled(level, k, paths), None, 0, k))
            break
        n = k
    if not done:
        return level.select("node", F.col("up").alias("root"), F.col("w").alias("depth"), F.lit(False).alias("cyclic"), *[F.col("seg").alias("path")] * paths)
    final, size = None, 0
    for i in range(len(done) - 1, -1, -1):
        united, _, _, n = done[i]
        above, rows = final, size
        for _, settled, m, _ in done[: i + 1]:
            if m:
                above, rows = (settled if above is None else above.unionByName(settled)), rows + m
        final, size = (united if above is None else _resolved(united, above, rows, paths)), n
    path = F.when(~F.col("cyclic"), F.concat(F.array("top"), "seg")).alias("path")
    return final.select("node", F.col("top").alias("root"), F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("off")).cast("bigint").alias("depth"), "cyclic", *[path] * paths)


def around(links: DataFrame, tree: DataFrame) -> DataFrame | None:
    """(node, above, far) of what lies on or below cycles, nodes of one parent each; nothing if there are none.

    Each cycle is cut above its smallest node, which leaves a tree. A node's
    way up ends there, goes on at the other side of the cut, and meets what of
    the cycle it hasn't met before.
    """
    on = tree.filter("cyclic").select("node", "root")
    if not on.limit(1).count():
        return None
    mine = cut(links.join(on, "node").distinct())
    grown = forest(mine.filter("node <> root"), "node", "up", paths=True).select("node", "root", "depth", "path")
    heads = mine.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.array("node").alias("path"))
    grown = cut(grown.unionByName(heads))
    rings = mine.filter("node = root").select("up").join(grown.withColumnRenamed("node", "up"), "up").select("root", (F.col("depth") + 1).alias("length"), F.posexplode("path").alias("pos", "above"))
    up = grown.select("node", "path", "depth", F.posexplode("path").alias("pos", "above")).select("node", "above", (F.col("depth") - F.col("pos")).alias("far"))
    over = grown.join(rings, "root").filter(~F.array_contains("path", F.col("above"))).select("node", "above", (F.col("depth") + F.col("length") - F.col("pos")).alias("far"))
    return up.unionByName(over).filter("node <> above")


@dataclass
class Numbered:
    """Links between nodes that are named by their id and some further columns, brought to one number a node."""

    #: (node, up)
    links: DataFrame
    by: list[str]
    #: (by, _node, _id), or nothing if all links agree in ``by``: then ids are numbers already
    ids: DataFrame | None
    shared: list[Column]

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the columns ``by`` and, for the numbers in ``columns``, the nodes' ids again."""
        if self.ids is None:
            return df.select(*self.shared, *df.columns)
        out = df
        for i, c in enumerate(columns):
            of = self.ids.select(F.col("_id").alias(c), F.col("_node"), *(self.by if i == 0 else []))
            out = out.join(of, c).drop(c).withColumnRenamed("_node", c)
        return out.select(*self.by, *df.columns)


def numbered(links: DataFrame, by: list[str], node: str, parent: str) -> Numbered:
    real = links.select(*by, F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("up")).na.drop(subset=["node", "up"])
    least = real.agg(*[f(F.struct(*by)).alias(k) for k, f in (("a", F.min), ("z", F.max))]).first()
    if least.a == least.z:
        types = dict(links.dtypes)
        return Numbered(real.select("node", "up"), by, None, [F.lit(least.a and least.a[c]).cast(types[c]).alias(c) for c in by])
    ids = cut(real.select(*by, F.col("node").alias("_node")).unionByName(real.select(*by, F.col("up").alias("_node"))).distinct().withColumn("_id", F.monotonically_increasing_id()))
    for end in ("node", "up"):
        other = ids.withColumnsRenamed({c: f"_{c}" for c in by})
        same = F.col(end) == F.col("_node")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        real = real.join(other, same).drop("_node", end, *[f"_{c}" for c in by]).withColumnRenamed("_id", end)
    return Numbered(real.select("node", "up"), by, ids, [])


def hierarchy(nodes: DataFrame, links: DataFrame, node: str, parent: str, paths: bool = False, block: int = BLOCK_LINKS) -> DataFrame:
    """``forest`` for a given set of nodes (column ``node``), roots and lone nodes included."""
    known = forest(links, node, parent, paths, block)
    all_nodes = nodes.select(F.col("node").cast("bigint")).na.drop().distinct()
    j = all_nodes.join(known, "node", "left")
    none = F.col("root").isNull()
    return j.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), *[F.when(none, F.array("node")).otherwise(F.col("path")).alias("path")] * paths)


def ancestors(links: DataFrame, node: str, parent: str, block: int = BLOCK_LINKS) -> DataFrame:
    """(node, above, far) of every node and what lies above it, cycles included; a node with several parents keeps the smallest."""
    one = cut(links.select(F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("up")).na.drop().groupBy("node").agg(F.min("up").alias("up")))
    tree = cut(forest(one, "node", "up", True, block))
    steps = tree.filter("not cyclic").select("node", "depth", F.posexplode("path").alias("pos", "above")).select("node", "above", (F.col("depth") - F.col("pos")).alias("far")).filter("far > 0")
    loops = around(one, tree)
    return steps if loops is None else steps.unionByName(loops)


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendant, distance): every node and what lies below it, from the paths; nodes into cycles have none here (``ancestors`` has them)."""
    steps = tree.filter("path is not null").select(F.col("node").alias("descendant"), F.col("depth").alias("far"), F.posexplode("path").alias("pos", "node"))
    return steps.filter(F.col("node") != F.col("descendant")).select("node", "descendant", (F.col("far") - F.col("pos")).cast("bigint").alias("distance"))


def _component(edges: DataFrame, ctype: str, layer: str) -> DataFrame:
    return edges.filter((F.col("ctype") == ctype) & (F.col("anno_layer") == layer) & (F.col("cname") == ""))


def corpus_hierarchies(corpora: DataFrame, texts: DataFrame, edges: DataFrame, paths: bool = False, block: int = BLOCK_LINKS) -> DataFrame:
    """(hier, node_key, root_id, depth[, path]) of corpora, texts and syntax nodes."""
    part, syntax = _component(edges, "PartOf", "annis"), _component(edges, "Dominance", "syntax")
    corpus_ids = corpora.select(F.col("corpus_id").alias("node"))
    tree = cut(hierarchy(corpus_ids, part, "source", "target", paths, block))
    ends = syntax.select(F.col("source").alias("node")).unionByName(syntax.select(F.col("target").alias("node")))
    words = hierarchy(ends, syntax, "target", "source", paths, block)
    keys = texts.select(F.col("corpus_ref").alias("node"), "text_id").na.drop().distinct()
    below = lookup_join(keys, tree, ["node"])
    text_key = F.concat(F.col("node").cast("string"), F.lit("/"), F.col("text_id").cast("string"))
    as_keys = [F.col("path").cast("array<string>").alias("path")] * paths

    def named(df: DataFrame, hier: str) -> DataFrame:
        return df.select(F.lit(hier).alias("hier"), F.col("node").cast("string").alias("node_key"), F.col("root").alias("root_id"), "depth", *as_keys)

    text = below.withColumn("key", text_key).select(
        F.lit("text").alias("hier"), F.col("key").alias("node_key"), F.col("root").alias("root_id"), F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("depth") + 1).cast("bigint").alias("depth"),
        *[F.when(~F.col("cyclic"), F.array_append(F.col("path").cast("array<string>"), F.col("key"))).alias("path")] * paths,
    )
    return named(tree, "corpus").unionByName(named(words, "syntax")).unionByName(text)


def corpus_descendants(corpora: DataFrame, texts: DataFrame, edges: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """(hier, node_key, descendant_key, distance): every corpus, text and syntax node below each other node, what lies on or below cycles included."""
    known = corpora.select(F.col("corpus_id").cast("bigint").alias("node")).na.drop().distinct()
    part = ancestors(_component(edges, "PartOf", "annis"), "source", "target", block).join(known, "node", "left_semi")
    syntax = ancestors(_component(edges, "Dominance", "syntax"), "target", "source", block)
    keys = lookup_join(texts.select(F.col("corpus_ref").alias("node"), "text_id").na.drop().distinct(), known, ["node"])
    above = part.unionByName(known.select("node", F.col("node").alias("above"), F.lit(0).cast("bigint").alias("far")))
    text = salted_join(keys, above, ["node"]).select(F.concat(F.col("node").cast("string"), F.lit("/"), F.col("text_id").cast("string")).alias("node"), "above", (F.col("far") + 1).alias("far"))
    out = None
    for hier, df in (("corpus", part), ("syntax", syntax), ("text", text)):
        one = df.select(F.lit(hier).alias("hier"), F.col("above").cast("string").alias("node_key"), F.col("node").cast("string").alias("descendant_key"), F.col("far").cast("bigint").alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out
