"""Corpora on disk, and the verbs over one or several of them.

Each corpus is a folder of Parquet tables, on any file system Spark can write
to, in numbered versions, of which the
file ``CURRENT`` names the valid one: a new version is written whole before
it is named, so readers never see half of one. Positions, spans and coverage
are stored with it, edges by component type.
"""

from __future__ import annotations

import json
import shutil
import threading
import urllib.parse
import uuid
import zipfile
from dataclasses import dataclass, field, replace
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aql.analyze import node_descriptions, parse
from .functions.files import Files
from .plans import execute as run
from .plans import subgraph
from .plans.graph import SCHEMAS, Graph, united
from .plans.index import hints, indexed
from .sources.graphml import export_graphml, import_graphml
from .sources.relannis import import_relannis
from .session import checkpoint_dir
from .sources.updates import apply_updates

_STORED = ("node", "anno", "edge", "edge_anno", "tok_pos", "span", "coverage")
_PARTITIONS = {"edge": ["ctype"], "edge_anno": ["ctype"], "anno": ["ns", "name"]}


@dataclass
class CorpusStore:
    """``verbs(corpora, query, ...)`` give DataFrames; nothing is loaded before it is needed."""

    spark: SparkSession
    path: str
    cached: dict[str, Graph] = field(default_factory=dict)

    def __post_init__(self):
        self.files = Files(self.spark, self.path)

    def _folder(self, corpus: str) -> str:
        return self.files.at(urllib.parse.quote(corpus, safe=""))

    def _version(self, corpus: str) -> int:
        """The valid version, 0 if there is none."""
        current = f"{self._folder(corpus)}/CURRENT"
        return int(self.files.read(current)) if self.files.exists(current) else 0

    def corpora(self) -> list[str]:
        return sorted(c for c in map(urllib.parse.unquote, self.files.names(self.files.root)) if self._version(c))

    def save(self, corpus: str, graph: Graph) -> None:
        """Writes the part of ``graph`` that belongs to ``corpus`` as its new version and drops older ones."""
        folder, old = self._folder(corpus), self._version(corpus)
        new = f"{folder}/{old + 1}"
        self.files.delete(new)
        for t in _STORED:
            df = getattr(graph, t).filter(F.col("corpus") == corpus)
            # partition values can't be empty texts, so they are stored with a mark
            df = df.withColumns({c: F.concat(F.lit("="), F.col(c)) for c in _PARTITIONS.get(t, [])})
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*_PARTITIONS[t]) if t in _PARTITIONS else writer).parquet(f"{new}/{t}")
        self.files.write(f"{new}/hints.json", json.dumps(hints(self._read_version(new))))
        self.files.write(f"{folder}/CURRENT", str(old + 1))
        self.cached.pop(corpus, None)
        for name in self.files.names(folder):
            if name.isdigit() and int(name) < old:
                self.files.delete(f"{folder}/{name}")

    def graph(self, corpora: str | list[str]) -> Graph:
        """One graph over the named corpora."""
        names = [corpora] if isinstance(corpora, str) else list(corpora)
        one = [self._graph(n) for n in sorted(set(names))]
        if not one:
            raise KeyError("no corpus named")
        return united(one)

    def _graph(self, corpus: str) -> Graph:
        if corpus not in self.cached:
            version = self._version(corpus)
            if not version:
                raise KeyError(corpus)
            at = f"{self._folder(corpus)}/{version}"
            graph = self._read_version(at)
            if self.files.exists(f"{at}/hints.json"):
                graph = replace(graph, **json.loads(self.files.read(f"{at}/hints.json")))
            self.cached[corpus] = graph
        return self.cached[corpus]

    def _read_version(self, at: str) -> Graph:
        def read(t: str) -> DataFrame:
            cols = SCHEMAS[t].split(", ")
            parts = _PARTITIONS.get(t, [])
            schema = ", ".join([c for c in cols if c.split()[0] not in parts] + [f"{c} string" for c in parts])
            return self.spark.read.schema(schema).parquet(f"{at}/{t}").withColumns({c: F.substring(F.col(c), 2, 1 << 30) for c in parts}).select(*[c.split()[0] for c in cols])

        return Graph(*(read(t) for t in _STORED[:4]), {t: (lambda t=t: read(t)) for t in _STORED[4:]})

    def create(self, corpus: str) -> bool:
        """An empty corpus; False if there is one of that name."""
        if corpus in self.corpora():
            return False
        self.save(corpus, indexed(Graph(*(self.spark.createDataFrame([], SCHEMAS[t]) for t in _STORED[:4]))))
        return True

    def delete(self, corpus: str) -> bool:
        self.unload(corpus)
        folder = self._folder(corpus)
        if not self.files.exists(folder):
            return False
        self.files.delete(folder)
        return True

    def reoptimize(self, corpus: str) -> None:
        """Writes a corpus anew, with its derived tables built again."""
        g = self._graph(corpus)
        self.save(corpus, indexed(Graph(g.node, g.anno, g.edge, g.edge_anno)))

    def info(self, corpus: str) -> DataFrame:
        """(what, name, n): the rows of each table and the edges of each component."""
        g = self._graph(corpus)
        out = subgraph.components(g).select(F.lit("component").alias("what"), F.concat_ws("/", "ctype", "layer", "cname").alias("name"), F.col("n_edges").alias("n"))
        for t in _STORED:
            out = out.unionByName(getattr(g, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("what"), F.lit(t).alias("name"), "n"))
        return out

    def configuration(self, corpus: str) -> str:
        """The corpus configuration (TOML) as it was stored; empty if there is none."""
        at = f"{self._folder(corpus)}/corpus-config.toml"
        return self.files.read(at) if self.files.exists(at) else ""

    def configure(self, corpus: str, text: str) -> None:
        if not self._version(corpus):
            raise KeyError(corpus)
        self.files.write(f"{self._folder(corpus)}/corpus-config.toml", text)

    def preload(self, corpus: str) -> None:
        g = self._graph(corpus)
        for t in _STORED:
            getattr(g, t).cache()

    def unload(self, corpus: str) -> None:
        if g := self.cached.pop(corpus, None):
            for t in _STORED:
                getattr(g, t).unpersist()

    def import_from(self, path: str, form: str | None = None, corpus: str | None = None) -> str | list[str]:
        """Takes in a GraphML file, a relANNIS directory, or a ZIP file with any number of them.

        Gives the corpus name, or the list of names if a ZIP file holds several.
        """
        files = Files(self.spark, path)
        if path.endswith(".zip"):
            unpacked = Files(self.spark, f"{checkpoint_dir(self.spark)}/unpacked-{uuid.uuid4().hex}")
            with files.open(path) as f, zipfile.ZipFile(f) as z:
                names = [n for n in z.namelist() if not n.endswith("/") and not PurePosixPath(n).is_absolute() and ".." not in PurePosixPath(n).parts]
                for n in names:
                    with z.open(n) as a, unpacked.create(unpacked.at(n)) as b:
                        shutil.copyfileobj(a, b, 1 << 20)
            folders = sorted({str(PurePosixPath(n).parent) for n in names if PurePosixPath(n).name in ("corpus.annis", "corpus.tab")})
            inner = [("relannis", unpacked.at(p) if p != "." else unpacked.root) for p in folders] + [("graphml", unpacked.at(n)) for n in sorted(names) if n.lower().endswith(".graphml")]
            inner = [(kind, p) for kind, p in inner if form in (None, kind)]
            if not inner:
                raise ValueError(f"{path} holds no corpus")
            if corpus is not None and len(inner) > 1:
                raise ValueError(f"{path} holds {len(inner)} corpora, which can't all be named {corpus}")
            graphs = [self._read(p, kind, corpus) for kind, p in inner]
            found = [name for name, _ in graphs]
            if len(set(found)) < len(found):
                raise ValueError(f"{path} holds several corpora of one name: {', '.join(found)}")
            for (kind, p), (name, graph) in zip(inner, graphs):
                self._take_in(p, kind, name, graph)
            unpacked.delete(unpacked.root)
            return found[0] if len(found) == 1 else found
        form = form or ("graphml" if path.endswith(".graphml") else "relannis")
        name, graph = self._read(path, form, corpus)
        self._take_in(path, form, name, graph)
        return name

    def _read(self, path: str, form: str, corpus: str | None) -> tuple[str, Graph]:
        graph = import_graphml(self.spark, path, corpus) if form == "graphml" else import_relannis(self.spark, path, corpus)
        return graph.node.first()["corpus"], graph

    def _take_in(self, path: str, form: str, name: str, graph: Graph) -> None:
        """Saves a corpus that was read, and its linked files."""
        self.save(name, graph)
        files = Files(self.spark, path)
        base = path.rpartition("/")[0] if form == "graphml" else path
        for rel in self._file_names(name):
            if files.exists(source := f"{base}/{rel}"):
                files.copy(source, f"{self._folder(name)}/files/{rel}")

    def _file_names(self, corpus: str) -> list[str]:
        own = self.graph(corpus).anno.filter((F.col("ns") == "annis") & (F.col("name") == "file")).select("value").distinct()
        return [r.value for r in own.toLocalIterator() if not PurePosixPath(r.value).is_absolute() and ".." not in PurePosixPath(r.value).parts]

    def linked_files(self, corpus: str) -> dict[str, Path | str]:
        """Files that nodes link to by annis::file, and where the store keeps them (a Path on this machine)."""
        at = f"{self._folder(corpus)}/files"
        found = {rel: f"{at}/{rel}" for rel in self._file_names(corpus) if self.files.exists(f"{at}/{rel}")}
        return {rel: p if "://" in p else Path(p) for rel, p in found.items()}

    def export_to(self, corpus: str, path: str, stable: bool = True) -> None:
        """Writes GraphML, in a ZIP file if the path says so."""
        config = self.configuration(corpus) or None
        if not path.endswith(".zip"):
            return export_graphml(self.graph(corpus), path, stable, config)
        with Files(self.spark, path).create(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open(f"{urllib.parse.quote(corpus, safe='')}.graphml", "w", force_zip64=True) as entry:
                export_graphml(self.graph(corpus), path, stable, config, entry)
            for rel, file in self.linked_files(corpus).items():
                with self.files.open(str(file)) as a, z.open(rel, "w", force_zip64=True) as b:
                    shutil.copyfileobj(a, b, 1 << 20)

    def apply_updates(self, corpus: str, events: DataFrame) -> None:
        """Applies update events and stores the outcome; the corpus is created if need be."""
        self.create(corpus)
        self.save(corpus, apply_updates(self.graph(corpus), events, corpus))

    def count(self, corpora, query: str, quirks: bool = False) -> DataFrame:
        return run.count(self.graph(corpora), query, quirks)

    def count_extra(self, corpora, query: str, quirks: bool = False) -> DataFrame:
        return run.count_extra(self.graph(corpora), query, quirks)

    def find(self, corpora, query: str, offset: int = 0, limit: int | None = None, order: str = "normal", quirks: bool = False) -> DataFrame:
        return run.find(self.graph(corpora), query, offset, limit, order, quirks)

    def frequency(self, corpora, query: str, definitions: list[str], quirks: bool = False) -> DataFrame:
        """``definitions`` are texts like ``1:ns::name``."""
        parts = []
        for d in definitions:
            node, _, key = d.partition(":")
            ns, sep, name = key.partition("::")
            parts.append((int(node), ns if sep else None, name if sep else ns))
        return run.frequency(self.graph(corpora), query, parts, quirks)

    def subgraph(self, corpora, query: str, left: int = 0, right: int = 0, seg: str | None = None) -> Graph:
        g = self.graph(corpora)
        return subgraph.context(g, run.execute(g, query), left, right, seg)

    def subgraph_of_nodes(self, corpora, names: list[str], left: int = 0, right: int = 0, seg: str | None = None) -> Graph:
        g = self.graph(corpora)
        nodes = g.node.filter(F.col("node_name").isin(names)).select("corpus", F.col("node_id").alias("m1"))
        return subgraph.context(g, nodes, left, right, seg)

    def subgraph_for_query(self, corpora, query: str, ctypes: list[str] | None = None) -> Graph:
        return subgraph.for_query(self.graph(corpora), query, ctypes)

    def subcorpus_graph(self, corpora, names: list[str]) -> Graph:
        return subgraph.subcorpus(self.graph(corpora), names)

    def corpus_graph(self, corpora) -> Graph:
        return subgraph.corpora(self.graph(corpora))

    def components(self, corpora) -> DataFrame:
        return subgraph.components(self.graph(corpora))

    def node_annotations(self, corpora, only_most_frequent: bool = False) -> DataFrame:
        return subgraph.node_values(self.graph(corpora), only_most_frequent)

    def validate(self, query: str, quirks: bool = False) -> bool:
        parse(query, quirks)
        return True

    def node_descriptions(self, query: str, quirks: bool = False) -> list[dict]:
        return node_descriptions(query, quirks)

    def plan(self, corpora, query: str, quirks: bool = False) -> str:
        df = run.execute(self.graph(corpora), query, quirks)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def with_timeout(self, df: DataFrame, seconds: float) -> list:
        """Collects ``df``; after that time its jobs are cancelled, also those that begin only then, and TimeoutError is raised."""
        tag, late, done = f"weftgraph-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        sc = self.spark.sparkContext

        def watch() -> None:
            if not done.wait(seconds):
                late.set()
                while not done.wait(0.1):
                    sc.cancelJobsWithTag(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        watcher.start()
        try:
            rows = df.collect()
        except Exception as e:
            raise TimeoutError(f"no result after {seconds} s") if late.is_set() else e
        finally:
            done.set()
            watcher.join()
            sc.setInterruptOnCancel(False)
            sc.removeJobTag(tag)
        if late.is_set():
            raise TimeoutError(f"no result after {seconds} s")
        return rows
