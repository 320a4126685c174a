"""python -m weftgraph DATA COMMAND ...: the store's verbs from a shell."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .aql.lexer import QueryError
from .session import local_session
from .store import CorpusStore


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("data", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, query: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if query:
            c.add_argument("-c", "--corpus", action="append", help="a corpus; may be given several times; default: all")
            c.add_argument("--quirks", action="store_true")
        for x in positional:
            c.add_argument(x)
        return c

    command("list")
    command("import", "path").add_argument("--name")
    command("export", "corpus", "path")
    command("delete", "corpus")
    command("info", "corpus")
    command("count", "query", query=True)
    find = command("find", "query", query=True)
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--limit", type=int)
    find.add_argument("--order", choices=("normal", "inverted", "random", "unsorted"), default="normal")
    command("frequency", "definitions", "query", query=True)
    command("plan", "query", query=True)
    command("validate", "query")
    command("script", "file")
    return p


def run(argv: Sequence[str], spark: SparkSession | None = None, out=None) -> int:
    """One command; 1 for a query that can't be understood or a corpus that isn't there."""
    a, out = arguments().parse_args(argv), out or sys.stdout
    store = CorpusStore(spark or local_session("*"), a.data)
    corpora = getattr(a, "corpus", None)
    if isinstance(corpora, list) or corpora is None:
        corpora = corpora or store.corpora()
    try:
        if a.command == "list":
            print(*store.corpora(), sep="\n", file=out)
        elif a.command == "import":
            names = store.import_from(a.path, corpus=a.name)
            print(*([names] if isinstance(names, str) else names), sep="\n", file=out)
        elif a.command == "export":
            store.export_to(a.corpus, a.path)
        elif a.command == "delete":
            return int(not store.delete(a.corpus))
        elif a.command == "info":
            for r in store.components(a.corpus).orderBy("ctype", "layer", "cname").collect():
                print(f"{r.ctype}/{r.layer}/{r.cname}: {r.n_edges} edges, {r.n_sources} sources, fan-out up to {r.max_fan_out}", file=out)
        elif a.command == "count":
            r = store.count_extra(corpora, a.query, a.quirks).first()
            print(f"{r.n_matches} matches in {r.n_documents} documents", file=out)
        elif a.command == "find":
            for r in store.find(corpora, a.query, a.offset, a.limit, a.order, a.quirks).toLocalIterator():
                print(r.match, file=out)
        elif a.command == "frequency":
            for r in store.frequency(corpora, a.query, a.definitions.split(","), a.quirks).toLocalIterator():
                print(*r, sep="\t", file=out)
        elif a.command == "plan":
            print(store.plan(corpora, a.query, a.quirks), file=out)
        elif a.command == "validate":
            print("valid" if store.validate(a.query) else "", file=out)
        elif a.command == "script":
            import shlex

            return max((run([a.data, *shlex.split(line)], spark, out) for line in Path(a.file).read_text().splitlines() if line.strip() and not line.startswith("#")), default=0)
    except (QueryError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
