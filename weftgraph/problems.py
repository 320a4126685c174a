"""Queries of the core data-processing operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hierarchy, records, references, terms, wide
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# 1. Rows that fail to parse

_FIELD = '("(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_U32 = "(regexp_full_match({0}, '[0-9]{{1,10}}') AND try_cast({0} AS UBIGINT) <= 4294967295)"
_NAME = "({0} IS NOT NULL AND NOT regexp_full_match({0}, '[ \\t]*') AND NOT regexp_matches({0}, '[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{{FFFD}}]'))"


def _is(form: str, k: int, null: bool = False) -> str:
    return f"({f'f[{k}] IS NULL OR ' if null else ''}coalesce({form.format(f'f[{k}]')}, false))"


_PARSED = f"""
WITH a AS (SELECT line_id, src_file, raw, regexp_full_match(raw, '{_FIELD}(\\t{_FIELD})*') AS ok FROM raw_lines),
b AS (SELECT *, list_transform(regexp_extract_all(chr(9) || raw, '\\t{_FIELD}', 1), lambda x: CASE WHEN x = 'NULL' THEN NULL WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM a),
c AS (SELECT line_id, src_file, f, CASE
  WHEN raw IS NULL THEN 'columns'
  WHEN NOT ok THEN 'quoting'
  WHEN NOT coalesce(src_file = 'text.annis' AND len(f) = 4 OR src_file = 'node.annis' AND len(f) = 14, false) THEN 'columns'
  WHEN src_file = 'text.annis' THEN CASE WHEN {_is(_U32, 1)} AND {_is(_U32, 2)} AND {_is(_NAME, 3)} AND f[4] IS NOT NULL AND NOT regexp_matches(f[4], '[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{{FFFD}}]') THEN NULL ELSE 'value' END
  WHEN {" AND ".join(_is(_U32, k) for k in (1, 2, 3, 6, 7, 9, 10))} AND {_is(_U32, 8, True)} AND {_is(_U32, 11, True)} AND {_is(_NAME, 5)}
    AND (f[12] IS NULL OR regexp_full_match(f[12], '[A-Za-z][A-Za-z0-9_-]*')) AND try_cast(f[6] AS UBIGINT) <= try_cast(f[7] AS UBIGINT) AND NOT (f[8] IS NULL AND f[11] IS NULL AND f[12] IS NOT NULL) THEN NULL
  ELSE 'value' END AS reason FROM b)
"""


@query(_PARSED + "SELECT line_id, reason FROM c WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(records.parse_lines(table(spark, d, "raw_lines"), wanted=())).distinct()


@query(_PARSED + "SELECT line_id, CAST(f[1] AS BIGINT) AS corpus_ref, CAST(f[2] AS BIGINT) AS text_id, f[3] AS text_name, f[4] AS val FROM c WHERE reason IS NULL AND src_file = 'text.annis'")
def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parse_lines(table(spark, d, "raw_lines"), wanted=["text.annis"]), "text.annis")


@query(
    _PARSED
    + "SELECT line_id, "
    + ", ".join(f"CAST(f[{i}] AS BIGINT) AS {n}" if t == "bigint" else f"f[{i}] AS {n}" for i, (n, t, _) in enumerate(records.NODE.fields, 1))
    + " FROM c WHERE reason IS NULL AND src_file = 'node.annis'"
)
def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parse_lines(table(spark, d, "raw_lines"), wanted=["node.annis"]), "node.annis")


# 2. Frequency of every distinct value

_VALUES = """
WITH k AS (SELECT DISTINCT anno_key, anno_ns, anno_name, val_type FROM anno_keys),
r AS (SELECT DISTINCT node_id, anno_key, val, corpus_ref FROM node_annos),
v AS (SELECT node_id, corpus_ref, anno_ns, anno_name, val_type, trim(nfc_normalize(val), ' ' || chr(9) || chr(160)) AS val FROM r JOIN k USING (anno_key)),
w AS (SELECT * FROM v WHERE val IS NOT NULL AND val NOT IN ('', 'NULL'))"""
_TERMS = (
    _VALUES
    + """,
t AS (SELECT anno_ns, anno_name, val, count(*) AS n_rows, count(DISTINCT corpus_ref) AS n_records FROM w GROUP BY ALL),
u AS (SELECT *, CAST(sum(n_rows) OVER (PARTITION BY anno_ns, anno_name) AS BIGINT) AS key_rows FROM t),
x AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_rows * 20 > key_rows THEN 'common' END AS band FROM u)
"""
)


@query(_TERMS + "SELECT anno_ns, anno_name, val, band FROM x WHERE band IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = terms.all_terms(table(spark, d, "node_annos"), table(spark, d, "anno_keys"))
    return found.filter(F.col("band").isNotNull()).select("anno_ns", "anno_name", "val", "band")


@query(_TERMS + "SELECT * FROM x")
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.all_terms(table(spark, d, "node_annos"), table(spark, d, "anno_keys"))


# 3. Hierarchies

_TREES = """
WITH RECURSIVE l AS (
  SELECT 'corpus' AS hier, source AS node, min(target) AS up FROM edges WHERE ctype = 'PartOf' AND anno_layer = 'annis' AND cname = '' AND source IS NOT NULL AND target IS NOT NULL GROUP BY source
  UNION ALL SELECT 'syntax', target, min(source) FROM edges WHERE ctype = 'Dominance' AND anno_layer = 'syntax' AND cname = '' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
n AS (SELECT DISTINCT 'corpus' AS hier, corpus_id AS node FROM corpora WHERE corpus_id IS NOT NULL
  UNION SELECT 'syntax', unnest([source, target]) FROM edges WHERE ctype = 'Dominance' AND anno_layer = 'syntax' AND cname = ''),
walk AS (
  SELECT hier, node, node AS cur, 0 AS depth, [node] AS seen, false AS looped FROM n WHERE node IS NOT NULL
  UNION ALL
  SELECT w.hier, w.node, l.up, w.depth + 1, list_prepend(l.up, w.seen), list_contains(w.seen, l.up) FROM walk w JOIN l ON l.hier = w.hier AND l.node = w.cur WHERE NOT w.looped),
e AS (SELECT w.* FROM walk w LEFT JOIN l ON l.hier = w.hier AND l.node = w.cur WHERE w.looped OR l.node IS NULL),
t AS (SELECT hier, node, looped, CASE WHEN looped THEN list_min(seen[1:list_position(seen[2:], seen[1])]) ELSE cur END AS root_id, CAST(CASE WHEN looped THEN -1 ELSE depth END AS BIGINT) AS depth, CASE WHEN NOT looped THEN list_transform(seen, lambda x: CAST(x AS VARCHAR)) END AS path FROM e),
k AS (SELECT DISTINCT corpus_ref, text_id FROM texts WHERE corpus_ref IS NOT NULL AND text_id IS NOT NULL),
f AS (SELECT hier, CAST(node AS VARCHAR) AS node_key, root_id, depth, path FROM t
  UNION ALL SELECT 'text', corpus_ref || '/' || text_id, root_id, CASE WHEN looped THEN -1 ELSE depth + 1 END, CASE WHEN NOT looped THEN list_append(path, corpus_ref || '/' || text_id) END FROM k JOIN t ON t.hier = 'corpus' AND t.node = k.corpus_ref)
"""


def _trees(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    return hierarchy.corpus_hierarchies(table(spark, d, "corpora"), table(spark, d, "texts"), table(spark, d, "edges"), paths)


@query(_TREES + "SELECT hier, node_key, root_id, depth FROM f")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, False)


@query(_TREES + "SELECT hier, node_key, array_to_string(path, ' ') AS path FROM f WHERE path IS NOT NULL")
def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, True).filter("path IS NOT NULL").select("hier", "node_key", F.array_join("path", " ").alias("path"))


@query(
    _TREES
    + """, u AS (SELECT hier, node, list_transform(CASE WHEN looped THEN seen[2:] ELSE seen END, lambda x: CAST(x AS VARCHAR)) AS up FROM e),
v AS (SELECT hier, CAST(node AS VARCHAR) AS descendant_key, up FROM u UNION ALL SELECT 'text', corpus_ref || '/' || text_id, list_append(up, corpus_ref || '/' || text_id) FROM k JOIN u ON u.hier = 'corpus' AND u.node = k.corpus_ref),
s AS (SELECT hier, descendant_key, unnest(up) AS node_key, len(up) - generate_subscripts(up, 1) AS distance FROM v) SELECT hier, node_key, descendant_key, distance FROM s WHERE distance > 0"""
)
def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """What lies on or below a cycle has its descendants too."""
    return hierarchy.corpus_descendants(table(spark, d, "corpora"), table(spark, d, "texts"), table(spark, d, "edges"))


# 4. References to records that don't exist

_ORPHANS = """
WITH r AS (
  SELECT DISTINCT 'texts' AS tab, 'corpus_ref' AS ref_field, corpus_ref AS a, NULL::BIGINT AS b, corpus_ref || '/' || coalesce(CAST(text_id AS VARCHAR), '') AS row_key, loaded_at AS t FROM texts WHERE corpus_ref IS NOT NULL
  UNION ALL SELECT DISTINCT 'nodes', 'corpus_ref', corpus_ref, NULL, CAST(node_id AS VARCHAR), loaded_at FROM nodes WHERE corpus_ref IS NOT NULL
  UNION ALL SELECT DISTINCT 'nodes', 'text_id', corpus_ref, text_id, CAST(node_id AS VARCHAR), loaded_at FROM nodes WHERE corpus_ref IS NOT NULL AND text_id IS NOT NULL),
g AS (
  SELECT 'corpus_ref' AS ref_field, corpus_id AS a, -1::BIGINT AS b, loaded_at AS s, deleted_at AS e FROM corpora
  UNION ALL SELECT 'text_id', corpus_ref, text_id, loaded_at, deleted_at FROM texts),
j AS (SELECT r.tab, r.ref_field, r.row_key, r.t, count(g.a) AS n, count(*) FILTER (g.s <= r.t AND (g.e IS NULL OR g.e > r.t)) AS live, min(g.s) AS first
  FROM r LEFT JOIN g ON g.ref_field = r.ref_field AND g.a = r.a AND g.b = coalesce(r.b, -1) GROUP BY ALL),
o AS (SELECT DISTINCT tab, ref_field, row_key, CASE WHEN n = 0 THEN 'missing' WHEN first > t THEN 'early' ELSE 'deleted' END AS cause, strftime(t, '%Y-%m') AS period FROM j WHERE live = 0)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.corpus_orphans(table(spark, d, "corpora"), table(spark, d, "texts"), table(spark, d, "nodes"))


@query(_ORPHANS + "SELECT * FROM o")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query(_ORPHANS + "SELECT tab, ref_field, cause, period, count(*) AS n FROM o GROUP BY ALL")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("tab", "ref_field", "cause", "period").agg(F.count(F.lit(1)).alias("n"))


# 5. Attribute-value rows into wide tables

_DATE = "CASE WHEN regexp_full_match(val, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN val WHEN regexp_full_match(val, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') THEN val[7:10] || '-' || val[4:5] || '-' || val[1:2] WHEN regexp_full_match(val, '[0-9]{8}') THEN val[1:4] || '-' || val[5:6] || '-' || val[7:8] END"
_CELLS = (
    _VALUES
    + f""",
c AS (SELECT *, CASE val_type
  WHEN 'integer' THEN CASE WHEN regexp_full_match(val, '[+-]?[0-9]{{1,9}}') THEN CAST(CAST(replace(val, '+', '') AS BIGINT) AS VARCHAR) END
  WHEN 'decimal' THEN CASE WHEN regexp_full_match(val, '[+-]?[0-9]+([.,][0-9]+)?') THEN CAST(CAST(replace(replace(val, '+', ''), ',', '.') AS DECIMAL(38, 15)) AS VARCHAR) END
  WHEN 'boolean' THEN CASE WHEN lower(val) IN ('true', 'yes', '1') THEN 'true' WHEN lower(val) IN ('false', 'no', '0') THEN 'false' END
  WHEN 'date' THEN CASE WHEN left({_DATE}, 4) <> '0000' THEN CAST(try_cast({_DATE} AS DATE) AS VARCHAR) END
  ELSE val END AS x FROM w),
g AS (SELECT node_id, anno_ns, anno_name, min(x) AS lo, max(x) AS hi FROM c GROUP BY ALL)
"""
)


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, wide.Attributes]:
    keys = wide.attributes(table(spark, d, "anno_keys"))
    return wide.sorted_run(wide.deltas(table(spark, d, "node_annos"), keys)), keys


@query(_CELLS + "SELECT node_id, anno_ns, anno_name FROM g WHERE lo IS NULL OR lo <> hi")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.conflicts(*_run(spark, d))


def _wide_sql() -> str:
    keys = [("", "comment", "string"), ("align", "speaker", "string"), ("align", "start_s", "decimal"), ("default_ns", "Inf-Struct", "string"), ("default_ns", "const", "string"), ("grammar", "lemma", "string"), ("grammar", "norm", "string"), ("morph", "feats", "string"), ("morph", "freq_rank", "integer"), ("morph", "syllables", "integer"), ("review", "checked", "boolean"), ("review", "checked_on", "date"), ("review", "confidence", "decimal"), ("review", "revised_on", "date"), ("salt", "lemma", "string"), ("salt", "pos", "string"), ("structure", "line", "integer"), ("structure", "page", "integer"), ("structure", "rend", "string"), ("syntax", "cat", "string"), ("syntax", "head_final", "boolean")]
    cast = {"integer": "CAST({} AS INTEGER)", "boolean": "CAST({} AS BOOLEAN)", "date": "CAST({} AS DATE)", "string": "{}", "decimal": "CAST(CAST({} AS DECIMAL(38, 10)) AS VARCHAR)"}
    cell = "max(hi) FILTER (anno_ns = '{}' AND anno_name = '{}' AND lo = hi)"
    return _CELLS + "SELECT node_id, " + ", ".join(f'{cast[t].format(cell.format(n, k))} AS "{wide.column_name(n, k)}"' for n, k, t in keys) + " FROM g GROUP BY node_id"


@query(_wide_sql())
def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    out = wide.widen(*_run(spark, d))
    return out.withColumns({c: F.col(f"`{c}`").cast("string") for c, t in out.dtypes if t.startswith("decimal")})


__all__ = ["QUERIES", "SQL"]
