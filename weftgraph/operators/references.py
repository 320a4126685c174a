"""References to rows that don't exist, or not at that time.

References are grouped by which of their key columns are null (the null mask),
and each mask is joined to the targets on its other columns only, as the
declared match semantics wants:

- ``simple``: a reference with a null in its key isn't checked;
- ``partial``: it must agree with some target on the columns that aren't null;
- ``full``: a reference with some, but not all, columns null is an orphan at once.

A reference of which all columns are null is never checked.

A target is live from its start (inclusive) to its end (exclusive, null for
ever); a reference is an orphan if no row of its target is live at its time.
The cause is ``missing`` (no row has the key), ``early`` (all begin after the
reference) or ``deleted``.

References of one hot key are split by adaptive execution, which may split the
left side of an anti join and of a left join: each join here reads its sides
straight from a shuffle and the next step needs no order of theirs, so nothing
forbids it. Hot target keys are cut into months: intervals that cover a whole
month become equal and collapse before the shuffle, and a reference meets only
those of its month.

Defined cases: a target with a null start is never live, one that ends before
it starts neither; a reference with a null time is an orphan, ``missing`` or
``deleted``; repeated rows come out once; empty targets make all references
``missing``; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_keys, is_hot

#: From this number of different intervals a target key is cut into months.
HOT_INTERVALS = 1000


def _all(cols: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def _mask(cols: Sequence[str], nulls: Sequence[bool]) -> Column:
    return _all([F.col(c).isNull() if n else F.col(c).isNotNull() for c, n in zip(cols, nulls)])


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def orphans(refs: DataFrame, targets: DataFrame, on: Sequence[tuple[str, str]], row_key: Column, at: str, start: str, end: str, match: str = "simple", hot_intervals: int = HOT_INTERVALS) -> DataFrame:
    """(row_key, at, cause) of each reference without a live target; ``on`` holds pairs of reference and target column."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match semantics {match!r}")
    left = refs.select(*(F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(on)), row_key.alias("row_key"), F.col(at).alias("at"))
    right = targets.select(*(F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)), F.col(start).alias("start"), F.col(end).alias("end"))
    keys = [f"k{i}" for i in range(len(on))]
    out = None
    for nulls in product((False, True), repeat=len(keys)):
        if all(nulls) or any(nulls) and match == "simple":
            continue
        mine = left.filter(_mask(keys, nulls))
        if any(nulls) and match == "full":
            found = mine.select("row_key", "at", F.lit("missing").alias("cause")).distinct()
        else:
            cols = [k for k, n in zip(keys, nulls) if not n]
            found = _without_live(mine.select(*cols, "row_key", "at"), right.select(*cols, "start", "end").na.drop(subset=cols), cols, hot_intervals)
        out = found if out is None else out.unionByName(found)
    return out


def _without_live(refs: DataFrame, targets: DataFrame, keys: list[str], hot_intervals: int) -> DataFrame:
    real = targets.filter(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    live = (F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("end") > F.col("at")))
    hot = hot_keys(real, keys, hot_intervals)
    on = keys
    if hot:
        real, refs = _by_month(real.distinct(), refs, keys, hot)
        on = [*keys, "month"]
    real = real.withColumnsRenamed({c: f"_{c}" for c in on})
    dead = refs.join(real, _all([F.col(c) == F.col(f"_{c}") for c in on]) & live, "left_anti").select(*keys, "row_key", "at").distinct()
    known = targets.groupBy(*keys).agg(F.min("start").alias("first"), F.lit(True).alias("known"))
    cause = F.when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("at"), "early").otherwise("deleted")
    return dead.join(known, keys, "left").select("row_key", "at", cause.alias("cause"))


def _by_month(real: DataFrame, refs: DataFrame, keys: list[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    cut_up = is_hot(keys, hot)
    span = refs.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(_month(F.col("lo")).alias("lo"), _month(F.col("hi")).alias("hi")).first()
    lo, hi = (span.lo or 0, span.hi or 0)
    first, last = F.greatest(_month(F.col("start")), F.lit(lo)), F.least(F.coalesce(_month(F.col("end")), F.lit(hi)), F.lit(hi))
    months = F.when(cut_up, F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(-1)))
    month_start = F.make_timestamp(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz")
    next_start = month_start + F.make_ym_interval(F.lit(0), F.lit(1))
    cutting = F.col("month") >= 0
    kind = dict(real.dtypes)["start"]
    real = real.withColumn("month", F.explode(months)).select(
        *keys,
        "month",
        F.when(cutting & (F.col("start") < month_start.cast(kind)), month_start.cast(kind)).otherwise(F.col("start")).alias("start"),
        F.when(cutting & (F.col("end").isNull() | (F.col("end") > next_start.cast(kind))), next_start.cast(kind)).otherwise(F.col("end")).alias("end"),
    )
    return real.dropDuplicates(), refs.withColumn("month", F.when(cut_up, _month(F.col("at"))).otherwise(F.lit(-1)))


def corpus_orphans(corpora: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The orphan references of texts and nodes, by table, field and month."""
    text_key = F.concat(F.col("corpus_ref").cast("string"), F.lit("/"), F.coalesce(F.col("text_id").cast("string"), F.lit("")))
    node_key = F.col("node_id").cast("string")

    def keyed(df: DataFrame, tab: str, key: Column, *cols: str) -> DataFrame:
        return df.select(*cols, "loaded_at", F.struct(F.lit(tab).alias("tab"), key.alias("row_key")).alias("row"))

    life = ("loaded_at", "loaded_at", "deleted_at")
    to_corpora = keyed(texts, "texts", text_key, "corpus_ref").unionByName(keyed(nodes, "nodes", node_key, "corpus_ref"))
    parts = [
        ("corpus_ref", orphans(to_corpora, corpora, [("corpus_ref", "corpus_id")], F.col("row"), *life)),
        ("text_id", orphans(keyed(nodes, "nodes", node_key, "corpus_ref", "text_id"), texts, [("corpus_ref", "corpus_ref"), ("text_id", "text_id")], F.col("row"), *life)),
    ]
    a, b = (df.select("row_key.tab", F.lit(field).alias("ref_field"), "row_key.row_key", "cause", F.date_format("at", "yyyy-MM").alias("period")) for field, df in parts)
    return a.unionByName(b).distinct()
