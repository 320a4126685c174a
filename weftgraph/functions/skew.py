"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot. Every further key then holds less than a thousandth of the rows.
MAX_HOT = 1000
#: A key is hot from this number of rows.
HOT_ROWS = 100_000
#: A side is broadcast if it was counted to at most so many rows.
BROADCAST_ROWS = 100_000
#: Hot rows are spread over so many buckets.
SALTS = 64


def key_hash(on: Sequence[str]) -> Column:
    """A hash of the key's written form, the same on both sides of a join whatever their integer types."""
    return F.xxhash64(*[F.col(c).cast("string") for c in on])


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys of ``df`` with over ``hot_rows`` rows, the largest first, at most MAX_HOT of them.

    Counted with map-side combination, so the hot keys themselves cost one row
    a task. A key that shares a hash with a hot one is only spread as well.
    """
    counts = df.select(*on).na.drop().groupBy(key_hash(on).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return [r._h for r in counts.filter(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(MAX_HOT).collect()]


def is_hot(on: Sequence[str], hot: list[int]) -> Column:
    return key_hash(on).isin(hot)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", extra: Column | None = None, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``left`` join ``right`` on equal ``on``, the rows of hot left keys spread over ``salts`` buckets.

    Right rows of a hot key are repeated in each bucket. Left rows with a null
    in a key can't match; they are spread too, else they'd meet in one task.
    ``how`` is inner, left, left_semi or left_anti; ``extra`` is a further
    condition over columns whose names differ between both sides.
    """
    on = list(on)
    hot = hot_keys(left, on, hot_rows)
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    alone = how in ("left", "left_anti")
    lhs = left.withColumn("_salt", F.when(is_hot(on, hot) | null if hot else null, spread).otherwise(0)) if alone or hot else left.withColumn("_salt", F.lit(0))
    names = {c: f"_r_{c}" for c in on}
    rhs = right.withColumnsRenamed(names)
    if hot:
        rhs = rhs.withColumn("_rsalt", F.explode(F.when(is_hot([names[c] for c in on], hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    else:
        rhs = rhs.withColumn("_rsalt", F.lit(0))
    cond = F.col("_salt") == F.col("_rsalt")
    for c in on:
        cond = cond & (F.col(c) == F.col(names[c]))
    if extra is not None:
        cond = cond & extra
    return lhs.join(rhs, cond, how).drop("_salt", "_rsalt", *names.values())


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, rows: int | None = None, extra: Column | None = None) -> DataFrame:
    """Join with a right side that is broadcast only if it has been counted to at most ``max_rows`` rows, else salted."""
    on = list(on)
    n = right.limit(max_rows + 1).count() if rows is None else rows
    if n > max_rows:
        return salted_join(left, right, on, how, extra)
    names = {c: f"_r_{c}" for c in on}
    rhs = F.broadcast(right.withColumnsRenamed(names))
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(c) == F.col(names[c]))
    if extra is not None:
        cond = cond & extra
    return left.join(rhs, cond, how).drop(*names.values())
