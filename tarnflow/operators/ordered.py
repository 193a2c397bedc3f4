"""Running values over ordered rows that don't put a whole key into one task.

The order's first column is cut at quantiles into stretches of about CHUNK_ROWS rows. A window runs within
(keys, stretch) only; what came before a stretch is a running total over one row for each key and stretch. A key
that holds most rows is so spread over the stretches, also where its rows crowd into a short time. Rows that share one
value of the order's first column stay together. Of a table that Catalyst knows to be small, the window runs by key
alone, which saves the second read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch, on average; quantiles that stretches are cut at; bytes up to which a table is one stretch.
CHUNK_ROWS, QUANTILES, SMALL_BYTES = 1_000_000, 1024, 64 << 20
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """By Catalyst's own estimate, which for files is their size, so no row is read. A stream is never small."""
    if df.isStreaming:
        return False
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= (SMALL_BYTES if most is None else most)


def _bucket(value: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are at most the value: first among every 32nd of them, then among the 32 behind."""
    every = F.transform(F.sequence(F.lit(1), F.floor(F.size(cuts) / 32).cast("int")), lambda i: F.element_at(cuts, i * 32))
    coarse = F.size(F.filter(every, lambda c: c <= value))
    return coarse * 32 + F.size(F.filter(F.slice(cuts, coarse * 32 + 1, 32), lambda c: c <= value))


def with_stretch(df: DataFrame, at: str, rows: int | None = None, span: DataFrame | None = None) -> DataFrame:
    """Adds _stretch, which rises with the long column `at`; figures come from one scalar subquery over span, a table
    that df's rows are taken from (df itself if None)."""
    whole = df if span is None else span
    share = [i / QUANTILES for i in range(1, QUANTILES)]
    figures = whole.agg(F.struct(F.percentile_approx(at, share, 10 * QUANTILES).alias("cuts"), F.count(F.lit(1)).alias("n")).alias("f")).scalar()
    placed = df.withColumn("_figures", figures).withColumn("_bucket", _bucket(F.col(at), F.col("_figures.cuts")))
    stretches = F.greatest(F.lit(1), F.least(F.lit(QUANTILES), F.ceil(F.col("_figures.n") / F.lit(CHUNK_ROWS if rows is None else rows))))
    stretch = F.floor(F.col("_bucket") * stretches / QUANTILES)
    return placed.withColumn("_stretch", F.coalesce(stretch, F.lit(-1))).drop("_figures", "_bucket")


def _join_prior(local: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
    """Null keys are keys too."""
    renamed = prior.select(*[F.col(c).alias(f"_p_{c}") for c in on], *[c for c in prior.columns if c not in on])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in on])
    return local.join(renamed, same, "left").drop(*[f"_p_{c}" for c in on])


def running(df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, tuple[str, str]], before: bool = False, rows: int | None = None, span: DataFrame | None = None) -> DataFrame:
    """df with aggs (name -> (sum|count|min|max, column)) over the rows up to each, or before each one.

    Empty tables stay empty; null values count for nothing; null keys form a group; ties in the order are the
    caller's to avoid. span, if given, is a table with all of df's rows that is cheaper to count.
    """
    if rows is None and is_small(df):
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return df.select("*", *[_AGG[how](col).over(whole).alias(name) for name, (how, col) in aggs.items()])
    parts = with_stretch(df, order[0], rows, span)
    frame = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = parts
    for name, (how, col) in aggs.items():
        local = local.withColumn(name, _AGG[how](col).over(frame))
    totals = parts.groupBy(*keys, "_stretch").agg(*[_AGG[how](col).alias(name) for name, (how, col) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    prior = totals.select(*keys, "_stretch", *[again[how](name).over(earlier).alias(f"_before_{name}") for name, (how, _) in aggs.items()])
    out = _join_prior(local, prior, [*keys, "_stretch"])
    for name, (how, _) in aggs.items():
        out = out.withColumn(name, _combined(how, F.col(f"_before_{name}"), F.col(name)))
    return out.drop("_stretch", *[f"_before_{name}" for name in aggs])


def _combined(how: str, a: Column, b: Column) -> Column:
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(a, b)
    return F.coalesce(a + b, a, b)


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal", rows: int | None = None, span: DataFrame | None = None) -> DataFrame:
    """df with the row's place within its key, from 1."""
    return running(df.withColumn("_one", F.lit(1)), keys, order, {name: ("count", "_one")}, rows=rows, span=span).drop("_one")


def previous(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], rows: int | None = None, span: DataFrame | None = None) -> DataFrame:
    """df with columns of the row before each (name -> column) within its key; null where there is none.

    A stretch's first row takes them from the last row of the key's stretches before, one row for each key and stretch.
    """
    if rows is None and is_small(df):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(whole).alias(name) for name, c in cols.items()])
    parts = with_stretch(df, order[0], rows, span)
    within = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    local = parts.select("*", F.row_number().over(within).alias("_n"), *[F.lag(c).over(within).alias(name) for name, c in cols.items()])
    ends = parts.groupBy(*keys, "_stretch").agg(F.max_by(F.struct(*[F.col(c).alias(name) for name, c in cols.items()]), F.struct(*order)).alias("_end"))
    prior = ends.select(*keys, "_stretch", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_stretch")).alias("_end"))
    out = _join_prior(local, prior, [*keys, "_stretch"])
    for name in cols:
        out = out.withColumn(name, F.when(F.col("_n") == 1, F.col(f"_end.{name}")).otherwise(F.col(name)))
    return out.drop("_stretch", "_n", "_end")
