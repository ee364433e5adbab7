"""The four ways in which one payment is counted twice, and their removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order. Null keys form a group of their own; order must be total to be repeatable."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_tf_rank", rank).where("_tf_rank = 1").drop("_tf_rank")


def current_versions(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Amended transactions once: the highest amend_id of each (cmte_id, tran_id), else of each (filing_id, line_item).

    A row is attributable when cmte_id is not null and tran_id is not blank. Ties of
    amend_id are broken by filing_id, line_item and the columns in tie. One shuffle:
    both branches share a key that says which of them it is.
    """
    attributable = F.coalesce(F.col("cmte_id").isNotNull() & (F.trim("tran_id") != ""), F.lit(False))
    a = lambda c: F.when(attributable, F.col(c))
    b = lambda c: F.when(~attributable, F.col(c))
    key = [attributable, a("cmte_id"), a("tran_id"), b("filing_id"), b("line_item")]
    order = [F.col("amend_id").desc_nulls_first(), F.col("filing_id").asc_nulls_last(), F.col("line_item").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]]
    return latest_version(df, key, order)


def slot_versions(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The highest amend_id of each (filing_id, line_item), for tables without a committee."""
    return latest_version(df, ["filing_id", "line_item"], [F.col("amend_id").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in tie]])


def attributed_first(df: DataFrame, raw_committee: str, tie: Sequence[str] = ()) -> DataFrame:
    """One row of each (src, filing_id, line_item, tran_id): one with its own committee before one with a derived one."""
    own = F.coalesce(F.trim(F.col(raw_committee)) != "", F.lit(False))
    key = ["src", "filing_id", "line_item", F.coalesce("tran_id", F.lit(""))]
    return latest_version(df, key, [own.desc(), F.col("amend_id").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in tie]])


def keep_max_per_source(df: DataFrame, group: Sequence[str], source: str, order: Sequence[Column], null_groups: bool) -> DataFrame:
    """Of rows with equal group values as many as the source with the most of them has, first by order.

    A gift that two sources report counts once, two equal gifts in one source count
    twice. null_groups says whether rows with a null in group are grouped like any
    other (a null-safe join) or vanish (a plain join). All windows use one shuffle on
    group.
    """
    rows = df
    if not null_groups:
        for g in group:
            rows = rows.where(F.col(g).isNotNull())
    counted = rows.repartition(*group).withColumn("_tf_n", F.count(F.lit(1)).over(Window.partitionBy(*group, source)))
    counted = counted.withColumn("_tf_keep", F.max("_tf_n").over(Window.partitionBy(*group))).withColumn("_tf_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return counted.where("_tf_rank <= _tf_keep").drop("_tf_n", "_tf_keep", "_tf_rank")


def kept_counts(df: DataFrame, group: Sequence[str], source: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(*group, *extra, keep_n): the number of rows keep_max_per_source would keep, by two aggregations and without rows."""
    per = df.groupBy(*group, source).agg(F.count(F.lit(1)).alias("src_n"), *extra)
    names = [c for c in per.columns if c not in (*group, source, "src_n")]
    return per.groupBy(*group).agg(F.max("src_n").alias("keep_n"), *[F.max(c).alias(c) for c in names])
