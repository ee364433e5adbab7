"""Questions on targeted expenditures by race, candidate and spender, and on entities that file in several places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.dedup import latest_version
from tallyforge.plans.tools import money, phase

SIDES = {"for": "S", "against": "O"}


def of_race(ie: DataFrame, state: str | None = None, district: str | None = None, cycle: int | None = None, election_type: str | None = None, candidate: str | None = None) -> DataFrame:
    """The resolved expenditures of a state, district, cycle, election phase or candidate; None means any."""
    rows = ie.where(phase(election_type))
    for column, value in (("office_state", state), ("office_district", district), ("election_year", cycle), ("resolved_candidate_id", candidate)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def side_name() -> Column:
    return F.when(F.col("support_oppose") == "S", "for").when(F.col("support_oppose") == "O", "against").otherwise("unknown")


def top_spenders(ie: DataFrame, side: str, committees: DataFrame, limit: int = 5) -> DataFrame:
    """(spender_id, spender_name, ies, total): the greatest spenders "for" or "against"; committees is (spender_id, committee), one row each."""
    if side.strip().lower() not in SIDES:
        raise ValueError("side must be for or against")
    rows = ie.where(F.col("support_oppose") == SIDES[side.strip().lower()]).groupBy("spender_id").agg(F.count(F.lit(1)).alias("ies"), money(F.sum("expenditure_amount")).alias("total"))
    top = rows.orderBy(F.col("total").desc(), F.col("spender_id").asc_nulls_last()).limit(limit)
    return top.join(committees, "spender_id", "left").select("spender_id", F.coalesce("committee", "spender_id").alias("spender_name"), "ies", "total")


def spender_breakdown(ie: DataFrame, limit: int = 50) -> DataFrame:
    """(face, value, name, side, records, total): one spender's money in all, by payee, by purpose and by target and side, in one scan; the ``limit`` greatest of each face."""
    none = F.lit(None).cast("string")
    face = lambda f, v, n, s: F.struct(F.lit(f).alias("face"), v.alias("value"), n.alias("name"), s.alias("side"))
    faces = F.explode(F.array(face("total", none, none, none), face("payee", F.col("payee"), none, none), face("purpose", F.col("purpose"), none, none), face("target", F.col("resolved_candidate_id"), F.col("resolved_candidate_name"), side_name())))
    rows = ie.select("expenditure_amount", faces.alias("x"))
    sums = rows.groupBy("x.face", "x.value", "x.side").agg(F.max("x.name").alias("name"), F.count(F.lit(1)).alias("records"), money(F.sum("expenditure_amount")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("face").orderBy(F.col("total").desc(), F.col("value").asc_nulls_last(), F.col("side").asc_nulls_last()))
    return sums.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def race_candidates(ie: DataFrame, limit: int = 50) -> DataFrame:
    """(candidate_id, candidate_name, for and against, race_for, race_against): the race's totals are those of the rows returned."""
    side = lambda s: F.col("support_oppose") == s
    sums = [money(F.sum(F.when(side(s), F.col("expenditure_amount")))).alias(f"{n}_total") for n, s in SIDES.items()] + [F.sum(F.when(side(s), 1).otherwise(0)).alias(f"{n}_count") for n, s in SIDES.items()]
    rows = ie.where("resolved_candidate_id is not null").groupBy(F.col("resolved_candidate_id").alias("candidate_id")).agg(F.max("resolved_candidate_name").alias("candidate_name"), *sums)
    top = rows.orderBy((F.col("for_total") + F.col("against_total")).desc(), "candidate_id").limit(limit)
    all_rows = Window.partitionBy()  # of the limited rows
    return top.withColumns({f"race_{n}": F.round(F.sum(f"{n}_total").over(all_rows), 2) for n in SIDES})


def spending_by_org(ie: DataFrame, committees: DataFrame, least: float = 100_000.0, limit: int = 200) -> DataFrame:
    """(spender_id, org, candidate_id, candidate, side, purpose, amount, ie_count) of spender, candidate and side with more than ``least``."""
    rows = ie.where("resolved_candidate_id is not null").groupBy("spender_id", F.col("resolved_candidate_id").alias("candidate_id"), "support_oppose")
    sums = rows.agg(F.coalesce(F.max("resolved_candidate_name"), F.max("resolved_candidate_id")).alias("candidate"), money(F.sum("expenditure_amount")).alias("amount"), F.count(F.lit(1)).alias("ie_count")).where(F.col("amount") > least)
    top = sums.orderBy(F.col("amount").desc(), "spender_id", "candidate_id", "support_oppose").limit(limit).withColumn("side", side_name())
    wording = F.when(F.col("side") == "for", "in support of ").when(F.col("side") == "against", "in opposition to ").otherwise("unknown regarding ")
    return top.join(committees, "spender_id", "left").select("spender_id", F.coalesce("committee", "spender_id").alias("org"), "candidate_id", "candidate", "side", F.concat(wording, "candidate").alias("purpose"), "amount", "ie_count")


def by_source_and_year(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(source, year, records, total) of parts (source, rows with date and amount)."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(source).alias("source"), F.year("date").alias("year"), "amount") for source, df in parts])
    return rows.groupBy("source", "year").agg(F.count(F.lit(1)).alias("records"), money(F.sum("amount")).alias("total"))


def greatest_partners(parts: list[tuple[str, DataFrame]], least: float | None = None, limit: int = 200) -> DataFrame:
    """(source, name, side, records, amount): whom most money came from or went to, of parts (source, rows with name, side and amount).

    Each source gives its ``limit`` greatest; the greatest of all are returned.
    """
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(source).alias("source"), "name", "side", "amount") for source, df in parts])
    sums = rows.groupBy("source", "name", "side").agg(F.count(F.lit(1)).alias("records"), money(F.sum("amount")).alias("amount"))
    if least is not None:
        sums = sums.where(F.col("amount") >= least)
    return sums.orderBy(F.col("amount").desc(), "source", "name", F.col("side").asc_nulls_last()).limit(limit)


def contributions_union(*tables: DataFrame) -> DataFrame:
    """(date, amount, name, side) of federal contribution tables below each other; a gift without a name has its committee's."""
    name = F.coalesce(F.when(F.col("contributor_name") != "", F.col("contributor_name")), "other_committee_id", F.lit("UNKNOWN"))
    return reduce(DataFrame.unionByName, [t.select(F.col("contribution_date").alias("date"), F.col("contribution_amount").alias("amount"), name.alias("name"), F.lit(None).cast("string").alias("side")) for t in tables])


def spending_union(targeted: DataFrame, older: DataFrame, tie: str) -> DataFrame:
    """(date, amount, name, side) of resolved targeted expenditures and of older ones, of which each transaction's greatest amount counts."""
    unnamed = F.lit("(candidate not captured)")
    once = latest_version(older, ["spender_id", "transaction_id"], [F.col("expenditure_amount").desc_nulls_first(), F.col(tie)])
    cols = lambda df, name: df.select(F.col("expenditure_date").alias("date"), F.col("expenditure_amount").alias("amount"), name.alias("name"), side_name().alias("side"))
    return cols(targeted, F.col("resolved_candidate_name")).unionByName(cols(once, F.coalesce(F.when(F.col("candidate_name") != "", F.col("candidate_name")), unnamed)))
