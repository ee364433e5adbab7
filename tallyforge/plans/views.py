"""The normalised views: every payment once, with donor, payee and committee worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import canonical_name, joined_name
from tallyforge.operators.dedup import attributed_first, current_versions, keep_max_per_source, latest_version, slot_versions

#: Order of the receipt sources when one gift stands in several.
RECEIPT_SOURCES = ["rcpt_cd", "s497_cd", "s498_cd"]
#: Order of the report forms when one expenditure stands in several.
IE_FORMS = ["F3X", "F5", "F24"]
#: base table -> deduplicated view; tables without a committee are deduplicated by slot only.
DEDUP_VIEWS = {t: f"{t}_deduped" for t in ("expn_cd", "rcpt_cd", "s497_cd", "s498_cd", "loan_cd", "debt_cd", "lexp_cd", "s496_cd", "splt_cd", "text_memo_cd")}
SLOT_ONLY = {"lexp_cd", "s496_cd", "splt_cd", "text_memo_cd"}


def deduped(df: DataFrame, table_name: str, tie: list[str] = ()) -> DataFrame:
    return slot_versions(df, tie) if table_name in SLOT_ONLY else current_versions(df, tie)


def rank_in(c: Column, values: list[str]) -> Column:
    r = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        r = F.when(c == v, i).otherwise(r)
    return r


def filing_filer(filer_filings: DataFrame) -> DataFrame:
    """(filing_id, filer_id): the smallest filer of each filing, as text."""
    return filer_filings.groupBy("filing_id").agg(F.min("filer_id").cast("string").alias("filer_id"))


def _receipts(df: DataFrame, src: str, date: str, amount: str, last: str, first: str, descr: str | None, extra: list[str]) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        F.lit(src).alias("src"), "filing_id", "amend_id", "tran_id", F.col("line_item").cast("long").alias("line_item"), F.col(date).alias("receipt_date"), F.col(amount).alias("amount"),
        F.coalesce(last, F.lit("")).alias("donor_naml"), F.coalesce(first, F.lit("")).alias("donor_namf"), (F.col(descr) if descr else text).alias("ctrib_dscr"), F.col("cmte_id").alias("raw_cmte"), "memo_refno", *extra,
    )


def _within(df: DataFrame, scope: DataFrame | None) -> DataFrame:
    """The rows of the scope's filings. It goes before the choice among lines, which is made within a filing, but not before the removal of versions, which is not."""
    return df if scope is None else df.join(scope, "filing_id", "left_semi")


def receipts_all(rcpt: DataFrame, s497: DataFrame, s498: DataFrame, filings: DataFrame, extra: list[str] = (), scope: DataFrame | None = None) -> DataFrame:
    """All receipts of the three sources with derived committee and donor, one row per line; with scope (filing_id), of its filings only.

    The inputs are deduplicated tables; filings is filing_filer. cmte_id is the row's
    own or else the filing's filer; raw_cmte keeps the row's own, since the derived one
    is the recipient and not the donor.
    """
    rcpt, s497, s498 = (_within(df, scope) for df in (rcpt, s497, s498))
    base = (
        _receipts(rcpt, "rcpt_cd", "rcpt_date", "amount", "ctrib_naml", "ctrib_namf", "ctrib_dscr", extra)
        .unionByName(_receipts(s497, "s497_cd", "ctrib_date", "amount", "enty_naml", "enty_namf", None, extra))
        .unionByName(_receipts(s498.where("form_type = 'F498-R' and amt_rcvd is not null"), "s498_cd", "date_rcvd", "amt_rcvd", "payor_naml", "payor_namf", None, extra))
        .join(filings.withColumnRenamed("filer_id", "filing_filer_id"), "filing_id", "left")
    )
    own = F.when(F.col("raw_cmte") != "", F.col("raw_cmte"))
    name = joined_name(F.col("donor_naml"), F.col("donor_namf"))
    base = base.withColumn("cmte_id", F.coalesce(own, "filing_filer_id")).withColumn("donor_name", F.coalesce(name, "ctrib_dscr")).withColumn("donor_key", F.coalesce("donor_name", "cmte_id"))
    return attributed_first(base, "raw_cmte", extra)


def expn_all(expn: DataFrame, lexp: DataFrame | None, s496: DataFrame | None, filings: DataFrame, extra: list[str] = (), scope: DataFrame | None = None) -> DataFrame:
    """All expenditures with derived committee, payee key and cycle (calendar year); with scope (filing_id), of its filings only."""
    cols = ["filing_id", "amend_id", "tran_id", "line_item", "form_type", "expn_date", "amount", "payee_naml", "payee_namf", "expn_code", "expn_dscr", "cmte_id", "memo_refno"]

    def part(df: DataFrame, src: str, renamed: dict[str, str]) -> DataFrame:
        df = _within(df, scope).withColumnsRenamed(renamed)
        return df.select(F.lit(src).alias("src"), *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols], *extra)

    base = part(expn, "expn_cd", {})
    if lexp is not None:
        base = base.unionByName(part(lexp, "lexp_cd", {}))
    if s496 is not None:
        base = base.unionByName(part(s496, "s496_cd", {"exp_date": "expn_date"}))
    base = base.withColumnRenamed("cmte_id", "raw_cmte").join(filings.withColumnRenamed("filer_id", "filing_filer_id"), "filing_id", "left")
    name = joined_name(F.col("payee_naml"), F.col("payee_namf"))
    base = base.withColumn("cmte_id", F.coalesce(F.when(F.col("raw_cmte") != "", F.col("raw_cmte")), "filing_filer_id"))
    base = base.withColumn("payee_name", name).withColumn("payee_key", F.coalesce(name, "expn_dscr", "cmte_id")).withColumn("cycle", F.year("expn_date"))
    return attributed_first(base, "raw_cmte", extra)


def ie_dedup(ie: DataFrame, tie: str) -> DataFrame:
    """Independent expenditures once: by transaction the best form, then per line as many as the fullest filing has."""
    first = latest_version(ie.where("transaction_id is not null"), ["spender_id", "transaction_id"], [rank_in(F.col("filing_form"), IE_FORMS), F.col("expenditure_amount").desc_nulls_first(), F.col(tie)])
    base = first.unionByName(ie.where("transaction_id is null"))
    order = [F.when(F.col("amendment_indicator") == "A", 0).otherwise(1), F.col("file_number").desc_nulls_last(), F.col("transaction_id").asc_nulls_last(), F.col(tie)]
    return keep_max_per_source(base, ["spender_id", "candidate_id", "expenditure_date", "expenditure_amount"], "file_number", order, null_groups=True)


def ie_resolved(dedup: DataFrame) -> DataFrame:
    """Adds resolved_candidate_id (a null id takes the only id of its canonical name) and the most frequent name."""
    named = dedup.where("candidate_id is not null and candidate_name is not null").groupBy(canonical_name(F.col("candidate_name")).alias("ckey")).agg(F.min("candidate_id").alias("cid"), F.count_distinct("candidate_id").alias("n_ids"))
    keyed = dedup.withColumn("ckey", canonical_name(F.col("candidate_name"))).join(named, "ckey", "left")
    resolved = keyed.withColumn("resolved_candidate_id", F.coalesce("candidate_id", F.when(F.col("n_ids") == 1, F.col("cid")))).drop("ckey", "cid", "n_ids")
    shown = resolved.where("resolved_candidate_id is not null").groupBy("resolved_candidate_id").agg(F.mode("candidate_name", True).alias("display_name"))
    return resolved.join(shown, "resolved_candidate_id", "left").withColumn("resolved_candidate_name", F.coalesce("display_name", "candidate_name")).drop("display_name")


def current(df: DataFrame) -> DataFrame:
    """Rows without a tombstone."""
    return df.where("deleted_at is null")


def filer_names(filername: DataFrame, nulls_first: bool = False) -> DataFrame:
    """One name per filer: the latest effective, undated ones last (or first), then the greatest id."""
    when = F.col("effect_dt").desc_nulls_first() if nulls_first else F.col("effect_dt").desc_nulls_last()
    return latest_version(filername, ["filer_id"], [when, F.col("id").desc(), *[F.col(c).desc_nulls_last() for c in ("source_file", "line_no") if c in filername.columns]])


def filer_committees(xref: DataFrame) -> DataFrame:
    """One committee per filer: the latest effective, then the smallest id."""
    return latest_version(xref, ["filer_id"], [F.col("effect_dt").desc_nulls_last(), F.col("xref_id").asc()])


def committee_filers(xref: DataFrame) -> DataFrame:
    """One filer per committee, so that joins by committee never multiply rows."""
    return latest_version(xref, ["xref_id"], [F.col("effect_dt").desc_nulls_last(), F.col("filer_id").asc()])


def committee_names(xref: DataFrame, filername: DataFrame) -> DataFrame:
    """(xref_id, committee): the name of each committee's filer."""
    names = filer_names(filername).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("committee"))
    return committee_filers(xref).join(names, "filer_id").select("xref_id", "committee")


def money_flows(*parts: tuple[str, DataFrame, str, str, str, str]) -> DataFrame:
    """(flow, from_id, to_id, flow_date, amount) of any number of tables below each other."""
    out = None
    for flow, df, source, target, date, amount in parts:
        one = df.select(F.lit(flow).alias("flow"), F.col(source).cast("string").alias("from_id"), F.col(target).cast("string").alias("to_id"), F.col(date).alias("flow_date"), F.col(amount).alias("amount"))
        out = one if out is None else out.unionByName(one)
    return out


