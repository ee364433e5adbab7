"""The parameterised read-only queries over the views, each one plan without driver-side loops.

A scope is a set of filings given as a DataFrame (filing_id); it is applied by a
semi join. Views are passed in, so that a caller can hand over stored snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import REFUND_MEMO, display_name, has_all_words, is_refund_memo, is_returned_contribution, joined_name, starts_word, trigram_similarity
from tallyforge.operators.components import merged_names
from tallyforge.operators.dedup import keep_max_per_source, kept_counts, latest_version
from tallyforge.plans.views import RECEIPT_SOURCES, committee_filers, filer_committees, filer_names, rank_in

GIFT = ["donor_key", "receipt_date", "amount"]
VENDOR_FORMS = ["E", "F461P5"]


def in_year(date: str, year: int) -> Column:
    """A range on the raw column, so that it reaches the scan."""
    return (F.col(date) >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col(date) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))


def scope_of(filings: DataFrame, filer_id: str) -> DataFrame:
    """The filings of one filer."""
    return filings.where(F.col("filer_id").cast("string") == str(filer_id)).select("filing_id").distinct()


def resolved_filers(ids: DataFrame, xref: DataFrame) -> DataFrame:
    """(committee_id, filer_id) of ids (committee_id): the filer the id belongs to, latest first; else a number is a filer's own; else -1."""
    known = committee_filers(xref.where("filer_id is not null")).select(F.col("xref_id").alias("committee_id"), F.col("filer_id").cast("long").alias("of"))
    own = F.when(F.col("committee_id").rlike("^[0-9]+$"), F.col("committee_id").try_cast("long"))
    return ids.select("committee_id").distinct().join(known, "committee_id", "left").select("committee_id", F.coalesce("of", own, F.lit(-1).cast("long")).alias("filer_id"))


def scoped(df: DataFrame, scope: DataFrame) -> DataFrame:
    return df.join(scope, "filing_id", "left_semi")


def money(c: Column) -> Column:
    """Sums leave the engine as doubles rounded to cents."""
    return F.round(F.coalesce(c, F.lit(0)), 2).cast("double")


def _gift_order(tie: str) -> list[Column]:
    return [rank_in(F.col("src"), RECEIPT_SOURCES), F.col("tran_id").asc_nulls_last(), F.col("filing_id").asc_nulls_last(), F.col(tie)]


def gifts_once(receipts: DataFrame, tie: str) -> DataFrame:
    """The rows of receipts with gifts that several sources report counted once; rows without key, date or amount vanish."""
    return keep_max_per_source(receipts, GIFT, "src", _gift_order(tie), null_groups=False)


def _by_donor(donor: str, aliases: Sequence[str]) -> Column:
    """Whether a donor's name or description contains the text, or is one of its aliases; never null."""
    hit = F.col("donor_naml").ilike(f"%{donor}%") | F.col("ctrib_dscr").ilike(f"%{donor}%")
    if aliases:
        hit = hit | F.col("donor_naml").isin(list(aliases)) | F.col("ctrib_dscr").isin(list(aliases))
    return F.coalesce(hit, F.lit(False))


def alias_names(alias: DataFrame, text: str, limit: int = 50) -> list[str]:
    """The names that an alias table has for a text, ``limit`` at most, as a search by name takes them."""
    rows = alias.where(F.col("alias_name").ilike(f"%{text}%")).select("alias_name").distinct().orderBy("alias_name").limit(limit)
    return [r["alias_name"] for r in rows.collect()]


def contributions_by_donor(receipts: DataFrame, donor: str, year: int, tie: str, aliases: Sequence[str] = (), limit: int = 500) -> DataFrame:
    """Gifts of donors whose name contains the text (or is an alias), newest first."""
    rows = gifts_once(receipts.where(in_year("receipt_date", year) & _by_donor(donor, aliases)), tie)
    return rows.orderBy(F.col("receipt_date").desc_nulls_last(), F.col("amount").desc(), F.col(tie)).limit(limit)


def donor_watch_since(receipts: DataFrame, donor: str, since: str, tie: str, aliases: Sequence[str] = (), limit: int = 500) -> DataFrame:
    """Gifts of donors whose name contains the text (or is an alias), on or after a day."""
    rows = receipts.where((F.col("receipt_date") >= F.lit(since).cast("timestamp_ntz")) & _by_donor(donor, aliases))
    return gifts_once(rows, tie).orderBy(F.col("receipt_date").desc_nulls_last(), F.col("amount").desc(), F.col(tie)).limit(limit)


def top_donors(receipts: DataFrame, scope: DataFrame, year: int, xref: DataFrame, filername: DataFrame, limit: int = 10) -> DataFrame:
    """(donor_name, contributions, total) of a committee's greatest donors, each gift once."""
    kept = kept_counts(scoped(receipts, scope).where(in_year("receipt_date", year)), GIFT, "src", [F.max(F.when(F.col("donor_name") != "", F.col("donor_name"))).alias("donor_name"), F.max("cmte_id").alias("cmte_id")])
    names = filer_names(filername).select(F.col("filer_id").alias("f"), joined_name(F.col("naml"), F.col("namf")).alias("filer_name"))
    via = committee_filers(xref).select(F.col("xref_id").alias("x"), F.col("filer_id").alias("f")).join(names, "f")
    named = kept.join(via, kept["cmte_id"] == via["x"], "left")
    label = F.coalesce(F.when(F.trim("donor_name") != "", F.trim("donor_name")), "filer_name", "cmte_id", F.lit("(unknown)"))
    return (
        named.groupBy(label.alias("donor_name")).agg(F.sum("keep_n").alias("contributions"), money(F.sum(F.col("keep_n") * F.col("amount"))).alias("total"))
        .orderBy(F.col("total").desc(), F.col("donor_name")).limit(limit)
    )


def committee_outlays_to(expn: DataFrame, scope: DataFrame, vendor: str, year: int, tie: str, exclude_refunds: bool = False, limit: int = 50) -> DataFrame:
    """Payments of a committee to payees whose name has a word that starts with the text."""
    payee = F.coalesce(joined_name(F.col("payee_naml"), F.col("payee_namf")), F.lit(""))
    rows = scoped(expn, scope).where(F.col("form_type").isin(VENDOR_FORMS) & in_year("expn_date", year) & starts_word(payee, vendor))
    if exclude_refunds:
        rows = rows.where(~is_refund_memo(F.coalesce("expn_dscr", F.lit(""))))
    return rows.select("expn_date", "amount", "expn_dscr", payee.alias("payee_name"), "cmte_id", "tran_id", tie).orderBy(F.col("expn_date").desc_nulls_last(), F.col(tie)).limit(limit)


def vendor_revenue(expn: DataFrame, vendor: str, limit: int = 20) -> DataFrame:
    """(vendor_name, payments, total) over all committees."""
    payee = joined_name(F.col("payee_naml"), F.col("payee_namf"))
    rows = expn.where(F.col("form_type").isin(VENDOR_FORMS) & starts_word(F.coalesce(payee, F.lit("")), vendor))
    return (
        rows.groupBy(F.coalesce(payee, F.lit("(unknown payee)")).alias("vendor_name")).agg(F.count(F.lit(1)).alias("payments"), money(F.sum("amount")).alias("total"))
        .orderBy(F.col("total").desc(), F.col("vendor_name")).limit(limit)
    )


def committees_paying_vendor(expn: DataFrame, filer_filings: DataFrame, xref: DataFrame, filername: DataFrame, vendor: str, limit: int = 10, classes: DataFrame | None = None, candidate: int | None = None, candidate_only: bool = False) -> DataFrame:
    """Committees by what they paid a vendor on any form; a filing with two filers counts under both.

    With classes (filer_id, category, effect_dt) the latest category of the filer stands
    beside it, and whether it is that of candidates; candidate_only keeps those alone.
    """
    payee = F.coalesce(joined_name(F.col("payee_naml"), F.col("payee_namf")), F.lit(""))
    names = filer_names(filername).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("n"))
    ids = filer_committees(xref).select("filer_id", F.col("xref_id").alias("cmte_id"))
    rows = expn.where(starts_word(payee, vendor)).select("filing_id", "amount").join(filer_filings.select("filing_id", "filer_id").distinct(), "filing_id").join(names, "filer_id", "left").join(ids, "filer_id", "left")
    by = [F.coalesce("n", F.lit("(unknown)")).alias("committee"), "cmte_id"]
    if classes is not None:
        latest = latest_version(classes, ["filer_id"], [F.col("effect_dt").desc_nulls_last(), F.col("category").desc()]).select("filer_id", "category")
        rows = rows.join(latest, "filer_id", "left")
        rows = rows.where(F.col("category") == candidate) if candidate_only else rows
        by += ["category", F.coalesce(F.col("category") == candidate, F.lit(False)).alias("is_candidate")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("payments"), money(F.sum("amount")).alias("total")).orderBy(F.col("total").desc(), F.col("committee"), F.col("cmte_id").asc_nulls_last()).limit(limit)


def committee_profile(receipts: DataFrame, expn: DataFrame, scope: DataFrame, today: str, as_of: str | None = None) -> DataFrame:
    """One row: receipts (each gift once), expenditures, their numbers, and the last activity not after today."""
    r, e = scoped(receipts, scope), scoped(expn, scope)
    if as_of:
        end = F.lit(as_of).cast("timestamp_ntz")
        r, e = r.where(F.col("receipt_date") <= end), e.where(F.col("expn_date") <= end)
    now = F.lit(today).cast("timestamp_ntz")
    gifts = kept_counts(r, GIFT, "src").agg(money(F.sum(F.col("keep_n") * F.col("amount"))).alias("total_receipts"), F.coalesce(F.sum("keep_n"), F.lit(0)).cast("long").alias("receipts"))
    spent = e.agg(money(F.sum("amount")).alias("total_expenditures"), F.count(F.lit(1)).alias("expenditures"))
    last = scoped(receipts, scope).select(F.col("receipt_date").alias("d")).unionByName(scoped(expn, scope).select(F.col("expn_date").alias("d"))).where(F.col("d") <= now).agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_activity"))
    one = lambda df: df.select(F.struct("*")).scalar()
    row = receipts.sparkSession.range(1).select(one(gifts).alias("g"), one(spent).alias("s"), one(last).alias("l"))
    return row.select("g.*", "s.*", "l.*")


def total_expenditures(expn: DataFrame, scope: DataFrame, year: int, exclude_refunds: bool = False) -> DataFrame:
    """One row of totals; lines of form D count only on filings without any dated vendor line in the year. One pass with a window."""
    dated = F.col("expn_date").isNotNull() & F.coalesce(in_year("expn_date", year), F.lit(False))
    vendor = F.col("form_type").isin(VENDOR_FORMS) & dated
    rows = scoped(expn, scope).withColumn("vendor_lines", F.sum(F.when(vendor, 1).otherwise(0)).over(Window.partitionBy("filing_id")))
    rows = rows.where(vendor | ((F.col("form_type") == "D") & dated & (F.col("vendor_lines") == 0)))
    if exclude_refunds:
        rows = rows.where(~is_refund_memo(F.coalesce("expn_dscr", F.lit(""))))
    return rows.agg(
        F.count(F.lit(1)).alias("transaction_count"), money(F.sum("amount")).alias("total_amount"), F.nullif(F.array_join(F.array_sort(F.collect_set("form_type")), ","), F.lit("")).alias("form_types"),
        money(F.sum(F.when(F.col("form_type") == "D", F.col("amount")))).alias("form_d_total"), money(F.sum(F.when(F.col("form_type").isin(VENDOR_FORMS), F.col("amount")))).alias("form_e_total"),
    )


def refunds_to_donors(expn: DataFrame, scope: DataFrame, year: int, limit: int = 50, memo: str = REFUND_MEMO) -> DataFrame:
    """(recipient, refunds, total) of payments that return contributions."""
    payee = F.coalesce(joined_name(F.col("payee_naml"), F.col("payee_namf")), F.lit("(unknown)"))
    rows = scoped(expn, scope).where(in_year("expn_date", year) & F.lower(F.trim(F.coalesce("expn_dscr", F.lit("")))).rlike(memo))
    return rows.groupBy(payee.alias("recipient")).agg(F.count(F.lit(1)).alias("refunds"), money(F.sum("amount")).alias("total"), F.max("expn_date").alias("last_refund")).orderBy(F.col("total").desc(), "recipient").limit(limit)


def refund_summary(expn: DataFrame, scope: DataFrame, year: int) -> DataFrame:
    """One row: how many lines return contributions, their sum, the first and the last."""
    rows = scoped(expn, scope).where(in_year("expn_date", year) & F.coalesce(is_refund_memo(F.col("expn_dscr")), F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("refund_lines"), money(F.sum("amount")).alias("total_refunded"), F.min("expn_date").alias("first_refund"), F.max("expn_date").alias("last_refund"))


def expenditures_by_form(expn: DataFrame, scope: DataFrame, forms: list[str], year: int, tie: str, name: str | None = None, limit: int = 50) -> DataFrame:
    """A committee's lines of some forms in a year, newest first; with name only those whose payee contains it."""
    rows = scoped(expn, scope).where(F.col("form_type").isin(forms) & in_year("expn_date", year))
    if name:
        rows = rows.where(F.col("payee_naml").ilike(f"%{name}%"))
    return rows.orderBy(F.col("expn_date").desc_nulls_last(), F.col(tie)).limit(limit)


def measure_spending(covers: DataFrame, summaries: DataFrame, limit: int = 20) -> DataFrame:
    """(committee, filings, total): cover sheets with their summary lines; every line of a filing counts, covers without any too."""
    rows = covers.join(summaries, "filing_id", "left")
    t = rows.groupBy("committee").agg(F.count_distinct("filing_id").alias("filings"), money(F.sum("amount_a")).alias("total"))
    return t.orderBy(F.col("total").desc(), "committee").limit(limit)


def merged_top(parts: list[tuple[str, DataFrame, str, str]], least: float, limit: int) -> DataFrame:
    """(name, source, records, total): the greatest names of several sources; each source's sums must reach least."""
    out = None
    for source, df, name, amount in parts:
        one = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("records"), money(F.sum(amount)).alias("total"))
        one = one.where(F.col("total") >= least).withColumn("source", F.lit(source)).orderBy(F.col("total").desc(), "name").limit(limit)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("total").desc(), "name", "source").limit(limit)


def in_state(rows: DataFrame, committee: str, state: str, committees: DataFrame) -> DataFrame:
    """Rows of committees that sit in a state, or are named in the register with it: one semi join with the union of their ids."""
    ids = committees.where(F.upper(F.trim("st")) == state).select(F.col("xref_id").alias(committee)).distinct()
    return rows.join(ids, committee, "left_semi")


def lines_of_payers(lines: DataFrame, filer_filings: DataFrame, expn: DataFrame, vendor: str) -> DataFrame:
    """Lines of all filings of the filers that paid a vendor in any filing: a chain of semi joins."""
    payee = F.coalesce(joined_name(F.col("payee_naml"), F.col("payee_namf")), F.lit(""))
    paid = expn.where(starts_word(payee, vendor)).select("filing_id").distinct()
    filers = filer_filings.join(paid, "filing_id", "left_semi").select("filer_id").distinct()
    return lines.join(filer_filings.join(filers, "filer_id", "left_semi").select("filing_id").distinct(), "filing_id", "left_semi")


def find_committees(filername: DataFrame, xref: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(xref_id, name) of filers whose family or committee name contains the text."""
    rows = filername.where(F.col("naml").ilike(f"%{text}%")).select("filer_id", display_name(F.col("naml"), F.col("namf"), F.col("namt"), F.col("nams")).alias("name"))
    return rows.join(xref.select("filer_id", "xref_id"), "filer_id").select("xref_id", "name").distinct().orderBy("name", "xref_id").limit(limit)


def rapid_expense_vendors(rapid: DataFrame, expn: DataFrame, limit: int = 200) -> DataFrame:
    """Rapid-report lines without payee, each with the payees of regular lines of the same day and amount, and whether there are any."""
    payee = F.substring(F.trim(joined_name(F.col("payee_naml"), F.col("payee_namf"))), 1, 120)
    known = expn.where(payee.isNotNull()).groupBy(F.to_date("expn_date").alias("day"), "amount").agg(F.array_join(F.array_sort(F.collect_set(payee)), "; ").alias("payees"))
    lines = rapid.select("filing_id", "line_item", F.to_date("exp_date").alias("day"), "amount", F.substring(F.trim("expn_dscr"), 1, 120).alias("description"))
    return lines.join(known, ["day", "amount"], "left").withColumn("resolved", F.col("payees").isNotNull()).orderBy(F.col("day").desc_nulls_last(), "filing_id", "line_item", "description", "amount").limit(limit)


def unresolved_rapid_lines(rapid: DataFrame, expn: DataFrame) -> DataFrame:
    """(description, lines, total) of rapid-report lines that no regular line of the same day and amount explains."""
    known = expn.where(joined_name(F.col("payee_naml"), F.col("payee_namf")).isNotNull()).select(F.to_date("expn_date").alias("day"), "amount").distinct()
    lines = rapid.withColumn("day", F.to_date("exp_date")).join(known, ["day", "amount"], "left_anti")
    return lines.groupBy(F.coalesce(F.trim("expn_dscr"), F.lit("(none)")).alias("description")).agg(F.count(F.lit(1)).alias("lines"), money(F.sum("amount")).alias("total"), F.max("exp_date").alias("newest"))


def name_search(receipts: DataFrame, expn: DataFrame, text: str) -> DataFrame:
    """(year, side, records, total): gifts and payments whose name has all words of the text, by year; undated ones under a null year."""
    gave = receipts.where(F.coalesce(has_all_words(F.concat_ws(" ", "donor_naml", "donor_namf"), text), F.lit(False))).select(F.lit("gift").alias("side"), F.year("receipt_date").alias("year"), "amount")
    paid = expn.where(F.coalesce(has_all_words(F.concat_ws(" ", "payee_naml", "payee_namf"), text), F.lit(False))).select(F.lit("payment").alias("side"), F.year("expn_date").alias("year"), "amount")
    return gave.unionByName(paid).groupBy("side", "year").agg(F.count(F.lit(1)).alias("records"), money(F.sum("amount")).alias("total"))


def upcoming(calendar: DataFrame, day: str, today: str, days: int) -> DataFrame:
    """Rows whose day lies within the next days, with days_until."""
    start = F.lit(today).cast("date")
    left = F.datediff(F.col(day).cast("date"), start)
    return calendar.withColumn("days_until", left).where((left >= 0) & (left <= days))


def due_soon(calendar: DataFrame, today: str, tie: list[str] = (), days: int = 7) -> DataFrame:
    """Deadlines (deadline_date) of a calendar within the next days, soonest first, with days_until."""
    return upcoming(calendar, "deadline_date", today, days).orderBy("deadline_date", *tie)


def last_loads(manifest: DataFrame) -> DataFrame:
    """(table_name, source, files, records, last_load) of the files that were loaded with success."""
    rows = manifest.where("rows_processed > 0").groupBy(F.lower(F.trim("table_name")).alias("table_name"), "source")
    return rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("long").alias("records"), F.max("processed_date").alias("last_load"))


def freshness(parts: list[tuple[str, DataFrame, str]], today: str) -> DataFrame:
    """(table_name, row_count, newest, future_dates): the newest date not after today and how many lie beyond."""
    now = F.lit(today).cast("timestamp_ntz")
    out = None
    for name, df, date in parts:
        one = df.agg(F.count(F.lit(1)).alias("row_count"), F.max(F.when(F.col(date) <= now, F.col(date))).alias("newest"), F.sum(F.when(F.col(date) > now, 1).otherwise(0)).alias("future_dates")).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def race_lines(expn: DataFrame, filers: DataFrame, district: str, year: int) -> DataFrame:
    """(candidate, office, side, amount, on, filer_id): the lines on candidates of a district in a year, of all chambers.

    expn has cand_naml, cand_namf, office_cd, sup_opp_cd, dist_no, expn_code and form_type.
    """
    rows = expn.where((F.col("expn_code") == "IND") & (F.col("form_type") == "D") & (F.col("dist_no") == district) & in_year("expn_date", year))
    return rows.join(filers, "filing_id", "left").select(joined_name(F.col("cand_naml"), F.col("cand_namf")).alias("candidate"), F.col("office_cd").alias("office"), F.col("sup_opp_cd").alias("side"), "amount", F.col("expn_date").alias("on"), "filer_id")


def _shown(lines: DataFrame) -> DataFrame:
    """lines with the candidate's spellings merged: group, and shown, the spelling with most lines (the greatest of equals)."""
    rows = lines.withColumn("candidate", F.trim("candidate"))
    rows = rows.join(merged_names(lines, "candidate"), "candidate")
    spellings = rows.groupBy("group", "candidate").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(spellings.groupBy("group").agg(F.max(F.struct("n", "candidate")).alias("m")).select("group", F.col("m.candidate").alias("shown")), "group")


def race_roster(lines: DataFrame, office: str) -> DataFrame:
    """(candidate, for and against totals and counts, first_date, last_date) of candidates with lines in the office; spellings in all offices are merged."""
    of = lambda s, c: F.sum(F.when(F.col("side") == s, c).otherwise(0))
    rows = _shown(lines).where(F.col("office") == office).groupBy("group", F.col("shown").alias("candidate"))
    totals = [money(of("S", F.col("amount"))).alias("for_total"), money(of("O", F.col("amount"))).alias("against_total"), of("S", F.lit(1)).alias("for_count"), of("O", F.lit(1)).alias("against_count")]
    return rows.agg(*totals, F.min("on").alias("first_date"), F.max("on").alias("last_date")).drop("group")


def race_unmatched(lines: DataFrame, office: str) -> DataFrame:
    """(candidate, office, total, lines): lines on the district's candidates for other offices, or for none that is named."""
    other = ~F.coalesce(F.col("office") == office, F.lit(False))
    return lines.where(other).groupBy(F.coalesce(F.trim("candidate"), F.lit("(unnamed)")).alias("candidate"), "office").agg(money(F.sum("amount")).alias("total"), F.count(F.lit(1)).alias("lines"))


def race_overview(lines: DataFrame, filername: DataFrame, top: int) -> DataFrame:
    """(candidate, side, spender, spender_total, spender_lines, side_total, side_lines) for a race's lines.

    lines has candidate, side, amount and filer_id. Spellings whose word sets contain
    one another are one candidate, shown under the spelling with most lines (the
    greatest of equals); of each candidate and side the top spenders are listed.
    """
    rows = _shown(lines)
    names = filer_names(filername.join(rows.select("filer_id").distinct(), "filer_id", "left_semi"), nulls_first=True).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("spender"))
    side = rows.groupBy("group", "side").agg(F.sum("amount").alias("side_sum"), F.count(F.lit(1)).alias("side_lines"))
    per = rows.join(names, "filer_id", "left").groupBy("group", "shown", "side", F.coalesce("spender", F.lit("(unknown)")).alias("spender")).agg(F.sum("amount").alias("sum"), F.count(F.lit(1)).alias("spender_lines"))
    rank = F.row_number().over(Window.partitionBy("group", "side").orderBy(F.col("sum").desc_nulls_last(), "spender"))
    per = per.withColumn("rank", rank).where(F.col("rank") <= top).withColumnsRenamed({"group": "g", "side": "s"})
    joined = per.join(side, (F.col("g") == F.col("group")) & F.col("s").eqNullSafe(F.col("side")))
    return joined.select(F.col("shown").alias("candidate"), "side", "spender", money(F.col("sum")).alias("spender_total"), "spender_lines", money(F.col("side_sum")).alias("side_total"), "side_lines")


PHASES = {"primary": "P", "general": "G", "runoff": "R", "special": "S", "convention": "C", "other": "O"}


def phase(election_type: str | None) -> Column:
    """The filter for an election phase by its name or letter; ValueError for an unknown one."""
    if not election_type:
        return F.lit(True)
    letter = PHASES.get(election_type.strip().lower(), election_type.strip()[:1].upper())
    if letter not in PHASES.values():
        raise ValueError(f"unknown election type {election_type!r}")
    return F.substring("election_type", 1, 1) == letter


def _side(c: str, side: str) -> tuple[Column, Column]:
    of = F.col("support_oppose") == side
    return F.sum(F.when(of, F.col(c))), F.sum(F.when(of, 1).otherwise(0))


def _for_against() -> list[Column]:
    f, fn = _side("expenditure_amount", "S")
    a, an = _side("expenditure_amount", "O")
    return [money(f).alias("for_total"), money(a).alias("against_total"), fn.alias("for_count"), an.alias("against_count")]


def ie_summary(ie: DataFrame, year: int | None = None, election_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(candidate_id, for_total, against_total, for_count, against_count, net) of every candidate; end is exclusive."""
    rows = ie.where(F.col("resolved_candidate_id").isNotNull() & phase(election_type))
    if year is not None:
        rows = rows.where(F.col("election_year") == year)
    if start:
        rows = rows.where(F.col("expenditure_date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("expenditure_date") < F.lit(end).cast("timestamp_ntz"))
    t = rows.groupBy(F.col("resolved_candidate_id").alias("candidate_id")).agg(*_for_against())
    return t.withColumn("net", F.round(F.col("for_total") - F.col("against_total"), 2))


def ie_top_spending(ie: DataFrame, side: str, committees: DataFrame, limit: int = 5) -> DataFrame:
    """The greatest spenders for or against candidates, with the name the register has for them."""
    rows = ie.where(F.col("support_oppose") == side).groupBy("spender_id").agg(F.count(F.lit(1)).alias("records"), money(F.sum("expenditure_amount")).alias("total"))
    top = rows.orderBy(F.col("total").desc(), F.col("spender_id").asc_nulls_last()).limit(limit)
    return top.join(committees, "spender_id", "left")


def ie_breakdown(ie: DataFrame) -> DataFrame:
    """(face, value, records, total): one spender's money by payee, purpose and candidate in one scan."""
    faces = F.explode(F.array(*[F.struct(F.lit(n).alias("face"), F.coalesce(F.col(c), F.lit("(none)")).alias("value")) for n, c in (("payee", "payee"), ("purpose", "purpose"), ("target", "resolved_candidate_name"))]))
    return ie.select("expenditure_amount", faces.alias("x")).groupBy("x.face", "x.value").agg(F.count(F.lit(1)).alias("records"), money(F.sum("expenditure_amount")).alias("total"))


def ie_race(ie: DataFrame, state: str, limit: int = 50) -> DataFrame:
    """For and against of each candidate of a state's races."""
    rows = ie.where((F.col("office_state") == state) & F.col("resolved_candidate_id").isNotNull()).groupBy(F.col("resolved_candidate_id").alias("candidate_id"), F.col("resolved_candidate_name").alias("candidate_name")).agg(*_for_against())
    return rows.orderBy((F.col("for_total") + F.col("against_total")).desc(), "candidate_id").limit(limit)


def ie_by_org(ie: DataFrame, least: float) -> DataFrame:
    """One row per spender, candidate and side above a sum, with a sentence of the purpose."""
    rows = ie.where("resolved_candidate_id is not null").groupBy("spender_id", F.col("resolved_candidate_id").alias("candidate_id"), "support_oppose").agg(money(F.sum("expenditure_amount")).alias("total"), F.count(F.lit(1)).alias("records"), F.max("resolved_candidate_name").alias("candidate_name"))
    return rows.where(F.col("total") > least).withColumn("sentence", F.concat(F.when(F.col("support_oppose") == "S", "supporting ").when(F.col("support_oppose") == "O", "opposing ").otherwise("regarding "), F.coalesce("candidate_name", F.lit("(unnamed)"))))


def find_candidate(ie: DataFrame, text: str, least: float = 0.3, limit: int = 20) -> DataFrame:
    """Candidates whose name contains the text or is similar to it, best first."""
    match = trigram_similarity(F.col("resolved_candidate_name"), F.lit(text))
    rows = ie.where(F.col("resolved_candidate_id").isNotNull()).withColumn("m", match).where(F.col("resolved_candidate_name").ilike(f"%{text}%") | (F.col("m") >= F.lit(least).cast("float")))
    t = rows.groupBy(F.col("resolved_candidate_id").alias("candidate_id")).agg(F.max("resolved_candidate_name").alias("candidate_name"), F.count(F.lit(1)).alias("ie_records"), F.max("m").alias("match"))
    return t.orderBy(F.col("match").desc(), "candidate_name", "candidate_id").limit(limit)


def two_source_totals(parts: list[tuple[str, DataFrame, str, str]], least: float) -> DataFrame:
    """(year, by_source totals): yearly sums of several sources below each other, only years whose sum reaches least."""
    out = None
    for name, df, date, amount in parts:
        one = df.select(F.lit(name).alias("source"), F.year(date).alias("year"), F.col(amount).alias("amount"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("year").agg(F.count(F.lit(1)).alias("records"), money(F.sum("amount")).alias("total"), *[money(F.sum(F.when(F.col("source") == n, F.col("amount")))).alias(f"{n}_total") for n, *_ in parts]).where(F.col("total") >= least)


def spender_targets(ie: DataFrame, year: int, least: float, tie: str, limit: int = 200) -> DataFrame:
    """(candidate_name, expenditures, total): of equal transactions of a spender in the year the greatest amount counts."""
    rows = latest_version(ie.where((F.col("election_year") == year) & F.col("transaction_id").isNotNull()), ["spender_id", "transaction_id"], [F.col("expenditure_amount").desc_nulls_first(), F.col(tie)])
    t = rows.groupBy(F.coalesce("candidate_name", F.lit("(none)")).alias("candidate_name")).agg(F.count(F.lit(1)).alias("expenditures"), money(F.sum("expenditure_amount")).alias("total"))
    return t.where(F.col("total") >= least).orderBy(F.col("total").desc(), "candidate_name").limit(limit)


def returned_contributions(expn: DataFrame, receipts: DataFrame, year: int) -> DataFrame:
    """(source, records, total): money given back, as positive payments that say so and as negative receipts."""
    paid = expn.where(in_year("expn_date", year) & F.coalesce(is_returned_contribution(F.col("expn_dscr")), F.lit(False)) & (F.col("amount") > 0)).select(F.lit("payments").alias("source"), "amount")
    back = receipts.where(in_year("receipt_date", year) & (F.col("amount") < 0)).select(F.lit("negative receipts").alias("source"), (-F.col("amount")).alias("amount"))
    return paid.unionByName(back).groupBy("source").agg(F.count(F.lit(1)).alias("records"), money(F.sum("amount")).alias("total"))
