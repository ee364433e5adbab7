"""What a person or an organisation did: all roles of a person, and every transaction that a name touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import display_name, has_all_words, joined_name, name_tokens, person_predicate
from tallyforge.plans.tools import gifts_once, money
from tallyforge.plans.views import committee_filers, filer_committees, filer_names

ROLES = ("payee", "donor", "filer")
KINDS = ("all", "donor", "payee", "committee", "candidate")


def wanted_roles(roles: str) -> set[str]:
    """The roles of a comma list; "all", or nothing that is a role, stands for all."""
    named = {r.strip().lower() for r in roles.split(",")} & set(ROLES)
    return named or set(ROLES)


def _since(date: str, day: str | None) -> Column:
    return F.col(date) >= F.lit(day).cast("timestamp_ntz") if day else F.lit(True)


def person_payments(expn: DataFrame, filer_filings: DataFrame, filername: DataFrame, xref: DataFrame, person: str, tie: str, since: str | None = None, limit: int = 100) -> DataFrame:
    """Payments to a person, newest first, with the paying committee, and total, the number of rows before the limit.

    A payment on a filing with two filers stands under both; one on a filing without
    any is left out, here and in total.
    """
    rows = expn.where(person_predicate(F.col("payee_naml"), F.col("payee_namf"), person) & _since("expn_date", since)).join(filer_filings.select("filing_id", "filer_id").distinct(), "filing_id")
    names = filer_names(filername).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("committee"))
    ids = filer_committees(xref).select("filer_id", F.col("xref_id").alias("cmte_id"))
    shown = rows.select("expn_date", "amount", F.substring(F.trim(F.coalesce("expn_dscr", F.lit(""))), 1, 120).alias("purpose"), joined_name(F.col("payee_naml"), F.col("payee_namf")).alias("payee_name"), "filer_id", tie)
    top = shown.orderBy(F.col("expn_date").desc_nulls_last(), F.col(tie), "filer_id").limit(limit).withColumn("total", rows.agg(F.count(F.lit(1))).scalar())
    return top.join(names, "filer_id", "left").join(ids, "filer_id", "left")


def person_gifts(receipts: DataFrame, person: str, tie: str, since: str | None = None, limit: int = 100) -> DataFrame:
    """Gifts of a person, each once, newest first; total counts the rows of all sources before that."""
    rows = receipts.where(person_predicate(F.col("donor_naml"), F.col("donor_namf"), person) & _since("receipt_date", since))
    label = F.coalesce(F.when(F.trim("donor_name") != "", F.trim("donor_name")), F.col("cmte_id"))
    once = gifts_once(rows, tie).select("src", "receipt_date", "amount", F.col("ctrib_dscr").alias("purpose"), "cmte_id", label.alias("donor_name"), tie)
    return once.orderBy(F.col("receipt_date").desc_nulls_last(), "src", F.col(tie)).limit(limit).withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def person_filers(filername: DataFrame, xref: DataFrame, person: str, limit: int = 100) -> DataFrame:
    """(filer_id, name, cmte_id): filers under any name they ever had that is the person's."""
    named = filername.where(person_predicate(F.col("naml"), F.col("namf"), person)).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("name")).distinct()
    ids = filer_committees(xref).select("filer_id", F.col("xref_id").alias("cmte_id"))
    return named.join(ids, "filer_id", "left").withColumn("name", F.coalesce("name", F.lit("(unknown)"))).orderBy("filer_id", "name").limit(limit)


def person_blind_spot(rapid: DataFrame, expn: DataFrame, filer_filings: DataFrame, person: str, since: str | None = None) -> DataFrame:
    """(lines): rapid-report lines, which name no payee, of all committees that paid the person: a chain of semi joins."""
    paid = expn.where(person_predicate(F.col("payee_naml"), F.col("payee_namf"), person) & _since("expn_date", since)).select("filing_id").distinct()
    payers = filer_filings.join(paid, "filing_id", "left_semi").select("filer_id").distinct()
    filings = filer_filings.join(payers, "filer_id", "left_semi").select("filing_id").distinct()
    return rapid.where(_since("exp_date", since)).join(filings, "filing_id", "left_semi").agg(F.count(F.lit(1)).alias("lines"))


@dataclass(frozen=True)
class NameSearch:
    """Every transaction that a name touched: all words of the text stand in the name as whole words, in any order.

    names are the current names of filers, aliases (alias_name, source_filer_id) other
    names they are known by. start and end are inclusive days. kind says where the name
    is looked for: as donor, as payee (or as both), or as the committee or candidate
    that reports; candidate also finds lines of other committees whose candidate column
    holds the name. An unknown kind is "all"; a text without words finds nothing.
    """

    receipts: DataFrame
    expn: DataFrame
    names: DataFrame
    aliases: DataFrame
    xref: DataFrame
    text: str
    tie: str
    kind: str = "all"
    start: str | None = None
    end: str | None = None
    candidate: Column | None = None

    def _has(self, c: Column) -> Column:
        return F.coalesce(has_all_words(c, self.text), F.lit(False)) if name_tokens(self.text) else F.lit(False)

    def _within(self, date: str) -> Column:
        late = F.col(date) <= F.lit(self.end).cast("timestamp_ntz") if self.end else F.lit(True)
        return _since(date, self.start) & late

    def entities(self) -> DataFrame:
        """(filer_id, xref_id, name, filer_type, via): filers by name, and those that only an alias leads to."""
        whole = F.concat_ws(" ", "naml", "namf", "namt", "nams")
        by_alias = self.aliases.where(self._has(F.col("alias_name"))).select(F.col("source_filer_id").alias("filer_id")).where("filer_id is not null").distinct()
        marked = self.names.withColumn("hit", self._has(whole)).join(by_alias.withColumn("aliased", F.lit(True)), "filer_id", "left")
        found = marked.where("hit or aliased").withColumn("via", F.when(F.col("hit"), "name").otherwise("alias"))
        ids = filer_committees(self.xref).select("filer_id", "xref_id")
        return found.join(ids, "filer_id", "left").select("filer_id", "xref_id", display_name(F.col("naml"), F.col("namf"), F.col("namt"), F.col("nams")).alias("name"), "filer_type", "via")

    def _sources(self) -> list[tuple[str, DataFrame]]:
        """(in or out, transactions) of the kind, each in the same columns."""
        kind = self.kind.strip().lower() if self.kind.strip().lower() in KINDS else "all"
        text = F.lit(None).cast("string")
        gave = self.receipts.where(self._within("receipt_date")).select(
            F.lit("rcpt").alias("table"), F.col("src").alias("source"), "tran_id", "filing_id", "amend_id", F.col("receipt_date").alias("date"), "amount", F.col("ctrib_dscr").alias("purpose"), text.alias("code"), "cmte_id",
            F.trim(F.concat_ws(" ", "donor_naml", "donor_namf")).alias("searched"), F.coalesce(F.trim("donor_name"), F.lit("")).alias("matched_name"), F.col(self.tie).alias("tie"),
        )
        payee = F.trim(F.concat_ws(" ", "payee_naml", "payee_namf"))
        paid = self.expn.where(self._within("expn_date")).select(
            F.lit("expn").alias("table"), F.lit("expn_cd").alias("source"), "tran_id", "filing_id", "amend_id", F.col("expn_date").alias("date"), "amount", F.col("expn_dscr").alias("purpose"), F.col("expn_code").alias("code"), "cmte_id",
            payee.alias("searched"), payee.alias("matched_name"), F.col(self.tie).alias("tie"), F.trim(self.candidate if self.candidate is not None else text).alias("candidate"),
        )
        if kind in ("committee", "candidate"):
            own = self.entities().where("xref_id is not null").select(F.col("xref_id").alias("cmte_id")).distinct()
            parts = [("in", gave.join(own, "cmte_id", "left_semi")), ("out", paid.join(own, "cmte_id", "left_semi"))]
            if kind == "candidate":  # as NOT IN does, lines without a committee id are left out
                named = paid.where(self._has(F.col("candidate")) & F.col("cmte_id").isNotNull()).join(own, "cmte_id", "left_anti")
                parts.append(("out", named.withColumn("matched_name", F.col("candidate"))))
        else:
            parts = [("in", gave.where(self._has(F.col("searched"))))] if kind in ("all", "donor") else []
            parts += [("out", paid.where(self._has(F.col("searched"))))] if kind in ("all", "payee") else []
        return [(d, p.drop("candidate", "searched")) for d, p in parts]

    def matches(self, limit: int = 50) -> DataFrame:
        """The newest ``limit`` transactions of each source with the committee's name; undated ones first, then the newest, limit + 10 in all."""
        out = None
        for direction, part in self._sources():
            few = part.orderBy(F.col("date").desc_nulls_last(), F.col("filing_id").asc_nulls_last(), "source", "tie").limit(limit).withColumn("direction", F.lit(direction))
            few = few.select(*sorted(few.columns))
            out = few if out is None else out.unionByName(few)
        top = out.orderBy(F.col("date").isNull().desc(), F.col("date").desc(), "table", F.col("filing_id").asc_nulls_last(), "source", "tie").limit(limit + 10)
        named = committee_filers(self.xref).select(F.col("xref_id").alias("cmte_id"), "filer_id").join(self.names, "filer_id")
        named = named.select("cmte_id", F.nullif(display_name(F.col("naml"), F.col("namf"), F.col("namt"), F.col("nams")), F.lit("")).alias("committee_name"))
        return top.join(named, "cmte_id", "left").withColumn("committee_name", F.coalesce("committee_name", "cmte_id", F.lit("")))

    def totals(self) -> DataFrame:
        """(year, in_total, out_total, net, n) over all transactions; those without a date stand under a null year."""
        out = None
        for direction, part in self._sources():
            one = part.select(F.year("date").alias("year"), "amount", F.lit(direction).alias("direction"))
            out = one if out is None else out.unionByName(one)
        side = lambda d: money(F.sum(F.when(F.col("direction") == d, F.col("amount"))))
        t = out.groupBy("year").agg(side("in").alias("in_total"), side("out").alias("out_total"), F.count(F.lit(1)).alias("n"))
        return t.withColumn("net", F.round(F.col("in_total") - F.col("out_total"), 2))

    def recipients(self, limit: int = 10) -> DataFrame:
        """(recipient, payments, amount): whom the found filers paid most."""
        own = self.entities().where("xref_id is not null").select(F.col("xref_id").alias("cmte_id")).distinct()
        rows = self.expn.where(self._within("expn_date")).join(own, "cmte_id", "left_semi")
        payee = F.trim(F.concat(F.coalesce("payee_naml", F.lit("")), F.lit(" "), F.coalesce("payee_namf", F.lit(""))))
        return rows.groupBy(payee.alias("recipient")).agg(F.count(F.lit(1)).alias("payments"), money(F.sum("amount")).alias("amount")).orderBy(F.col("amount").desc(), "recipient").limit(limit)
