"""Queries of the views and tools on the test tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.keys import key_form
from tallyforge.functions.text import canonical_name, has_all_words, joined_name, starts_word, trigram_similarity
from tallyforge.operators.components import merged_names
from tallyforge.operators.order import ranked
from tallyforge.operators.similar import name_classes, similar_pairs
from tallyforge.operators.validate import Rule, validated
from tallyforge.plans import tools as T
from tallyforge.plans import views as V
from tallyforge.plans.sqlgate import describe_table, run_sql
from tallyforge.sources.store import files_to_load
from tallyforge.sources.tables import table
from tallyforge.streaming.ingest import receipts_per_window

FILER, YEAR, TODAY, VENDOR = 1290000, 2023, "2025-06-30", "Strategies"


class Warehouse:
    """The views over one folder of test tables.

    Where a source table of the warehouse is not among them, rows of another stand in
    for it: s497 and s498 are the rows of contribution_records that came from there,
    the filer of a filing follows from the committees its receipts name, rapid reports
    are the F461P5 lines of expn_cd, payments of lobbyists its G lines, and targeted
    expenditures are its other columns.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.t = spark, lambda name: table(spark, d, name)

    def rcpt(self) -> DataFrame:
        return V.deduped(self.t("rcpt_cd"), "rcpt_cd", ["row_id"])

    def expn(self) -> DataFrame:
        return V.deduped(self.t("expn_cd"), "expn_cd", ["row_id"])

    def _other(self, source: str) -> DataFrame:
        rows = self.t("contribution_records").where(F.lower(F.trim("source")) == source)
        rows = rows.select("filing_id", "amend_id", F.col("rec_id").alias("line_item"), "tran_id", "rcpt_date", "amount", "donor_name", F.lit(None).cast("string").alias("first"), "cmte_id", "memo_refno", F.col("rec_id").alias("row_id"), F.lit("F498-R").alias("form_type"))
        return V.deduped(rows, source, ["row_id"])

    def filer_filings(self) -> DataFrame:
        xref = self.t("filer_xref_cd").select(key_form(F.col("xref_id")).alias("k"), "filer_id").where("k is not null")
        return self.t("rcpt_cd").select("filing_id", key_form(F.col("cmte_id")).alias("k")).where("filing_id is not null").join(xref, "k").select("filing_id", "filer_id").distinct()

    def receipts(self, scope: DataFrame | None = None) -> DataFrame:
        s497 = self._other("s497_cd").withColumnsRenamed({"rcpt_date": "ctrib_date", "donor_name": "enty_naml", "first": "enty_namf"})
        s498 = self._other("s498_cd").withColumnsRenamed({"rcpt_date": "date_rcvd", "amount": "amt_rcvd", "donor_name": "payor_naml", "first": "payor_namf"})
        return V.receipts_all(self.rcpt(), s497, s498, V.filing_filer(self.filer_filings()), ["row_id"], scope)

    def rapid(self) -> DataFrame:
        rows = self.t("expn_cd").where("form_type = 'F461P5'").select("filing_id", "amend_id", "line_item", F.col("expn_date").alias("exp_date"), "amount", "expn_dscr", "row_id")
        return V.deduped(rows, "s496_cd", ["row_id"])

    def lexp(self) -> DataFrame:
        return V.deduped(self.t("expn_cd").where("form_type = 'G'").select("filing_id", "amend_id", "tran_id", "line_item", "form_type", "expn_date", "amount", "payee_naml", "payee_namf", "expn_dscr", "cmte_id", "row_id"), "lexp_cd", ["row_id"])

    def expn_all(self) -> DataFrame:
        rapid = self.rapid().withColumns({"tran_id": F.lit(None).cast("string"), "form_type": F.lit("F496")})
        return V.expn_all(self.expn(), self.lexp(), rapid, V.filing_filer(self.filer_filings()), ["row_id"])

    def scope(self) -> DataFrame:
        return T.scope_of(self.filer_filings(), str(FILER))

    def ie_raw(self) -> DataFrame:
        name = joined_name(F.col("payee_naml"), F.col("payee_namf"))
        return self.t("expn_cd").select(
            "row_id", F.col("cmte_id").alias("spender_id"), F.when(F.col("expn_code").isNotNull(), F.concat(F.lit("H"), F.substring(F.md5(canonical_name(name)), 1, 6))).alias("candidate_id"), name.alias("candidate_name"),
            F.when(F.col("line_item") % 2 == 0, "S").otherwise("O").alias("support_oppose"), F.col("amount").alias("expenditure_amount"), F.col("expn_date").alias("expenditure_date"), F.year("expn_date").alias("election_year"),
            F.concat(F.when(F.month("expn_date") <= 6, "P").otherwise("G"), F.year("expn_date").cast("string")).alias("election_type"), F.col("filing_id").cast("string").alias("file_number"),
            F.when(F.col("amend_id") > 0, "A").otherwise("N").alias("amendment_indicator"), F.col("tran_id").alias("transaction_id"), F.when(F.col("form_type") == "E", "F3X").when(F.col("form_type") == "D", "F24").otherwise("F5").alias("filing_form"),
            F.when(F.col("filing_id") % 3 == 0, "CA").otherwise("NY").alias("office_state"), (F.col("filing_id") % 4).cast("string").alias("office_district"), F.col("expn_dscr").alias("purpose"), F.col("expn_code").alias("payee"),
        )

    def ie(self) -> DataFrame:
        return V.ie_resolved(V.ie_dedup(self.ie_raw(), "row_id"))


QUERIES: dict = {}
SQL: dict[str, str] = {}

BASE = """
WITH rcpt AS (SELECT * FROM rcpt_cd QUALIFY row_number() OVER (PARTITION BY {att}, CASE WHEN {att} THEN cmte_id END, CASE WHEN {att} THEN tran_id END, CASE WHEN NOT {att} THEN filing_id END, CASE WHEN NOT {att} THEN line_item END ORDER BY amend_id DESC NULLS FIRST, filing_id NULLS LAST, line_item NULLS LAST, row_id) = 1),
expn AS (SELECT * FROM expn_cd QUALIFY row_number() OVER (PARTITION BY {att}, CASE WHEN {att} THEN cmte_id END, CASE WHEN {att} THEN tran_id END, CASE WHEN NOT {att} THEN filing_id END, CASE WHEN NOT {att} THEN line_item END ORDER BY amend_id DESC NULLS FIRST, filing_id NULLS LAST, line_item NULLS LAST, row_id) = 1),
others AS (SELECT lower(trim(source)) AS src, filing_id, amend_id, rec_id AS line_item, tran_id, rcpt_date, amount, donor_name, cmte_id, memo_refno, rec_id AS row_id FROM contribution_records WHERE lower(trim(source)) IN ('s497_cd', 's498_cd')),
other_dd AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY src, {att}, CASE WHEN {att} THEN cmte_id END, CASE WHEN {att} THEN tran_id END, CASE WHEN NOT {att} THEN filing_id END, CASE WHEN NOT {att} THEN line_item END ORDER BY amend_id DESC NULLS FIRST, filing_id NULLS LAST, line_item NULLS LAST, row_id) = 1),
filer_filings AS (SELECT DISTINCT r.filing_id, x.filer_id FROM rcpt_cd r JOIN filer_xref_cd x ON {rk} = {xk} WHERE r.filing_id IS NOT NULL),
filing_filer AS (SELECT filing_id, CAST(min(filer_id) AS VARCHAR) AS filer_id FROM filer_filings GROUP BY 1),
scope AS (SELECT DISTINCT filing_id FROM filer_filings WHERE filer_id = {filer}),
receipt_rows AS (
  SELECT 'rcpt_cd' AS src, filing_id, amend_id, tran_id, CAST(line_item AS BIGINT) AS line_item, rcpt_date AS receipt_date, amount, coalesce(ctrib_naml, '') AS donor_naml, coalesce(ctrib_namf, '') AS donor_namf, ctrib_dscr, cmte_id AS raw_cmte, row_id FROM rcpt
  UNION ALL SELECT src, filing_id, amend_id, tran_id, line_item, rcpt_date, amount, coalesce(donor_name, ''), '', NULL, cmte_id, row_id FROM other_dd WHERE src = 's497_cd' OR amount IS NOT NULL),
receipt_named AS (
  SELECT b.*, coalesce(nullif(raw_cmte, ''), f.filer_id) AS cmte_id, coalesce(nullif(trim(donor_naml || ' ' || donor_namf), ''), ctrib_dscr) AS donor_name FROM receipt_rows b LEFT JOIN filing_filer f USING (filing_id)),
receipts AS (
  SELECT *, coalesce(donor_name, cmte_id) AS donor_key FROM receipt_named
  QUALIFY row_number() OVER (PARTITION BY src, filing_id, line_item, coalesce(tran_id, '') ORDER BY coalesce(trim(raw_cmte) <> '', false) DESC, amend_id DESC NULLS FIRST, row_id) = 1),
rapid AS (SELECT filing_id, amend_id, line_item, expn_date AS exp_date, amount, expn_dscr, row_id FROM expn_cd WHERE form_type = 'F461P5' QUALIFY row_number() OVER (PARTITION BY filing_id, line_item ORDER BY amend_id DESC NULLS FIRST, row_id) = 1),
lexp AS (SELECT * FROM expn_cd WHERE form_type = 'G' QUALIFY row_number() OVER (PARTITION BY filing_id, line_item ORDER BY amend_id DESC NULLS FIRST, row_id) = 1),
expn_rows AS (
  SELECT 'expn_cd' AS src, filing_id, amend_id, tran_id, line_item, form_type, expn_date, amount, payee_naml, payee_namf, expn_dscr, cmte_id AS raw_cmte, row_id FROM expn
  UNION ALL SELECT 'lexp_cd', filing_id, amend_id, tran_id, line_item, form_type, expn_date, amount, payee_naml, payee_namf, expn_dscr, cmte_id, row_id FROM lexp
  UNION ALL SELECT 's496_cd', filing_id, amend_id, NULL, line_item, 'F496', exp_date, amount, NULL, NULL, expn_dscr, NULL, row_id FROM rapid),
expns AS (
  SELECT b.*, coalesce(nullif(raw_cmte, ''), f.filer_id) AS cmte_id, nullif(trim(coalesce(payee_naml, '') || ' ' || coalesce(payee_namf, '')), '') AS payee_name, year(expn_date) AS cycle FROM expn_rows b LEFT JOIN filing_filer f USING (filing_id)
  QUALIFY row_number() OVER (PARTITION BY src, filing_id, line_item, coalesce(tran_id, '') ORDER BY coalesce(trim(raw_cmte) <> '', false) DESC, amend_id DESC NULLS FIRST, row_id) = 1),
names AS (SELECT * FROM filername_cd QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY effect_dt DESC NULLS LAST, id DESC, source_file DESC NULLS LAST, line_no DESC NULLS LAST) = 1),
filer_name AS (SELECT filer_id, nullif(trim(coalesce(naml, '') || ' ' || coalesce(namf, '')), '') AS n FROM names),
cmte_filer AS (SELECT * FROM filer_xref_cd QUALIFY row_number() OVER (PARTITION BY xref_id ORDER BY effect_dt DESC NULLS LAST, filer_id) = 1),
filer_cmte AS (SELECT * FROM filer_xref_cd QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY effect_dt DESC NULLS LAST, xref_id) = 1),
ie_raw AS (
  SELECT row_id, cmte_id AS spender_id, CASE WHEN expn_code IS NOT NULL THEN 'H' || substr(md5({canon}), 1, 6) END AS candidate_id, {pname} AS candidate_name, CASE WHEN line_item % 2 = 0 THEN 'S' ELSE 'O' END AS support_oppose,
    amount AS expenditure_amount, expn_date AS expenditure_date, year(expn_date) AS election_year, CASE WHEN month(expn_date) <= 6 THEN 'P' ELSE 'G' END || CAST(year(expn_date) AS VARCHAR) AS election_type, CAST(filing_id AS VARCHAR) AS file_number,
    CASE WHEN amend_id > 0 THEN 'A' ELSE 'N' END AS amendment_indicator, tran_id AS transaction_id, CASE form_type WHEN 'E' THEN 'F3X' WHEN 'D' THEN 'F24' ELSE 'F5' END AS filing_form, CASE WHEN filing_id % 3 = 0 THEN 'CA' ELSE 'NY' END AS office_state, CAST(filing_id % 4 AS VARCHAR) AS office_district, expn_dscr AS purpose, expn_code AS payee,
    {canon} AS ckey FROM expn_cd),
ie_l1 AS (
  SELECT * FROM ie_raw WHERE transaction_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY spender_id, transaction_id ORDER BY CASE filing_form WHEN 'F3X' THEN 0 WHEN 'F5' THEN 1 WHEN 'F24' THEN 2 ELSE 3 END, expenditure_amount DESC NULLS FIRST, row_id) = 1
  UNION ALL SELECT * FROM ie_raw WHERE transaction_id IS NULL),
ie_n AS (SELECT *, count(*) OVER (PARTITION BY spender_id, candidate_id, expenditure_date, expenditure_amount, file_number) AS fn FROM ie_l1),
ie_k AS (SELECT *, max(fn) OVER (PARTITION BY spender_id, candidate_id, expenditure_date, expenditure_amount) AS keep_n, row_number() OVER (PARTITION BY spender_id, candidate_id, expenditure_date, expenditure_amount ORDER BY CASE amendment_indicator WHEN 'A' THEN 0 ELSE 1 END, file_number DESC NULLS LAST, transaction_id NULLS LAST, row_id) AS rn FROM ie_n),
ie_dedup AS (SELECT * FROM ie_k WHERE rn <= keep_n),
ie_nm AS (SELECT ckey, min(candidate_id) AS cid, count(DISTINCT candidate_id) AS n_ids FROM ie_dedup WHERE candidate_id IS NOT NULL AND candidate_name IS NOT NULL GROUP BY 1),
ie_r AS (SELECT d.*, coalesce(candidate_id, CASE WHEN n_ids = 1 THEN cid END) AS resolved_candidate_id FROM ie_dedup d LEFT JOIN ie_nm USING (ckey)),
ie_shown AS (SELECT resolved_candidate_id, candidate_name AS display_name FROM (SELECT resolved_candidate_id, candidate_name, count(*) AS c FROM ie_r WHERE resolved_candidate_id IS NOT NULL AND candidate_name IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY resolved_candidate_id ORDER BY c DESC, candidate_name) = 1),
ie AS (SELECT r.*, coalesce(s.display_name, r.candidate_name) AS resolved_candidate_name FROM ie_r r LEFT JOIN ie_shown s USING (resolved_candidate_id))
"""
_PNAME = "nullif(trim(coalesce(payee_naml, '') || ' ' || coalesce(payee_namf, '')), '')"
_CANON = "array_to_string(list_sort(list_filter(string_split(upper(regexp_replace(coalesce({0}, ''), '[^A-Za-z ]', ' ', 'g')), ' '), lambda x: x <> '')), ' ')"
_KEYF = "CASE WHEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') SIMILAR TO '.*[0-9].*' THEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') END"
BASE = BASE.format(att="(cmte_id IS NOT NULL AND coalesce(trim(tran_id) <> '', false))", rk=_KEYF.format("r.cmte_id"), xk=_KEYF.format("x.xref_id"), filer=FILER, canon=_CANON.format(_PNAME), pname=_PNAME)
_M = "CAST(round(coalesce({0}, 0), 2) AS DOUBLE)"
_GIFT = "SELECT *, row_number() OVER (PARTITION BY donor_key, receipt_date, amount ORDER BY CASE src WHEN 'rcpt_cd' THEN 0 WHEN 's497_cd' THEN 1 ELSE 2 END, tran_id NULLS LAST, filing_id NULLS LAST, row_id) AS rn, max(src_n) OVER (PARTITION BY donor_key, receipt_date, amount) AS keep_n FROM (SELECT *, count(*) OVER (PARTITION BY donor_key, receipt_date, amount, src) AS src_n FROM receipts WHERE donor_key IS NOT NULL AND receipt_date IS NOT NULL AND amount IS NOT NULL AND {0})"
_FORAG = f"{_M.format(chr(39).join(['sum(expenditure_amount) FILTER (WHERE support_oppose = ', 'S', ')']))} AS for_total, {_M.format(chr(39).join(['sum(expenditure_amount) FILTER (WHERE support_oppose = ', 'O', ')']))} AS against_total, count(*) FILTER (WHERE support_oppose = 'S') AS for_count, count(*) FILTER (WHERE support_oppose = 'O') AS against_count"
_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = "CAST(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END AS FLOAT)"


#: Memos of refunds as filers of the state word them; those of the test tables name only the check.
_MEMO = ("^Refund, check ([0-9]*[02468])$", "Refund of contribution, check $1")
_MEMO_SQL = "regexp_replace(expn_dscr, '^Refund, check ([0-9]*[02468])$', 'Refund of contribution, check \\1')"
_IS_REFUND = f"coalesce(regexp_matches(lower(trim({_MEMO_SQL})), '(return|rtn|refund)[^a-z]+(of[^a-z]+)?(over-?contrib|contrib)'), false)"


def query(sql: str | None, base: bool = True):
    """Registers a function of a Warehouse as a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Warehouse(spark, d))
        if sql is not None:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return register


@query("SELECT row_id, CAST(filing_id AS VARCHAR) AS filing_id, line_item, amend_id FROM rcpt")
def dedup_two_branch_receipts(w):
    return w.rcpt().select("row_id", F.col("filing_id").cast("string"), "line_item", "amend_id")


@query("SELECT row_id, CAST(filing_id AS VARCHAR) AS filing_id, line_item, amend_id FROM expn")
def dedup_two_branch_expenditures(w):
    return w.expn().select("row_id", F.col("filing_id").cast("string"), "line_item", "amend_id")


@query("SELECT row_id, exp_date, CAST(amount AS DOUBLE) AS amount FROM rapid")
def dedup_slot_only(w):
    return w.rapid().select("row_id", "exp_date", F.col("amount").cast("double"))


@query("SELECT filing_id, filer_id FROM filing_filer")
def min_filer_per_filing(w):
    return V.filing_filer(w.filer_filings())


@query("SELECT src, row_id, CAST(filing_id AS VARCHAR) AS filing_id, receipt_date, CAST(amount AS DOUBLE) AS amount, cmte_id, donor_key, donor_name FROM receipts")
def receipts_all(w):
    return w.receipts().select("src", "row_id", F.col("filing_id").cast("string"), "receipt_date", F.col("amount").cast("double").alias("amount"), "cmte_id", "donor_key", "donor_name")


@query("SELECT src, row_id, cmte_id, payee_name, CAST(cycle AS VARCHAR) AS cycle FROM expns")
def expn_all(w):
    return w.expn_all().select("src", "row_id", "cmte_id", "payee_name", F.col("cycle").cast("string"))


@query(f"SELECT src, row_id FROM ({_GIFT.format('true')}) WHERE rn <= keep_n")
def keep_max_per_source(w):
    return T.gifts_once(w.receipts(), "row_id").select("src", "row_id")


@query("SELECT row_id, spender_id, candidate_id, filing_form FROM ie_dedup")
def form_priority_refile_dedup(w):
    return V.ie_dedup(w.ie_raw(), "row_id").select("row_id", "spender_id", "candidate_id", "filing_form")


@query("SELECT row_id, resolved_candidate_id, resolved_candidate_name FROM ie")
def name_fold_resolved(w):
    return w.ie().select("row_id", "resolved_candidate_id", "resolved_candidate_name")


@query("SELECT filing_id, loaded_at FROM filings_cd WHERE deleted_at IS NULL", base=False)
def current_rows(w):
    return V.current(w.t("filings_cd")).select("filing_id", "loaded_at")


@query("SELECT filer_id, n AS name FROM filer_name")
def latest_name_per_filer(w):
    return V.filer_names(w.t("filername_cd")).select("filer_id", joined_name(F.col("naml"), F.col("namf")).alias("name"))


@query("SELECT filer_id, naml FROM filername_cd QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY effect_dt DESC NULLS FIRST, id DESC, source_file DESC NULLS LAST, line_no DESC NULLS LAST) = 1", base=False)
def latest_name_undated_first(w):
    return V.filer_names(w.t("filername_cd"), nulls_first=True).select("filer_id", "naml")


@query("SELECT x.xref_id, f.n AS committee FROM cmte_filer x JOIN filer_name f USING (filer_id)")
def committee_names(w):
    return V.committee_names(w.t("filer_xref_cd"), w.t("filername_cd"))


@query("SELECT 'receipt' AS flow, donor_key AS from_id, cmte_id AS to_id, receipt_date AS flow_date, CAST(amount AS DOUBLE) AS amount FROM receipts UNION ALL SELECT 'payment', cmte_id, payee_name, expn_date, CAST(amount AS DOUBLE) FROM expns UNION ALL SELECT 'independent_expenditure', spender_id, resolved_candidate_id, expenditure_date, CAST(expenditure_amount AS DOUBLE) FROM ie WHERE office_state = 'CA'")
def money_flows_union(w):
    flows = V.money_flows(("receipt", w.receipts(), "donor_key", "cmte_id", "receipt_date", "amount"), ("payment", w.expn_all(), "cmte_id", "payee_name", "expn_date", "amount"), ("independent_expenditure", w.ie().where("office_state = 'CA'"), "spender_id", "resolved_candidate_id", "expenditure_date", "expenditure_amount"))
    return flows.withColumn("amount", F.col("amount").cast("double"))


_DONOR = "(donor_naml ILIKE '%candaskulez%' OR coalesce(ctrib_dscr ILIKE '%candaskulez%', false))"


@query(f"SELECT src, row_id, receipt_date, CAST(amount AS DOUBLE) AS amount, donor_name FROM ({_GIFT.format(_DONOR + f' AND year(receipt_date) = {YEAR}')}) WHERE rn <= keep_n ORDER BY receipt_date DESC, amount DESC, row_id LIMIT 500")
def contributions_by_donor(w):
    return T.contributions_by_donor(w.receipts(), "candaskulez", YEAR, "row_id").select("src", "row_id", "receipt_date", F.col("amount").cast("double").alias("amount"), "donor_name")


@query(f"SELECT src, row_id, receipt_date FROM ({_GIFT.format(_DONOR + chr(32) + 'AND receipt_date >= TIMESTAMP ' + chr(39) + '2024-01-01' + chr(39))}) WHERE rn <= keep_n ORDER BY receipt_date DESC, amount DESC, row_id LIMIT 500")
def donor_watch_since(w):
    return T.donor_watch_since(w.receipts(), "candaskulez", "2024-01-01", "row_id").select("src", "row_id", "receipt_date")


_ALIASES = "SELECT DISTINCT fullname FROM entity WHERE fullname ILIKE '%growers%' ORDER BY 1 LIMIT 50"
_ALIASED = f"(donor_naml ILIKE '%vintners%' OR coalesce(ctrib_dscr ILIKE '%vintners%', false) OR donor_naml IN ({_ALIASES}) OR coalesce(ctrib_dscr IN ({_ALIASES}), false)) AND receipt_date >= TIMESTAMP '2024-01-01'"


@query(f"SELECT src, row_id, receipt_date FROM ({_GIFT.format(_ALIASED)}) WHERE rn <= keep_n ORDER BY receipt_date DESC, amount DESC, row_id LIMIT 500")
def donor_watch_with_aliases(w):
    known = T.alias_names(w.t("entity").select(F.col("fullname").alias("alias_name")), "growers")
    return T.donor_watch_since(w.receipts(), "vintners", "2024-01-01", "row_id", known).select("src", "row_id", "receipt_date")


_VERSIONS = "SELECT '{0}' AS table_name, row_id FROM expn_cd WHERE form_type = '{1}' QUALIFY row_number() OVER (PARTITION BY {2} ORDER BY amend_id DESC NULLS FIRST, filing_id NULLS LAST, line_item NULLS LAST, row_id) = 1"
_ATT = "(cmte_id IS NOT NULL AND coalesce(trim(tran_id) <> '', false))"
_TWO = f"{_ATT}, CASE WHEN {_ATT} THEN cmte_id END, CASE WHEN {_ATT} THEN tran_id END, CASE WHEN NOT {_ATT} THEN filing_id END, CASE WHEN NOT {_ATT} THEN line_item END"
_OTHERS = {"loan_cd": "D", "debt_cd": "G", "splt_cd": "D", "text_memo_cd": "G"}


@query(" UNION ALL ".join(_VERSIONS.format(t, f, "filing_id, line_item" if t in V.SLOT_ONLY else _TWO) for t, f in _OTHERS.items()), base=False)
def dedup_other_tables(w):
    parts = [V.deduped(w.t("expn_cd").where(F.col("form_type") == f), t, ["row_id"]).select(F.lit(t).alias("table_name"), "row_id") for t, f in _OTHERS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT s_name, s_nationkey, true AS truncated FROM supplier WHERE s_acctbal > 0 ORDER BY s_name LIMIT 3", base=False)
def guarded_sql(w):
    w.t("supplier").createOrReplaceTempView("gate_supplier")
    got = run_sql(w.spark, "WITH s AS (SELECT * FROM gate_supplier WHERE s_acctbal > 0) SELECT s_name, s_nationkey FROM s ORDER BY s_name", 3)
    return w.spark.createDataFrame([(r["s_name"], r["s_nationkey"], got["truncated"]) for r in got["rows"]], "s_name string, s_nationkey int, truncated boolean")


@query("SELECT 'rcpt_cd' AS table_name, ordinal_position AS position, column_name, (SELECT count(*) FROM rcpt_cd) AS row_count FROM information_schema.columns WHERE table_name = 'rcpt_cd'", base=False)
def described_table(w):
    return describe_table(w.t("rcpt_cd"), "rcpt_cd").select("table_name", "position", "column_name", "row_count")


_KEPT = "SELECT donor_key, receipt_date, amount, max(dn) AS donor_name, max(cm) AS cmte_id, max(src_n) AS keep_n FROM (SELECT donor_key, receipt_date, amount, src, count(*) AS src_n, max(nullif(donor_name, '')) AS dn, max(cmte_id) AS cm FROM receipts SEMI JOIN scope USING (filing_id) WHERE {0} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"


@query(
    f"SELECT coalesce(nullif(trim(donor_name), ''), f.n, k.cmte_id, '(unknown)') AS donor_name, CAST(sum(keep_n) AS BIGINT) AS contributions, {_M.format('sum(keep_n * amount)')} AS total FROM ({_KEPT.format(f'year(receipt_date) = {YEAR}')}) k "
    "LEFT JOIN (SELECT x.xref_id, n FROM cmte_filer x JOIN filer_name USING (filer_id)) f ON f.xref_id = k.cmte_id GROUP BY 1 ORDER BY total DESC, donor_name LIMIT 10"
)
def top_donors(w):
    return T.top_donors(w.receipts(w.scope()), w.scope(), YEAR, w.t("filer_xref_cd"), w.t("filername_cd"))


_VEND = f"regexp_matches(coalesce({_PNAME}, ''), '(?i)\\bStrategies')"


@query(f"SELECT row_id, expn_date, coalesce({_PNAME}, '') AS payee_name FROM expn SEMI JOIN scope USING (filing_id) WHERE form_type IN ('E', 'F461P5') AND year(expn_date) = {YEAR} AND {_VEND} ORDER BY expn_date DESC, row_id LIMIT 50")
def committee_outlays_to(w):
    return T.committee_outlays_to(w.expn(), w.scope(), VENDOR, YEAR, "row_id").select("row_id", "expn_date", "payee_name")


@query(f"SELECT coalesce({_PNAME}, '(unknown payee)') AS vendor_name, count(*) AS payments, {_M.format('sum(amount)')} AS total FROM expn WHERE form_type IN ('E', 'F461P5') AND {_VEND} GROUP BY 1 ORDER BY total DESC, vendor_name LIMIT 20")
def vendor_revenue(w):
    return T.vendor_revenue(w.expn(), VENDOR)


@query(f"SELECT coalesce(f.n, '(unknown)') AS committee, c.xref_id AS cmte_id, count(*) AS payments, {_M.format('sum(amount)')} AS total FROM expn e JOIN filer_filings ff USING (filing_id) LEFT JOIN filer_name f ON f.filer_id = ff.filer_id LEFT JOIN filer_cmte c ON c.filer_id = ff.filer_id WHERE {_VEND} GROUP BY 1, 2 ORDER BY total DESC, committee, cmte_id NULLS LAST LIMIT 10")
def committees_paying_vendor(w):
    return T.committees_paying_vendor(w.expn(), w.filer_filings(), w.t("filer_xref_cd"), w.t("filername_cd"), VENDOR)


@query(
    f"SELECT r.*, e.*, strftime(l.d, '%Y-%m-%d') AS last_activity FROM (SELECT {_M.format('sum(keep_n * amount)')} AS total_receipts, CAST(coalesce(sum(keep_n), 0) AS BIGINT) AS receipts FROM ({_KEPT.format('true')})) r, "
    f"(SELECT {_M.format('sum(amount)')} AS total_expenditures, count(*) AS expenditures FROM expn SEMI JOIN scope USING (filing_id)) e, "
    f"(SELECT max(d) AS d FROM (SELECT receipt_date AS d FROM receipts SEMI JOIN scope USING (filing_id) UNION ALL SELECT expn_date FROM expn SEMI JOIN scope USING (filing_id)) WHERE d <= TIMESTAMP '{TODAY}') l"
)
def committee_profile(w):
    return T.committee_profile(w.receipts(w.scope()), w.expn(), w.scope(), TODAY)


@query(
    f"SELECT count(*) AS transaction_count, {_M.format('sum(amount)')} AS total_amount, nullif(array_to_string(list_sort(list_distinct(list(form_type))), ','), '') AS form_types, {_M.format(chr(39).join(['sum(amount) FILTER (WHERE form_type = ', 'D', ')']))} AS form_d_total, {_M.format(chr(39).join(['sum(amount) FILTER (WHERE form_type IN (', 'E', ', ', 'F461P5', '))']))} AS form_e_total "
    f"FROM (SELECT *, coalesce(form_type IN ('E', 'F461P5') AND year(expn_date) = {YEAR}, false) AS v, count(*) FILTER (WHERE form_type IN ('E', 'F461P5') AND year(expn_date) = {YEAR}) OVER (PARTITION BY filing_id) AS n FROM expn SEMI JOIN scope USING (filing_id)) WHERE v OR (form_type = 'D' AND year(expn_date) = {YEAR} AND n = 0)"
)
def total_expenditures(w):
    return T.total_expenditures(w.expn(), w.scope(), YEAR)


def _worded(w: Warehouse) -> DataFrame:
    return w.expn().withColumn("expn_dscr", F.regexp_replace("expn_dscr", *_MEMO))


@query(f"SELECT coalesce({_PNAME}, '(unknown)') AS recipient, count(*) AS refunds, {_M.format('sum(amount)')} AS total, max(expn_date) AS last_refund FROM expn SEMI JOIN scope USING (filing_id) WHERE year(expn_date) = {YEAR} AND {_IS_REFUND} GROUP BY 1 ORDER BY total DESC, recipient LIMIT 50")
def refunds_to_donors(w):
    return T.refunds_to_donors(_worded(w), w.scope(), YEAR)


@query(f"SELECT count(*) AS refund_lines, {_M.format('sum(amount)')} AS total_refunded, min(expn_date) AS first_refund, max(expn_date) AS last_refund FROM expn SEMI JOIN scope USING (filing_id) WHERE year(expn_date) = {YEAR} AND {_IS_REFUND}")
def refund_summary(w):
    return T.refund_summary(_worded(w), w.scope(), YEAR)


@query(f"SELECT row_id, payee_name FROM (SELECT row_id, coalesce({_PNAME}, '') AS payee_name, expn_date, expn_dscr FROM expn SEMI JOIN scope USING (filing_id) WHERE form_type IN ('E', 'F461P5') AND year(expn_date) = {YEAR}) WHERE NOT {_IS_REFUND} AND regexp_matches(payee_name, '(?i)\\b[A-Z]') AND regexp_matches(payee_name, '(?i)\\bCo') ORDER BY expn_date DESC, row_id LIMIT 50")
def committee_outlays_without_refunds(w):
    return T.committee_outlays_to(_worded(w), w.scope(), "Co", YEAR, "row_id", exclude_refunds=True).select("row_id", "payee_name")


@query("SELECT DISTINCT x.xref_id, concat_ws(', ', nullif(trim(naml), ''), nullif(concat_ws(' ', nullif(trim(namf), ''), nullif(trim(namt), ''), nullif(trim(nams), '')), '')) AS name FROM filername_cd n JOIN filer_xref_cd x USING (filer_id) WHERE naml ILIKE '%nurses%' ORDER BY name, xref_id LIMIT 10", base=False)
def find_committees(w):
    return T.find_committees(w.t("filername_cd"), w.t("filer_xref_cd"), "nurses")


_KNOWN = "(SELECT CAST(expn_date AS DATE) AS day, amount, array_to_string(list_sort(list_distinct(list(p))), '; ') AS payees FROM (SELECT *, substr(trim(" + _PNAME + "), 1, 120) AS p FROM expn) WHERE p IS NOT NULL AND form_type <> 'F461P5' GROUP BY 1, 2)"


@query(f"SELECT filing_id, line_item, strftime(exp_date, '%Y-%m-%d') AS day, CAST(r.amount AS DOUBLE) AS amount, substr(trim(expn_dscr), 1, 120) AS description, payees, payees IS NOT NULL AS resolved FROM rapid r LEFT JOIN {_KNOWN} k ON k.day = CAST(r.exp_date AS DATE) AND k.amount = r.amount")
def rapid_expense_resolution(w):
    lines = T.rapid_expense_vendors(w.rapid(), w.expn().where("form_type <> 'F461P5'"), limit=2_000_000_000)
    return lines.withColumns({"amount": F.col("amount").cast("double"), "day": F.date_format("day", "yyyy-MM-dd")})


@query(f"SELECT coalesce(trim(expn_dscr), '(none)') AS description, count(*) AS lines, {_M.format('sum(r.amount)')} AS total, max(exp_date) AS newest FROM rapid r ANTI JOIN {_KNOWN} k ON k.day = CAST(r.exp_date AS DATE) AND k.amount = r.amount GROUP BY 1")
def unresolved_rapid_lines(w):
    return T.unresolved_rapid_lines(w.rapid(), w.expn().where("form_type <> 'F461P5'"))


_WORDS = "regexp_matches({0}, '(?i)\\bNURSES\\b') AND regexp_matches({0}, '(?i)\\bCOMMITTEE\\b')"


@query(f"SELECT side, CAST(year AS VARCHAR) AS year, count(*) AS records, {_M.format('sum(amount)')} AS total FROM (SELECT 'gift' AS side, year(receipt_date) AS year, amount FROM receipts WHERE {_WORDS.format('concat_ws(chr(32), donor_naml, donor_namf)')} UNION ALL SELECT 'payment', year(expn_date), amount FROM expns WHERE {_WORDS.format('concat_ws(chr(32), payee_naml, payee_namf)')}) GROUP BY 1, 2")
def name_search_by_year(w):
    return T.name_search(w.receipts(), w.expn_all(), "committee nurses").withColumn("year", F.col("year").cast("string"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_until FROM orders WHERE date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 30", base=False)
def upcoming_filings(w):
    return T.upcoming(w.t("orders"), "o_orderdate", "1996-06-30", 30).select("o_orderkey", "days_until")


@query("SELECT o_orderpriority AS report_type, CAST(o_orderdate AS DATE)::VARCHAR AS deadline, CAST(date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_until, o_orderkey FROM orders WHERE date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 7", base=False)
def filing_due_soon(w):
    due = T.due_soon(w.t("orders").withColumnsRenamed({"o_orderpriority": "report_type", "o_orderdate": "deadline_date"}), "1996-06-30", ["o_orderkey"])
    return due.select("report_type", F.col("deadline_date").cast("date").cast("string").alias("deadline"), "days_until", "o_orderkey")


@query("SELECT lower(trim(table_name)) AS table_name, source, count(*) AS files, CAST(coalesce(sum(rows_processed), 0) AS BIGINT) AS records, max(processed_date) AS last_load FROM load_checkpoint WHERE rows_processed > 0 GROUP BY 1, 2", base=False)
def last_loads(w):
    return T.last_loads(w.t("load_checkpoint"))


@query(f"SELECT 'rcpt_cd' AS table_name, count(*) AS row_count, max(rcpt_date) FILTER (WHERE rcpt_date <= TIMESTAMP '{TODAY}') AS newest, count(*) FILTER (WHERE rcpt_date > TIMESTAMP '{TODAY}') AS future_dates FROM rcpt_cd UNION ALL SELECT 'expn_cd', count(*), max(expn_date) FILTER (WHERE expn_date <= TIMESTAMP '{TODAY}'), count(*) FILTER (WHERE expn_date > TIMESTAMP '{TODAY}') FROM expn_cd", base=False)
def freshness_capped(w):
    return T.freshness([("rcpt_cd", w.t("rcpt_cd"), "rcpt_date"), ("expn_cd", w.t("expn_cd"), "expn_date")], TODAY)


def merged_sql(names: str) -> str:
    """Common table expressions that end in grp (node, g): names by word sets that contain one another, reached step by step."""
    words = "list_distinct(list_filter(string_split(regexp_replace(upper(regexp_replace(node, '(?i)\\bFOR\\s+(?:SENATE|ASSEMBLY|SUPERIOR|COURT|STATE)\\s+[0-9]{4}\\b', ' ', 'g')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"
    return (
        f"nm AS (SELECT DISTINCT trim(x) AS node FROM ({names}) WHERE trim(x) <> ''), tk AS (SELECT node, {words} AS t FROM nm), ed AS (SELECT a.node AS a, b.node AS b FROM tk a JOIN tk b ON a.node <> b.node AND len(a.t) >= 2 AND list_has_all(b.t, a.t)), "
        "sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT node AS a, node AS b FROM nm UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b), grp AS (SELECT a AS node, min(b) AS g FROM reach GROUP BY 1)"
    )


RECURSIVE = BASE.replace("WITH rcpt", "WITH RECURSIVE rcpt", 1)
_RACE_LINES = "ln AS (SELECT e.payee_name AS candidate, CASE WHEN e.line_item % 2 = 0 THEN 'S' ELSE 'O' END AS side, e.amount, f.filer_id FROM expns e JOIN (SELECT filing_id, min(filer_id) AS filer_id FROM filer_filings GROUP BY 1) f USING (filing_id) WHERE e.payee_name IS NOT NULL), "
_SHOWN = "rw AS (SELECT l.*, trim(l.candidate) AS c, g FROM ln l JOIN grp ON node = trim(l.candidate)), sh AS (SELECT g, c AS shown FROM (SELECT g, c, count(*) AS n FROM rw GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, c DESC) = 1)"
_OLD_NAMES = "onm AS (SELECT * FROM filername_cd QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY effect_dt DESC NULLS FIRST, id DESC, source_file DESC NULLS LAST, line_no DESC NULLS LAST) = 1)"


@query(
    RECURSIVE.rstrip() + ", " + _RACE_LINES + merged_sql("SELECT candidate AS x FROM ln") + ", " + _SHOWN + ", " + _OLD_NAMES
    + f", sp AS (SELECT g, side, coalesce(nullif(trim(coalesce(naml, '') || ' ' || coalesce(namf, '')), ''), '(unknown)') AS spender, sum(amount) AS s, count(*) AS n FROM rw LEFT JOIN onm USING (filer_id) GROUP BY 1, 2, 3), sd AS (SELECT g, side, sum(amount) AS ss, count(*) AS sn FROM rw GROUP BY 1, 2) "
    f"SELECT shown AS candidate, side, spender, {_M.format('s')} AS spender_total, n AS spender_lines, {_M.format('ss')} AS side_total, sn AS side_lines FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY g, side ORDER BY s DESC NULLS LAST, spender) <= 3) JOIN sd USING (g, side) JOIN sh USING (g)",
    base=False,
)
def race_overview(w):
    lines = w.expn_all().join(w.filer_filings().groupBy("filing_id").agg(F.min("filer_id").alias("filer_id")), "filing_id").where("payee_name is not null")
    return T.race_overview(lines.select(F.col("payee_name").alias("candidate"), F.when(F.col("line_item") % 2 == 0, "S").otherwise("O").alias("side"), "amount", "filer_id"), w.t("filername_cd"), 3)


@query(f"SELECT resolved_candidate_id AS candidate_id, {_FORAG}, round(for_total - against_total, 2) AS net FROM ie WHERE resolved_candidate_id IS NOT NULL AND election_year = {YEAR} AND election_type[1] = 'G' GROUP BY 1")
def ie_summary(w):
    return T.ie_summary(w.ie(), YEAR, "general")


@query(f"SELECT t.*, f.n AS committee FROM (SELECT spender_id, count(*) AS records, {_M.format('sum(expenditure_amount)')} AS total FROM ie WHERE support_oppose = 'O' GROUP BY 1 ORDER BY total DESC, spender_id NULLS LAST LIMIT 5) t LEFT JOIN (SELECT x.xref_id, n FROM cmte_filer x JOIN filer_name USING (filer_id)) f ON f.xref_id = t.spender_id")
def ie_top_spending(w):
    return T.ie_top_spending(w.ie(), "O", V.committee_names(w.t("filer_xref_cd"), w.t("filername_cd")).withColumnRenamed("xref_id", "spender_id"))


@query("SELECT face, value, count(*) AS records, " + _M.format("sum(expenditure_amount)") + " AS total FROM (SELECT 'payee' AS face, coalesce(payee, '(none)') AS value, expenditure_amount FROM ie WHERE spender_id = '9210883' UNION ALL SELECT 'purpose', coalesce(purpose, '(none)'), expenditure_amount FROM ie WHERE spender_id = '9210883' UNION ALL SELECT 'target', coalesce(resolved_candidate_name, '(none)'), expenditure_amount FROM ie WHERE spender_id = '9210883') GROUP BY 1, 2")
def ie_spender_breakdown(w):
    return T.ie_breakdown(w.ie().where("spender_id = '9210883'"))


@query(f"SELECT resolved_candidate_id AS candidate_id, resolved_candidate_name AS candidate_name, {_FORAG} FROM ie WHERE office_state = 'CA' AND resolved_candidate_id IS NOT NULL GROUP BY 1, 2 ORDER BY for_total + against_total DESC, candidate_id LIMIT 50")
def ie_race_overview(w):
    return T.ie_race(w.ie(), "CA")


@query(f"SELECT spender_id, resolved_candidate_id AS candidate_id, support_oppose, {_M.format('sum(expenditure_amount)')} AS total, count(*) AS records, max(resolved_candidate_name) AS candidate_name, CASE support_oppose WHEN 'S' THEN 'supporting ' ELSE 'opposing ' END || coalesce(max(resolved_candidate_name), '(unnamed)') AS sentence FROM ie WHERE resolved_candidate_id IS NOT NULL GROUP BY 1, 2, 3 HAVING total > 1000")
def ie_by_org(w):
    return T.ie_by_org(w.ie(), 1000)


_NSIM = _SIM.format(a=_TRI.format("resolved_candidate_name"), b=_TRI.format("'nurses'"))


@query(f"SELECT resolved_candidate_id AS candidate_id, max(resolved_candidate_name) AS candidate_name, count(*) AS ie_records, round(CAST(max(m) AS DOUBLE), 6) AS match FROM (SELECT *, {_NSIM} AS m FROM ie WHERE resolved_candidate_id IS NOT NULL) WHERE resolved_candidate_name ILIKE '%nurses%' OR m >= CAST(0.3 AS FLOAT) GROUP BY 1 ORDER BY match DESC, candidate_name, candidate_id LIMIT 20")
def find_candidate(w):
    return T.find_candidate(w.ie(), "nurses").withColumn("match", F.round(F.col("match").cast("double"), 6))


@query(f"SELECT CAST(year AS VARCHAR) AS year, count(*) AS records, {_M.format('sum(amount)')} AS total, {_M.format(chr(39).join(['sum(amount) FILTER (WHERE s = ', 'receipts', ')']))} AS receipts_total, {_M.format(chr(39).join(['sum(amount) FILTER (WHERE s = ', 'payments', ')']))} AS payments_total FROM (SELECT 'receipts' AS s, year(receipt_date) AS year, amount FROM receipts UNION ALL SELECT 'payments', year(expn_date), amount FROM expns) GROUP BY 1 HAVING total >= 1000")
def entity_two_source_totals(w):
    return T.two_source_totals([("receipts", w.receipts(), "receipt_date", "amount"), ("payments", w.expn_all(), "expn_date", "amount")], 1000).withColumn("year", F.col("year").cast("string"))


@query(f"SELECT coalesce(candidate_name, '(none)') AS candidate_name, count(*) AS expenditures, {_M.format('sum(expenditure_amount)')} AS total FROM (SELECT * FROM ie_raw WHERE election_year = {YEAR} AND transaction_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY spender_id, transaction_id ORDER BY expenditure_amount DESC NULLS FIRST, row_id) = 1) GROUP BY 1 HAVING total >= 500 ORDER BY total DESC, candidate_name LIMIT 200")
def entity_expenditures(w):
    return T.spender_targets(w.ie_raw(), YEAR, 500, "row_id")


@query(f"SELECT source, count(*) AS records, {_M.format('sum(amount)')} AS total FROM (SELECT 'payments' AS source, amount FROM expns WHERE year(expn_date) = {YEAR} AND amount > 0 AND regexp_matches(lower(expn_dscr), 'contrib') AND regexp_matches(lower(expn_dscr), 'refund|return') UNION ALL SELECT 'negative receipts', -amount FROM receipts WHERE year(receipt_date) = {YEAR} AND amount < 0) GROUP BY 1")
def returned_contributions(w):
    return T.returned_contributions(w.expn_all(), w.receipts(), YEAR)


@query(f"SELECT entity_id, {_CANON.format('fullname')} AS canonical FROM entity", base=False)
def canonical_names(w):
    return w.t("entity").select("entity_id", canonical_name(F.col("fullname")).alias("canonical"))


@query(f"SELECT row_id, round(CAST({_SIM.format(a=_TRI.format('payee_naml'), b=_TRI.format(chr(39) + 'coast strategies' + chr(39)))} AS DOUBLE), 6) AS similarity FROM expn_cd", base=False)
def trigram_similarities(w):
    return w.t("expn_cd").select("row_id", F.round(trigram_similarity(F.col("payee_naml"), F.lit("coast strategies")).cast("double"), 6).alias("similarity"))


@query("SELECT row_id FROM rcpt_cd WHERE ctrib_naml ILIKE '%pac%'", base=False)
def filter_ilike(w):
    return w.t("rcpt_cd").where(F.col("ctrib_naml").ilike("%pac%")).select("row_id")


@query("SELECT row_id FROM rcpt_cd WHERE regexp_matches(ctrib_naml, '(?i)\\bpac')", base=False)
def filter_word_start(w):
    return w.t("rcpt_cd").where(starts_word(F.col("ctrib_naml"), "pac")).select("row_id")


@query("SELECT row_id FROM rcpt_cd WHERE regexp_matches(ctrib_naml, '(?i)\\bBUILDERS\\b') AND regexp_matches(ctrib_naml, '(?i)\\bCOMMITTEE\\b')", base=False)
def filter_all_words(w):
    return w.t("rcpt_cd").where(has_all_words(F.col("ctrib_naml"), "committee builders")).select("row_id")


_NAMED = "(SELECT n, min(entity_id) AS id, " + _TRI.format("n") + " AS t FROM (SELECT entity_id, lower(trim(fullname)) AS n FROM entity WHERE fullname IS NOT NULL) GROUP BY n)"


@query(f"SELECT x.id AS a, y.id AS b FROM {_NAMED} x JOIN {_NAMED} y ON x.id < y.id WHERE len(x.t) > 0 AND len(y.t) > 0 AND levenshtein(x.n, y.n) <= 3 AND CAST(len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) AS FLOAT) >= CAST(0.7 AS FLOAT)", base=False)
def duplicate_scan(w):
    return similar_pairs(w.t("entity"), "entity_id", "fullname", 0.7, 3).select("a", "b")


@query("SELECT entity_id AS id, min(entity_id) OVER (PARTITION BY lower(trim(fullname))) AS rep FROM entity WHERE fullname IS NOT NULL", base=False)
def duplicate_classes(w):
    return name_classes(w.t("entity"), "entity_id", "fullname")


@query("WITH RECURSIVE " + merged_sql("SELECT fullname AS x FROM entity") + " SELECT node AS fullname, g AS \"group\" FROM grp", base=False)
def name_merge_components(w):
    return merged_names(w.t("entity"), "fullname")


@query("SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = l_orderkey", base=False)
def semi_join_scope(w):
    return w.t("lineitem").join(w.t("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2", base=False)
def pricing_summary(w):
    return w.t("lineitem").where(F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"SELECT row_id, expn_date, form_type FROM expn SEMI JOIN scope USING (filing_id) WHERE form_type = 'G' AND year(expn_date) = {YEAR} ORDER BY expn_date DESC, row_id LIMIT 50")
def expenditures_by_outlet(w):
    return T.expenditures_by_form(w.expn(), w.scope(), ["G"], YEAR, "row_id").select("row_id", "expn_date", "form_type")


@query(f"SELECT row_id, expn_date, payee_naml FROM expn SEMI JOIN scope USING (filing_id) WHERE form_type IN ('D', 'E', 'F461P5') AND year(expn_date) = {YEAR} AND payee_naml ILIKE '%ton%' ORDER BY expn_date DESC, row_id LIMIT 50")
def expenditures_by_candidate(w):
    return T.expenditures_by_form(w.expn(), w.scope(), ["D", "E", "F461P5"], YEAR, "row_id", "ton").select("row_id", "expn_date", "payee_naml")


@query("SELECT CAST(o_custkey AS VARCHAR) AS committee, count(DISTINCT o_orderkey) AS filings, round(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18, 2))), 0), 2)::DOUBLE AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY total DESC, committee LIMIT 20", base=False)
def measure_spending(w):
    covers = w.t("orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").cast("string").alias("committee"))
    return T.measure_spending(covers, w.t("lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_a")))


@query(f"SELECT * FROM (SELECT 'receipts' AS source, donor_name AS name, count(*) AS records, {_M.format('sum(amount)')} AS total FROM receipts WHERE donor_name IS NOT NULL GROUP BY 2 HAVING total >= 500 ORDER BY total DESC, name LIMIT 30) UNION ALL SELECT * FROM (SELECT 'payments', payee_name AS name, count(*), {_M.format('sum(amount)')} AS total FROM expns WHERE payee_name IS NOT NULL GROUP BY 2 HAVING total >= 500 ORDER BY total DESC, name LIMIT 30) ORDER BY total DESC, name, source LIMIT 30")
def entity_top_of_two_sources(w):
    return T.merged_top([("receipts", w.receipts(), "donor_name", "amount"), ("payments", w.expn_all(), "payee_name", "amount")], 500, 30)


@query("SELECT row_id FROM rcpt_cd WHERE cmte_id IN (SELECT x.xref_id FROM filer_xref_cd x JOIN (SELECT filer_id, st FROM names) n USING (filer_id) WHERE upper(trim(n.st)) = 'CA')")
def state_lens(w):
    places = w.t("filer_xref_cd").select("filer_id", "xref_id").join(V.filer_names(w.t("filername_cd")).select("filer_id", "st"), "filer_id")
    return T.in_state(w.t("rcpt_cd"), "cmte_id", "CA", places).select("row_id")


@query(f"SELECT row_id FROM rcpt_cd WHERE filing_id IN (SELECT filing_id FROM filer_filings WHERE filer_id IN (SELECT filer_id FROM filer_filings WHERE filing_id IN (SELECT filing_id FROM expn WHERE {_VEND})))")
def nested_semi_joins(w):
    return T.lines_of_payers(w.t("rcpt_cd"), w.filer_filings(), w.expn(), VENDOR).select("row_id")


@query("SELECT a.row_id AS row_a, b.row_id AS row_b FROM rapid a JOIN expn b ON a.amount IS NOT DISTINCT FROM b.amount AND a.exp_date IS NOT DISTINCT FROM b.expn_date AND a.filing_id IS NOT DISTINCT FROM b.filing_id")
def null_safe_join(w):
    a = w.rapid().select(F.col("row_id").alias("row_a"), F.col("amount").alias("am"), F.col("exp_date").alias("d"), F.col("filing_id").alias("f"))
    b = w.expn().select(F.col("row_id").alias("row_b"), "amount", "expn_date", "filing_id")
    return a.join(b, a["am"].eqNullSafe(b["amount"]) & a["d"].eqNullSafe(b["expn_date"]) & a["f"].eqNullSafe(b["filing_id"])).select("row_a", "row_b")


@query("SELECT row_id, rcpt_date, row_number() OVER (ORDER BY rcpt_date IS NULL DESC, rcpt_date DESC, row_id) AS place FROM rcpt_cd", base=False)
def undated_first(w):
    return ranked(w.t("rcpt_cd").select("row_id", "rcpt_date"), [F.col("rcpt_date").isNull().desc(), F.col("rcpt_date").desc(), F.col("row_id")], "place")


@query("SELECT f.source_file FROM load_checkpoint f ANTI JOIN (SELECT DISTINCT file_hash FROM load_checkpoint WHERE lower(table_name) = 'filername_cd' AND source = 'calaccess' AND rows_processed > 0 AND processed_date < TIMESTAMP '2025-03-01') d USING (file_hash)", base=False)
def files_still_to_load(w):
    manifest = w.t("load_checkpoint")
    return files_to_load(manifest.select("source_file", "file_hash"), manifest.where("processed_date < timestamp_ntz '2025-03-01'"), "FILERNAME_CD", "calaccess").select("source_file")


_RULES = [Rule("committee_name", "required"), Rule("state", "length", 2, 2), Rule("zip", "length", 5, 10), Rule("committee_type", "enum", values=("H", "N", "O", "Q", "S", "Y")), Rule("city", "cross_field", values=("<>", "state"))]


@query(
    "SELECT committee_id, concat_ws('; ', CASE WHEN coalesce(trim(committee_name), '') = '' THEN 'committee_name: required' END, CASE WHEN trim(state) <> '' AND length(state) <> 2 THEN 'state: not a valid length' END, "
    "CASE WHEN trim(zip) <> '' AND NOT length(zip) BETWEEN 5 AND 10 THEN 'zip: not a valid length' END, CASE WHEN trim(committee_type) <> '' AND committee_type NOT IN ('H', 'N', 'O', 'Q', 'S', 'Y') THEN 'committee_type: not a valid enum' END, CASE WHEN trim(city) <> '' AND NOT city <> state THEN 'city: not <> state' END) AS errors FROM fec_committees",
    base=False,
)
def rule_violations(w):
    return validated(w.t("fec_committees"), _RULES).select("committee_id", F.array_join("_validation_errors", "; ").alias("errors"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS records, round(sum(value), 2) AS total FROM events GROUP BY 1, 2", base=False)
def daily_totals(w):
    rows = w.t("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return receipts_per_window(rows, "ts", "event_type", "value").withColumn("total", F.round("total", 2))
