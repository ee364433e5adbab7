import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.dedup import attributed_first, current_versions, keep_max_per_source, kept_counts
from tallyforge.plans.views import expn_all, filing_filer, ie_dedup, ie_resolved, receipts_all

VERSION = "filing_id int, amend_id int, line_item int, cmte_id string, tran_id string, amount double"


def versions(spark, rows):
    out = current_versions(spark.createDataFrame(rows, VERSION)).collect()
    return sorted((r["filing_id"], r["line_item"], r["amend_id"]) for r in out), sum(r["amount"] for r in out)


AMENDED = [(100, 0, 1, "C1", "T1", 500.0), (100, 1, 1, "C1", "T1", 350.0), (100, 0, 2, "C1", "T2", 100.0), (100, 1, 2, "C1", "T2", 100.0), (100, 2, 2, "C1", "T2", 125.0)]


def test_amendments(spark):
    assert versions(spark, AMENDED) == ([(100, 1, 1), (100, 2, 2)], 475.0)
    assert versions(spark, [*AMENDED, (100, 2, 1, "C1", "T1", 200.0)])[1] == 325.0


def test_refile(spark):
    got = versions(spark, [(100, 0, 1, "C1", "T1", 500.0), (101, 1, 3, "C1", "T1", 350.0), (100, 0, 2, "C1", "T2", 100.0)])
    assert got == ([(100, 2, 0), (101, 3, 1)], 450.0)


def test_unattributed(spark):
    assert versions(spark, [(200, 0, 9, "", "", 50.0), (200, 1, 9, "", "", 40.0)]) == ([(200, 9, 1)], 40.0)
    assert versions(spark, [(200, 0, 9, None, "T", 50.0), (200, 1, 9, "C", None, 40.0), (200, None, 9, "C", " ", 30.0)])[1] == 30.0
    assert versions(spark, []) == ([], 0)


GIFTS = [
    ("rcpt_cd", 100, "T1", "2026-04-03", 200000, "ACLU"), ("s497_cd", 101, "T2", "2026-04-03", 200000, "ACLU"), ("s497_cd", 102, "T3", "2026-08-06", 12500, "SEIU"),
    ("s497_cd", 103, "T4", "2026-08-06", 12500, "SEIU"), ("rcpt_cd", 104, "T5", "2026-05-01", 500, "JONES"), ("rcpt_cd", 105, "T6", None, 7, "JONES"), ("rcpt_cd", 106, "T7", None, 7, "JONES"),
]


def test_keep_max_per_source(spark):
    df = spark.createDataFrame(GIFTS, "src string, filing_id int, tran_id string, day string, amount int, donor string")
    order = [F.col("src"), F.col("filing_id")]
    got = keep_max_per_source(df, ["donor", "day", "amount"], "src", order, null_groups=False).collect()
    assert sorted(r["filing_id"] for r in got) == [100, 102, 103, 104] and sum(r["amount"] for r in got) == 225500
    assert keep_max_per_source(df, ["donor", "day", "amount"], "src", order, null_groups=True).count() == 6
    counts = kept_counts(df, ["donor", "day", "amount"], "src")
    assert {(r["donor"], r["day"]): r["keep_n"] for r in counts.collect()} == {("ACLU", "2026-04-03"): 1, ("SEIU", "2026-08-06"): 2, ("JONES", "2026-05-01"): 1, ("JONES", None): 2}


def test_attributed_first(spark):
    df = spark.createDataFrame([("r", 1, 1, "T", None, 3, "a"), ("r", 1, 1, "T", "C1", 0, "b"), ("r", 1, 1, None, None, 0, "c"), ("r", 1, 1, "", " ", 1, "d")], "src string, filing_id int, line_item int, tran_id string, raw string, amend_id int, tag string")
    assert sorted(r["tag"] for r in attributed_first(df, "raw").collect()) == ["b", "d"]


def test_views(spark):
    ts = dt.datetime(2024, 5, 1)
    rcpt = spark.createDataFrame([(1, 0, "T1", 1, ts, Decimal("5.00"), "Smith", "Al", None, None, "m"), (2, 0, "T2", 1, ts, Decimal("6.00"), " ", None, "ORG", "C9", "m"), (3, 0, None, 1, None, None, None, None, None, None, None)], "filing_id int, amend_id int, tran_id string, line_item int, rcpt_date timestamp_ntz, amount decimal(12,2), ctrib_naml string, ctrib_namf string, ctrib_dscr string, cmte_id string, memo_refno string")
    s497 = rcpt.where("filing_id = 1").withColumnsRenamed({"rcpt_date": "ctrib_date", "ctrib_naml": "enty_naml", "ctrib_namf": "enty_namf"})
    s498 = rcpt.withColumnsRenamed({"rcpt_date": "date_rcvd", "amount": "amt_rcvd", "ctrib_naml": "payor_naml", "ctrib_namf": "payor_namf"}).withColumn("form_type", F.when(F.col("filing_id") == 1, "F498-R").otherwise("F498-P"))
    filers = filing_filer(spark.createDataFrame([(1, 20), (1, 7), (3, 9)], "filing_id int, filer_id int"))
    got = {(r["src"], r["filing_id"]): (r["cmte_id"], r["donor_key"], r["donor_name"]) for r in receipts_all(rcpt, s497, s498, filers).collect()}
    assert got == {("rcpt_cd", 1): ("7", "Smith Al", "Smith Al"), ("rcpt_cd", 2): ("C9", "ORG", "ORG"), ("rcpt_cd", 3): ("9", "9", None), ("s497_cd", 1): ("7", "Smith Al", "Smith Al"), ("s498_cd", 1): ("7", "Smith Al", "Smith Al")}
    expn = spark.createDataFrame([(1, 0, "E1", 1, "E", ts, Decimal("5.00"), "Acme", None, "OFC", "rent", None, None)], "filing_id int, amend_id int, tran_id string, line_item int, form_type string, expn_date timestamp_ntz, amount decimal(12,2), payee_naml string, payee_namf string, expn_code string, expn_dscr string, cmte_id string, memo_refno string")
    s496 = spark.createDataFrame([(1, 0, 4, ts, Decimal("9.00"), "ads")], "filing_id int, amend_id int, line_item int, exp_date timestamp_ntz, amount decimal(12,2), expn_dscr string")
    assert {(r["src"], r["cmte_id"], r["payee_key"], r["cycle"]) for r in expn_all(expn, None, s496, filers).collect()} == {("expn_cd", "7", "Acme", 2024), ("s496_cd", "7", "ads", 2024)}


IE = "spender_id string, candidate_id string, candidate_name string, transaction_id string, filing_form string, file_number string, amendment_indicator string, expenditure_date date, expenditure_amount double, id int"


def test_independent_expenditures(spark):
    d = dt.date(2026, 1, 2)
    rows = [
        ("S1", "H1", "VON WILPERT, MARNI", "T1", "F24", "1", "N", d, 10.0, 1), ("S1", "H1", "WILPERT, MARNI VON", "T1", "F3X", "2", "N", d, 10.0, 2),  # notice and report
        ("S2", "H1", "VON WILPERT, MARNI", "A", "F5", "3", "N", d, 20.0, 3), ("S2", "H1", "VON WILPERT, MARNI", "B", "F5", "4", "A", d, 20.0, 4),  # filed again
        ("S3", "H2", "DOE, JO", "C", "F5", "5", "N", d, 30.0, 5), ("S3", "H2", "DOE, JO", "D", "F5", "5", "N", d, 30.0, 6),  # two equal lines of one filing
        ("S4", None, "Marni Von Wilpert", None, "F5", "6", "N", d, 40.0, 7), ("S4", None, "JO DOE", None, "F5", "6", "N", d, 50.0, 8), ("S5", "H3", "Doe Jo", "E", "F5", "7", "N", d, 60.0, 9),
    ]
    once = ie_dedup(spark.createDataFrame(rows, IE), "id")
    assert sorted(r["id"] for r in once.collect()) == [2, 4, 5, 6, 7, 8, 9]
    got = {r["id"]: (r["resolved_candidate_id"], r["resolved_candidate_name"]) for r in ie_resolved(once).collect()}
    assert got[7][0] == "H1" and got[8][0] is None and got[2][1] == "Marni Von Wilpert"  # of three names once each the smallest


@pytest.mark.parametrize("empty", ["current_versions"])
def test_empty(spark, empty):
    assert current_versions(spark.createDataFrame([], VERSION)).count() == 0
    assert ie_resolved(ie_dedup(spark.createDataFrame([], IE), "id")).count() == 0
