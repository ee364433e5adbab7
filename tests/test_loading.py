from pyspark.sql import functions as F

from tallyforge.plans.loading import load_files, refresh_views
from tallyforge.plans.registry import FEDERAL_COLUMNS, FEDERAL_KEYS, STATE_KEYS, federal_spec, kind_of, load_order, spec_from_header
from tallyforge.sources.store import Snapshots


def test_registry():
    keys = STATE_KEYS
    assert len(keys) == 82 and keys["rcpt_cd"] == ("amend_id", "filing_id", "form_type", "line_item", "rec_type") and keys["filername_cd"] == ()
    assert [kind_of(c) for c in ("filing_id", "line_item", "amount", "cum_ytd", "rcpt_date", "effect_dt", "cmte_id", "amount_a")] == ["int", "int", "decimal", "decimal", "date", "date", "text", "decimal"]
    assert kind_of("line_item", "smry_cd") == "text"
    assert load_order(["rcpt_cd", "acronyms_cd", "expn_cd", "filings_cd"]) == ["acronyms_cd", "filings_cd", "expn_cd", "rcpt_cd"]
    assert {t: len(c) for t, c in FEDERAL_COLUMNS.items()} == {"fec_committees": 15, "fec_candidates": 15, "fec_candidate_pac_linkage": 7, "fec_individual_contributions": 21, "fec_other_contributions": 21, "fec_conduit_contributions": 22, "fec_independent_expenditures": 26}
    spec = federal_spec("fec_individual_contributions", 2024)
    assert spec.constants == {"two_year_transaction_period": 2024} and spec.required == ("committee_id", "transaction_id") and set(FEDERAL_KEYS) == set(FEDERAL_COLUMNS)
    assert spec_from_header("filings_cd", ["FILING_ID", "Filing_Type"]).key == ("filing_id",)


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_load_again_and_late_amendments(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    head = "FILING_ID\tAMEND_ID\tLINE_ITEM\tREC_TYPE\tFORM_TYPE\tTRAN_ID\tRCPT_DATE\tAMOUNT\tCTRIB_NAML\tCTRIB_NAMF\tCTRIB_DSCR\tCMTE_ID\tMEMO_REFNO\n"
    rows = "100\t0\t1\tRCPT\tA\tT1\t5/15/2024\t500\tSmith\tAl\t\tC1\t\n101\t0\t1\tRCPT\tA\tT2\t6/1/2024\t250\tSmith\tAl\t\t\t\n\t0\t1\tRCPT\tA\tT9\t\t1\tx\t\t\t\t\n"
    put(tmp_path / "rcpt", "a.tsv", head + rows)
    pattern = str(tmp_path / "rcpt" / "*.tsv")
    assert load_files(spark, store, pattern, None, "rcpt_cd", "state") == {"files": 1, "skipped_files": 0, "read": 3, "rows": 2, "skipped": 1, "rejected": 0, "empty_files": []}
    assert load_files(spark, store, pattern, None, "RCPT_CD", "state")["skipped_files"] == 1
    put(tmp_path / "rcpt", "b.tsv", head + "100\t1\t1\tRCPT\tA\tT1\t5/15/2024\t350\tSmith\tAl\t\tC1\t\n100\t0\t1\tRCPT\tA\tT1\t5/15/2024\t501\tSmith\tAl\t\tC1\t\n")
    assert load_files(spark, store, pattern, None, "rcpt_cd", "state") == {"files": 1, "skipped_files": 1, "read": 2, "rows": 3, "skipped": 0, "rejected": 0, "empty_files": []}
    assert sorted(float(r["amount"]) for r in store.current("rcpt_cd").collect()) == [250.0, 350.0, 501.0]
    assert store.current("etl_dead_letter") is None
    for name, extra in (("s497_cd", "CTRIB_DATE\tAMOUNT\tENTY_NAML\tENTY_NAMF"), ("s498_cd", "DATE_RCVD\tAMT_RCVD\tPAYOR_NAML\tPAYOR_NAMF")):
        put(tmp_path / name, "x.tsv", f"FILING_ID\tAMEND_ID\tLINE_ITEM\tREC_TYPE\tFORM_TYPE\tTRAN_ID\t{extra}\tCMTE_ID\tMEMO_REFNO\n1\t0\t1\tS\tF498-R\tT7\t1/2/2024\t7\tDoe\tJo\tC1\t\n")
        load_files(spark, store, str(tmp_path / name / "*"), None, name, "state")
    put(tmp_path / "e", "x.tsv", "FILING_ID\tAMEND_ID\tLINE_ITEM\tREC_TYPE\tFORM_TYPE\tTRAN_ID\tEXPN_DATE\tAMOUNT\tPAYEE_NAML\tPAYEE_NAMF\tEXPN_CODE\tEXPN_DSCR\tCMTE_ID\tMEMO_REFNO\n100\t0\t1\tEXPN\tE\tE1\t5/20/2024\t300\tAcme\t\tOFC\trent\t\t\n")
    load_files(spark, store, str(tmp_path / "e" / "*"), None, "expn_cd", "state")
    put(tmp_path / "f", "x.tsv", "FILER_ID\tFILING_ID\tFILING_SEQUENCE\tFORM_ID\n1001\t100\t0\tF\n1001\t101\t0\tF\n")
    load_files(spark, store, str(tmp_path / "f" / "*"), None, "filer_filings_cd", "state")
    refresh_views(store)
    assert sorted((r["src"], float(r["amount"]), r["cmte_id"]) for r in store.current("receipts_all").collect()) == [("rcpt_cd", 250.0, "1001"), ("rcpt_cd", 350.0, "C1"), ("s497_cd", 7.0, "C1"), ("s498_cd", 7.0, "C1")]
    assert [(float(r["amount"]), r["cmte_id"]) for r in store.current("expn_all").collect()] == [(300.0, "1001")]


def test_federal_files(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    line = "C1|A|M4|P2024|SA1|15|IND|DOE, JO|X|CA|9|E|O|09112020|{}|||||memo|{}"
    put(tmp_path / "in", "itcont.txt", "\n".join([line.format("47399", 1), line.format("5", 2), line.format("6", 2), "C2" + "|" * 20]) + "\n")
    got = load_files(spark, store, str(tmp_path / "in" / "*"), federal_spec("fec_individual_contributions", 2024), "fec_individual_contributions", "fec")
    assert got == {"files": 1, "skipped_files": 0, "read": 4, "rows": 2, "skipped": 1, "rejected": 0, "empty_files": []}
    rows = {r["receipt_no"]: r for r in store.current("fec_individual_contributions").collect()}
    assert float(rows["2"]["contribution_amount"]) == 6.0 and rows["1"]["contribution_date"].isoformat()[:10] == "2020-09-11" and rows["1"]["two_year_transaction_period"] == 2024


def test_rejects_filters_and_empty_files(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.tsv", "FILING_ID\tAMOUNT\n1\t99999999999999\n2\t5\n3\t-1\n")
    put(tmp_path / "in", "b.tsv", "FILING_ID\tAMOUNT\n")
    got = load_files(spark, store, str(tmp_path / "in" / "*"), None, "filings_cd", "state", F.col("amount") > 0)
    assert [got[k] for k in ("files", "read", "rows", "skipped", "rejected")] == [2, 3, 1, 1, 1] and [f[-5:] for f in got["empty_files"]] == ["b.tsv"]
    assert store.current("etl_dead_letter").first()["error_message"] == "numeric overflow"
    assert sorted(r["rows_processed"] for r in store.current("load_checkpoint").collect()) == [0, 1]
