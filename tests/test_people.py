import pytest
from pyspark.sql import functions as F

from tallyforge.operators import similar
from tallyforge.operators.order import ranked
from tallyforge.plans import federal as E
from tallyforge.plans.merges import QUEUE, Merges, matches_of
from tallyforge.plans.people import NameSearch, person_blind_spot, person_payments, wanted_roles
from tallyforge.plans.tools import race_lines, race_roster, race_unmatched, resolved_filers

EXPN = "filing_id int, amend_id int, tran_id string, expn_date timestamp_ntz, amount decimal(12,2), payee_naml string, payee_namf string, expn_code string, expn_dscr string, cmte_id string, form_type string, row_id long"
RCPT = "src string, filing_id int, amend_id int, tran_id string, receipt_date timestamp_ntz, amount decimal(12,2), donor_naml string, donor_namf string, ctrib_dscr string, cmte_id string, donor_name string, donor_key string, row_id long"
NAMES = "id long, filer_id int, filer_type string, effect_dt timestamp_ntz, naml string, namf string, namt string, nams string"
XREF = "filer_id int, xref_id string, effect_dt timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark):
    cast = lambda df, **t: df.withColumns({c: F.col(c).cast(k) for c, k in t.items()})
    expn = spark.createDataFrame([(1, 0, "e1", "2024-01-02", 10, "VARN", "MIRKO", None, " rent ", "C1", "E", 1), (1, 0, "e2", None, 5, "MIRKO", "VARN", None, None, "C1", "E", 2), (2, 0, "e3", "2023-05-01", 7, "OVARNS", "MIRKO", None, None, "C2", "E", 3), (9, 0, "e4", "2024-01-03", 8, "VARN", "MIRKO", None, None, None, "E", 4), (2, 0, "e5", "2024-06-01", 9, "HALL PRINTERS", None, None, None, "C2", "D", 5)], EXPN.replace("timestamp_ntz", "string").replace("decimal(12,2)", "int"))
    rcpt = spark.createDataFrame([("rcpt_cd", 1, 0, "r1", "2024-02-02", 100, "VARN", "MIRKO", None, "C1", "VARN MIRKO", "VARN MIRKO", 1), ("s497_cd", 3, 0, "r2", "2024-02-02", 100, "VARN", "MIRKO", None, "C1", "VARN MIRKO", "VARN MIRKO", 1), ("rcpt_cd", 1, 0, "r3", None, 3, "Varn, Mirko", None, None, "C1", "Varn, Mirko", "Varn, Mirko", 2)], RCPT.replace("timestamp_ntz", "string").replace("decimal(12,2)", "int"))
    names = spark.createDataFrame([(1, 1001, "C", "2024-01-01", "FRIENDS OF VARN", None, None, None), (2, 1002, "C", "2024-01-01", "HALL COMMITTEE", None, None, None)], NAMES.replace("timestamp_ntz", "string"))
    return {
        "expn": cast(expn, expn_date="timestamp_ntz", amount="decimal(12,2)"), "rcpt": cast(rcpt, receipt_date="timestamp_ntz", amount="decimal(12,2)"), "names": cast(names, effect_dt="timestamp_ntz"),
        "xref": cast(spark.createDataFrame([(1001, "C1", "2024-01-01"), (1002, "C2", None), (1002, "C9", "2020-01-01")], XREF.replace("timestamp_ntz", "string")), effect_dt="timestamp_ntz"),
        "filings": spark.createDataFrame([(1, 1001), (1, 1001), (2, 1002), (2, 1001)], "filing_id int, filer_id int"), "aliases": spark.createDataFrame([("MIRKO VARN SLATE", 1002), (None, 5), ("VARN", None)], "alias_name string, source_filer_id int"),
    }


def test_payments_to_a_person(tables):
    t = tables
    rows = person_payments(t["expn"], t["filings"], t["names"], t["xref"], "Mirko Varn", "row_id").collect()
    assert sorted((r["row_id"], r["committee"], r["cmte_id"], r["total"], r["purpose"]) for r in rows) == [(1, "FRIENDS OF VARN", "C1", 2, "rent"), (2, "FRIENDS OF VARN", "C1", 2, "")]
    assert [r["row_id"] for r in person_payments(t["expn"], t["filings"], t["names"], t["xref"], "Varn, Mirko", "row_id", "2024-01-01").collect()] == [1]
    rapid = t["expn"].select("filing_id", F.col("expn_date").alias("exp_date"))
    assert person_blind_spot(rapid, t["expn"], t["filings"], "Mirko Varn").first()["lines"] == 4  # of both filings of the paying filer
    assert wanted_roles("ALL") == wanted_roles("x") == {"payee", "donor", "filer"} and wanted_roles("donor, filer") == {"donor", "filer"}


def search(t, **more):
    return NameSearch(t["rcpt"], t["expn"], t["names"], t["aliases"], t["xref"], **({"text": "varn mirko", "tie": "row_id"} | more))


def test_name_search(tables):
    s = search(tables)
    assert [(r["filer_id"], r["xref_id"], r["via"]) for r in s.entities().collect()] == [(1002, "C9", "alias")]
    assert {(r["year"], r["in_total"], r["out_total"], r["net"], r["n"]) for r in s.totals().collect()} == {(2024, 200.0, 18.0, 182.0, 4), (None, 3.0, 5.0, -2.0, 2)}
    got = s.matches(2).collect()
    assert len(got) == 4 and {r["committee_name"] for r in got} == {"FRIENDS OF VARN", ""}
    assert search(tables, kind="payee", start="2024-01-03").totals().first()["out_total"] == 8.0
    assert search(tables, text="varn").entities().count() == 2 and search(tables, text=" . ").matches().isEmpty() and search(tables, text="").entities().isEmpty()


def test_name_search_by_reporting_filer(tables):
    s = search(tables, text="friends varn", kind="committee")
    assert {(r["year"], r["in_total"], r["out_total"], r["n"]) for r in s.totals().collect()} == {(2024, 200.0, 10.0, 3), (None, 3.0, 5.0, 2)}
    named = search(tables, text="hall", kind="candidate", candidate=F.col("payee_naml"))
    assert sorted(r["matched_name"] for r in named.matches().collect()) == ["HALL PRINTERS"]  # on a line of C2; the filer's committee is C9
    assert search(tables, text="friends", kind="committee").recipients().collect()[0]["recipient"] == "VARN MIRKO"


def test_resolved_filers(spark, tables):
    ids = spark.createDataFrame([("C1",), ("C9",), ("77",), ("zz",), (None,), ("99999999999999999999",)], "committee_id string")
    assert {r["committee_id"]: r["filer_id"] for r in resolved_filers(ids, tables["xref"]).collect()} == {"C1": 1001, "C9": 1002, "77": 77, "zz": -1, None: -1, "99999999999999999999": -1}


def test_merges(spark):
    entity = spark.createDataFrame([(1, "Acmeton Corp", None), (2, "Acmeton Corps", None), (3, "ACMETON CORP", None), (4, "Acmeton Corq", 1), (5, "Otherwise", None), (6, None, None)], "entity_id long, naml string, resolved_by long")
    alias = spark.createDataFrame([(1, "A", 1, "t"), (3, "A", 3, "t"), (3, "B", 3, "t"), (3, "B", 3, "u")], "entity_id long, alias_name string, source_filer_id long, source_table string")
    m = Merges(entity, alias, spark.createDataFrame([], QUEUE))
    assert m.stats().first().asDict() == {"total_entities": 6, "resolved_entities": 1, "pending_merges": 0, "applied_merges": 0, "rejected_merges": 0}
    assert {(r["a"], r["b"], r["score"] == 1.0) for r in m.scan().collect()} == {(1, 3, True), (1, 2, False)}
    m = m.suggested(m.scan(), "scan")
    assert [(r["entity_a_id"], r["entity_b_id"]) for r in m.pending().collect()] == [(1, 3), (1, 2)] and m.scan().isEmpty()
    done = m.certain("2026-01-01").rejected(F.col("entity_b_id") == 2, "2026-01-02")
    assert {r["entity_id"]: r["resolved_by"] for r in done.entity.collect()} == {1: None, 2: None, 3: 1, 4: 1, 5: None, 6: None}
    assert sorted((r["entity_id"], r["alias_name"]) for r in done.alias.collect()) == [(1, "A"), (1, "B"), (3, "A"), (3, "B"), (3, "B")]
    assert {(r["entity_b_id"], r["status"], r["reviewed_by"]) for r in done.queue.collect()} == {(3, "applied", "auto_apply"), (2, "rejected", None)}
    with pytest.raises(ValueError):
        done.applied(F.col("queue_id") > 0, "me", "2026-01-03")
    assert done.certain("2026-01-04") is done


def test_matches_of_name(spark):
    rows = [(1, "Smithson", "Al", None, "X", "CA"), (2, "Smithsen", "al", None, "x", "CA"), (3, "SMITHSON", "Bo", "Jr", "Y", "NV"), (4, "Unlike", "Al", None, "X", "CA"), (5, None, None, None, None, None)]
    e = spark.createDataFrame(rows, "entity_id long, naml string, namf string, nams string, city string, st string")
    got = [(r["source_id"], r["target_id"], r["match_score"]) for r in matches_of(e, "smithson", threshold=0.55).collect()]
    assert got[:2] == [(1, 3, 1.0), (3, 1, 1.0)] and {g[:2] for g in got} == {(1, 3), (3, 1), (1, 2), (3, 2)} and dict(((a, b), s) for a, b, s in got)[1, 2] > dict(((a, b), s) for a, b, s in got)[3, 2]
    assert matches_of(e, "smithson", city="x", state="ca", threshold=0.55).count() == 2


def test_scan_of_names_with_common_words(spark, monkeypatch):
    joined, join = [], similar.salted_join
    monkeypatch.setattr(similar, "salted_join", lambda *a, **k: joined.append(join(*a, **k)) or joined[-1])
    parts = ["lan", "ton", "mer", "vis", "dor", "kel"]
    names = [f"{a}{b}{c} for school board" for a in parts for b in parts for c in parts]
    entity = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "entity_id long, naml string, resolved_by long")
    pairs = Merges(entity, entity.limit(0), spark.createDataFrame([], QUEUE)).scan().count()
    assert joined[0].count() <= 5 * pairs  # rows the join lets through, one for each triple that a pair was met by


def test_scan_leaves_names_with_unlike_letters_apart(spark, monkeypatch):
    joined, join = [], similar.salted_join
    monkeypatch.setattr(similar, "salted_join", lambda *a, **k: joined.append(join(*a, **k)) or joined[-1])
    parts = ["tralo", "kemur", "shivo", "bendi", "gruza", "plonu"]
    names = [f"{a}{b} tree farmers political action committee" for a in parts for b in parts]
    names += [n.replace("farmers", "farmer") for n in names[:9]]
    entity = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "entity_id long, naml string, resolved_by long")
    found = Merges(entity, entity.limit(0), spark.createDataFrame([], QUEUE)).scan().select("a", "b").collect()
    assert sorted(map(tuple, found)) == [(i, 36 + i) for i in range(9)]  # all else that triples let through is more than three edits apart
    assert 5 * joined[0].select("ida", "idb").distinct().count() <= len(names) * (len(names) - 1) // 2


def test_matches_of_a_name_with_copies(spark, monkeypatch):
    kept = []
    rows = [(i, ("Smithson", "smithsen", "SMITHSONS", "unlike")[i % 4], ("Al", None)[i // 4 % 2], None, ("X", "Y", None)[i // 8 % 3], "CA") for i in range(240)]
    e = spark.createDataFrame(rows, "entity_id long, naml string, namf string, nams string, city string, st string")
    monkeypatch.setattr(type(e), "orderBy", lambda df, *c, order=type(e).orderBy: kept.append(df) or order(df, *c))
    g = {n: {f"  {n} "[i : i + 3] for i in range(len(n) + 1)} for n in ("smithson", "smithsen", "smithsons")}
    want = []
    for a in rows:
        for b in rows:
            x, y = a[1].lower(), b[1].lower()
            if "smithson" in x and y in g and a[0] != b[0] and (m := len(g[x] & g[y]) / len(g[x] | g[y])) > 0.45:
                want.append((-round(m + 0.2 * (a[2] == b[2] == "Al") + 0.1 * (a[4] == b[4] is not None), 4), a[0], b[0]))
    got = [(r["source_id"], r["target_id"], r["match_score"]) for r in matches_of(e, "smithson", threshold=0.55, limit=3).collect()]
    assert got == [(a, b, pytest.approx(-s, abs=1e-4)) for s, a, b in sorted(want)[:3]]
    assert kept[-1].count() <= 12 * 4 * 18 * 4 < len(want)  # 12 and 18 classes, 4 ids each, instead of all pairs
    got = [(r["source_id"], r["target_id"]) for r in matches_of(e, "smithson", threshold=0.55, limit=len(want) + 5).collect()]
    assert got == [w[1:] for w in sorted(want)]


def test_ranks_over_all_rows(spark):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(500)], "a int, id int")
    got = {r["id"]: r["place"] for r in ranked(df, [F.col("a").isNull().desc(), F.col("a").desc(), F.col("id")], "place", 6).collect()}
    want = sorted(range(500), key=lambda i: (i % 5 != 0, -(i % 7) if i % 5 else 0, i))
    assert got == {i: n for n, i in enumerate(want, 1)} and ranked(df.limit(0), [F.col("id")], "place").isEmpty()


def test_race_of_a_district(spark):
    rows = [("Pellam", "Ives", "SEN", "S", 10, "2024-01-01"), ("Amara Quell", "", "SEN", "O", 20, "2024-12-31"), ("Quell", "Amara", "ASM", "S", 5, "2024-05-05"), (None, None, None, "S", 1, "2024-06-01"), ("Pellam", "Ives", "SEN", "S", 9, "2025-01-01"), ("Lone", "Ann", "ASM", "S", 2, "2024-02-02")]
    expn = spark.createDataFrame([(1, *r, "29", "IND", "D") for r in rows] + [(1, "Pellam", "Ives", "SEN", "S", 99, "2024-01-01", "30", "IND", "D")], "filing_id int, cand_naml string, cand_namf string, office_cd string, sup_opp_cd string, amount int, expn_date string, dist_no string, expn_code string, form_type string").withColumn("expn_date", F.col("expn_date").cast("timestamp_ntz"))
    lines = race_lines(expn, spark.createDataFrame([(1, "7")], "filing_id int, filer_id string"), "29", 2024)
    assert {(r["candidate"], r["for_total"], r["against_total"], r["for_count"], r["against_count"]) for r in race_roster(lines, "SEN").collect()} == {("Pellam Ives", 10.0, 0.0, 1, 0), ("Quell Amara", 0.0, 20.0, 0, 1)}
    assert {(r["candidate"], r["office"], r["total"]) for r in race_unmatched(lines, "SEN").collect()} == {("Quell Amara", "ASM", 5.0), ("(unnamed)", None, 1.0), ("Lone Ann", "ASM", 2.0)}


def test_federal_sides():
    with pytest.raises(ValueError):
        E.top_spenders(None, "beside", None)
