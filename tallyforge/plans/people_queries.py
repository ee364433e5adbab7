"""Queries on people, names, merges, races and entities on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import joined_name
from tallyforge.plans import federal as E
from tallyforge.plans import people as P
from tallyforge.plans import tools as T
from tallyforge.plans import views as V
from tallyforge.plans.merges import QUEUE, Merges, matches_of
from tallyforge.plans.reference_queries import BASE, RECURSIVE, TODAY, VENDOR, YEAR, _GIFT, _M, _OLD_NAMES, _PNAME, _SHOWN, _SIM, _TRI, _VEND, Warehouse, merged_sql

PERSON, SURNAME, GIVEN, SINCE = "Cotibosski, Leonard B", "Cotibosski", "Leonard", "2021-01-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Warehouse(spark, d))
        if sql is not None:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return register


def _person(last: str, first: str) -> str:
    both = f"trim(coalesce({last}, '') || ' ' || coalesce({first}, ''))"
    pair = lambda a, b: f"coalesce(regexp_matches({last}, '(?i)\\b{a}') AND regexp_matches({first}, '(?i)\\b{b}'), false)"
    return (
        f"({pair(SURNAME, GIVEN)} OR {pair(GIVEN, SURNAME)} OR regexp_matches({both}, '(?i)\\b{SURNAME}\\b[\\s,.]+{GIVEN}')"
        f" OR regexp_matches({both}, '(?i)\\b{GIVEN}\\b[\\s,.]+([^\\s,.]+[\\s,.]+)*{SURNAME}\\b'))"
    )


_PAID = f"SELECT e.*, ff.filer_id FROM expn e JOIN filer_filings ff USING (filing_id) WHERE {_person('payee_naml', 'payee_namf')} AND expn_date >= TIMESTAMP '{SINCE}'"


def _scattered(w: Warehouse) -> DataFrame:
    """Payments with the payee's names as filers put them: swapped, or both in one of the fields."""
    whole = joined_name(F.col("payee_naml"), F.col("payee_namf"))
    turn = F.col("row_id") % 4
    return w.expn().withColumns({
        "payee_naml": F.when(turn == 0, F.col("payee_naml")).when(turn == 1, F.col("payee_namf")).when(turn == 2, whole).otherwise(F.lit(None).cast("string")),
        "payee_namf": F.when(turn == 0, F.col("payee_namf")).when(turn == 1, F.col("payee_naml")).when(turn == 3, F.concat(F.coalesce("payee_namf", F.lit("")), F.lit(" "), F.coalesce("payee_naml", F.lit("")))).otherwise(F.lit(None).cast("string")),
    })


_SCATTERED = (
    f"SELECT * REPLACE (CASE row_id % 4 WHEN 0 THEN payee_naml WHEN 1 THEN payee_namf WHEN 2 THEN {_PNAME} END AS payee_naml, "
    "CASE row_id % 4 WHEN 0 THEN payee_namf WHEN 1 THEN payee_naml WHEN 3 THEN coalesce(payee_namf, '') || ' ' || coalesce(payee_naml, '') END AS payee_namf) FROM expn"
)


@query(
    f"SELECT row_id, expn_date, CAST(amount AS DOUBLE) AS amount, substr(trim(coalesce(expn_dscr, '')), 1, 120) AS purpose, {_PNAME} AS payee_name, p.filer_id, f.n AS committee, c.xref_id AS cmte_id, count(*) OVER () AS total "
    f"FROM ({_PAID}) p LEFT JOIN filer_name f ON f.filer_id = p.filer_id LEFT JOIN filer_cmte c ON c.filer_id = p.filer_id ORDER BY expn_date DESC NULLS LAST, row_id, p.filer_id LIMIT 100"
)
def payments_to_person(w):
    return P.person_payments(w.expn(), w.filer_filings(), w.t("filername_cd"), w.t("filer_xref_cd"), PERSON, "row_id", SINCE).withColumn("amount", F.col("amount").cast("double"))


@query(f"SELECT row_id FROM ({_SCATTERED}) WHERE {_person('payee_naml', 'payee_namf')}")
def person_in_scattered_fields(w):
    from tallyforge.functions.text import person_predicate

    return _scattered(w).where(person_predicate(F.col("payee_naml"), F.col("payee_namf"), PERSON)).select("row_id")


_DONOR = f"{_person('donor_naml', 'donor_namf')} AND receipt_date >= TIMESTAMP '{SINCE}'"


@query(
    f"SELECT src, row_id, receipt_date, CAST(amount AS DOUBLE) AS amount, ctrib_dscr AS purpose, cmte_id, coalesce(nullif(trim(donor_name), ''), cmte_id) AS donor_name, (SELECT count(*) FROM receipts WHERE {_DONOR}) AS total "
    f"FROM ({_GIFT.format(_DONOR)}) WHERE rn <= keep_n ORDER BY receipt_date DESC NULLS LAST, src, row_id LIMIT 100"
)
def gifts_of_person(w):
    return P.person_gifts(w.receipts(), PERSON, "row_id", SINCE).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT DISTINCT f.filer_id, coalesce(nullif(trim(coalesce(naml, '') || ' ' || coalesce(namf, '')), ''), '(unknown)') AS name, c.xref_id AS cmte_id FROM filername_cd f LEFT JOIN filer_cmte c USING (filer_id) WHERE coalesce(regexp_matches(naml, '(?i)\\bTH'), false) OR coalesce(regexp_matches(namf, '(?i)\\bTH'), false) ORDER BY 1, 2 LIMIT 100")
def filers_by_person(w):
    return P.person_filers(w.t("filername_cd"), w.t("filer_xref_cd"), "Th")


@query(f"SELECT count(*) AS lines FROM rapid WHERE exp_date >= TIMESTAMP '{SINCE}' AND filing_id IN (SELECT filing_id FROM filer_filings WHERE filer_id IN (SELECT filer_id FROM ({_PAID})))")
def blind_spot_of_person(w):
    return P.person_blind_spot(w.rapid(), w.expn(), w.filer_filings(), PERSON, SINCE)


# ---- every transaction that a name touched ----

_TEXT = "growers"
_TOKENS = lambda c: f"coalesce(regexp_matches({c}, '(?i)\\bGROWERS\\b'), false)"
_WHOLE = "concat_ws(' ', naml, namf, namt, nams)"
_DISPLAY = "concat_ws(', ', nullif(trim(naml), ''), nullif(concat_ws(' ', nullif(trim(namf), ''), nullif(trim(namt), ''), nullif(trim(nams), '')), ''))"


def _search(w: Warehouse, **more) -> P.NameSearch:
    names = w.t("filername_cd")
    aliases = names.select(F.concat_ws(" ", "naml", "namf", "namt", "nams").alias("alias_name"), F.col("filer_id").alias("source_filer_id"))
    expn = w.expn().withColumn("candidate", F.when(F.col("form_type") == "D", joined_name(F.col("payee_naml"), F.col("payee_namf"))))
    return P.NameSearch(w.receipts(), expn, V.filer_names(names), aliases, w.t("filer_xref_cd"), **({"text": _TEXT, "tie": "row_id", "candidate": F.col("candidate")} | more))


_ENTITIES = f"SELECT n.filer_id, c.xref_id, {_DISPLAY} AS name, filer_type, CASE WHEN {_TOKENS(_WHOLE)} THEN 'name' ELSE 'alias' END AS via FROM names n LEFT JOIN filer_cmte c USING (filer_id) WHERE {_TOKENS(_WHOLE)} OR n.filer_id IN (SELECT filer_id FROM filername_cd WHERE {_TOKENS(_WHOLE)})"
_SPAN = "{0} >= TIMESTAMP '2020-01-01' AND {0} <= TIMESTAMP '2024-12-31'"


def _gave(where: str, span: bool) -> str:
    when = f" AND {_SPAN.format('receipt_date')}" if span else ""
    return f"SELECT 'in' AS direction, 'rcpt' AS \"table\", src AS source, tran_id, filing_id, amend_id, receipt_date AS date, amount, ctrib_dscr AS purpose, NULL AS code, cmte_id, coalesce(trim(donor_name), '') AS matched_name, row_id AS tie FROM receipts WHERE {where}{when}"


def _spent(where: str, span: bool, name: str = "trim(concat_ws(' ', payee_naml, payee_namf))") -> str:
    when = f" AND {_SPAN.format('expn_date')}" if span else ""
    return f"SELECT 'out' AS direction, 'expn' AS \"table\", 'expn_cd' AS source, tran_id, filing_id, amend_id, expn_date AS date, amount, expn_dscr AS purpose, expn_code AS code, cmte_id, {name} AS matched_name, row_id AS tie FROM expn WHERE {where}{when}"


_BOTH = [_gave(_TOKENS("concat_ws(' ', donor_naml, donor_namf)"), True), _spent(_TOKENS("concat_ws(' ', payee_naml, payee_namf)"), True)]
_OWN = "cmte_id IN (SELECT xref_id FROM ent WHERE xref_id IS NOT NULL)"
_BY_CANDIDATE = [_gave(_OWN, False), _spent(_OWN, False), _spent(f"form_type = 'D' AND {_TOKENS(_PNAME)} AND cmte_id NOT IN (SELECT xref_id FROM ent WHERE xref_id IS NOT NULL)", False, _PNAME)]
_WITH_ENT = BASE.rstrip() + f", ent AS ({_ENTITIES}) "


def _matches_sql(parts: list[str]) -> str:
    some = " UNION ALL ".join(f"(SELECT * FROM ({p}) ORDER BY date DESC NULLS LAST, filing_id NULLS LAST, source, tie LIMIT 50)" for p in parts)
    named = f"SELECT x.xref_id AS cmte_id, nullif({_DISPLAY}, '') AS committee_name FROM cmte_filer x JOIN names USING (filer_id)"
    top = f"SELECT * FROM ({some}) ORDER BY date IS NULL DESC, date DESC, \"table\", filing_id NULLS LAST, source, tie LIMIT 60"
    return f"SELECT direction, \"table\", source, tran_id, CAST(filing_id AS VARCHAR) AS filing_id, CAST(amend_id AS VARCHAR) AS amend_id, date, CAST(amount AS DOUBLE) AS amount, purpose, code, cmte_id, matched_name, tie, coalesce(committee_name, cmte_id, '') AS committee_name FROM ({top}) LEFT JOIN ({named}) USING (cmte_id)"


def _totals_sql(parts: list[str]) -> str:
    side = lambda d: _M.format(f"sum(amount) FILTER (WHERE direction = '{d}')")
    return f"SELECT CAST(year(date) AS VARCHAR) AS year, {side('in')} AS in_total, {side('out')} AS out_total, count(*) AS n, round(in_total - out_total, 2) AS net FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


def _plain_matches(df: DataFrame) -> DataFrame:
    return df.withColumns({"amount": F.col("amount").cast("double"), "filing_id": F.col("filing_id").cast("string"), "amend_id": F.col("amend_id").cast("string")})


@query(_ENTITIES)
def name_search_entities(w):
    return _search(w).entities()


@query(_matches_sql(_BOTH))
def name_search_matches(w):
    return _plain_matches(_search(w, start="2020-01-01", end="2024-12-31").matches())


@query(_WITH_ENT + _matches_sql(_BY_CANDIDATE), base=False)
def name_search_by_candidate(w):
    return _plain_matches(_search(w, kind="candidate").matches())


@query(_totals_sql([p.replace(f" AND {_SPAN.format('receipt_date')}", "").replace(f" AND {_SPAN.format('expn_date')}", "") for p in _BOTH]))
def name_search_totals(w):
    return _search(w, kind="ALL ").totals().withColumn("year", F.col("year").cast("string"))


@query(_WITH_ENT + _totals_sql(_BY_CANDIDATE[:2]), base=False)
def name_search_committee_totals(w):
    return _search(w, kind="committee").totals().withColumn("year", F.col("year").cast("string"))


@query(_WITH_ENT + f"SELECT trim(coalesce(payee_naml, '') || ' ' || coalesce(payee_namf, '')) AS recipient, count(*) AS payments, {_M.format('sum(amount)')} AS amount FROM expn WHERE {_OWN} GROUP BY 1 ORDER BY amount DESC, recipient LIMIT 10", base=False)
def name_search_recipients(w):
    return _search(w).recipients()


# ---- merges ----

_MERGE = """WITH ent AS (SELECT entity_id, naml, CASE WHEN entity_id % 50 = 0 THEN entity_id - 1 END AS resolved_by FROM entity),
alias AS (SELECT entity_id, fullname AS alias_name, entity_id AS source_filer_id, source_table FROM entity WHERE fullname IS NOT NULL),
queue AS (SELECT entity_id AS queue_id, entity_id AS entity_a_id, entity_id + 1 AS entity_b_id, CASE WHEN entity_id % 3 = 0 THEN 0.97 ELSE 0.8 END AS match_score, CASE WHEN entity_id % 11 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM entity WHERE entity_id % 7 = 0)
"""


def _merges(w: Warehouse) -> Merges:
    e = w.t("entity").withColumn("entity_id", F.col("entity_id").cast("long"))
    text, score = F.lit(None).cast("string"), F.when(F.col("entity_id") % 3 == 0, 0.97).otherwise(0.8)
    queue = e.where("entity_id % 7 = 0").select(F.col("entity_id").alias("queue_id"), F.col("entity_id").alias("entity_a_id"), (F.col("entity_id") + 1).alias("entity_b_id"), score.alias("match_score"), F.lit("manual").alias("match_method"), F.when(F.col("entity_id") % 11 == 0, "rejected").otherwise("pending").alias("status"), text.alias("reviewed_by"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), text.alias("notes"))
    assert queue.columns == [c.split()[0] for c in QUEUE.split(", ")]
    return Merges(e.withColumn("resolved_by", F.when(F.col("entity_id") % 50 == 0, F.col("entity_id") - 1)), e.where("fullname is not null").select("entity_id", F.col("fullname").alias("alias_name"), F.col("entity_id").alias("source_filer_id"), "source_table"), queue)


_FREE = "(SELECT n, min(entity_id) AS id, " + _TRI.format("n") + " AS t FROM (SELECT entity_id, lower(trim(naml)) AS n FROM ent WHERE naml IS NOT NULL AND resolved_by IS NULL) GROUP BY n)"
_SCORE = "CAST(len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) AS FLOAT)"


@query(
    _MERGE + f"SELECT * FROM (SELECT x.id AS a, y.id AS b, round(CAST({_SCORE} AS DOUBLE), 4) AS score FROM {_FREE} x JOIN {_FREE} y ON x.id < y.id WHERE len(x.t) > 0 AND len(y.t) > 0 AND levenshtein(x.n, y.n) <= 3 AND {_SCORE} >= CAST(0.7 AS FLOAT) "
    "UNION ALL SELECT rep, entity_id, 1.0 FROM (SELECT entity_id, min(entity_id) OVER (PARTITION BY lower(trim(naml))) AS rep FROM ent WHERE naml IS NOT NULL AND resolved_by IS NULL) WHERE rep <> entity_id) s ANTI JOIN (SELECT * FROM queue WHERE status = 'pending') q ON q.entity_a_id = s.a AND q.entity_b_id = s.b",
    base=False,
)
def merge_scan(w):
    return _merges(w).scan()


@query(_MERGE + "SELECT queue_id, entity_a_id, entity_b_id, match_score, 'manual' AS match_method FROM queue WHERE status = 'pending' ORDER BY match_score DESC, entity_a_id, entity_b_id LIMIT 20", base=False)
def merge_pending(w):
    return _merges(w).pending(20).drop("notes")


@query(_MERGE + "SELECT entity_id, alias_name FROM alias UNION ALL SELECT * FROM (SELECT q.entity_a_id, a.alias_name FROM queue q JOIN alias a ON a.entity_id = q.entity_b_id WHERE status = 'pending' AND match_score >= 0.95 EXCEPT SELECT entity_id, alias_name FROM alias)", base=False)
def merge_aliases(w):
    return _merges(w).certain(TODAY).alias.select("entity_id", "alias_name")


@query(_MERGE + "SELECT e.entity_id, coalesce(q.entity_a_id, e.resolved_by) AS resolved_by FROM ent e LEFT JOIN (SELECT * FROM queue WHERE status = 'pending' AND match_score >= 0.95) q ON q.entity_b_id = e.entity_id", base=False)
def merge_pointers(w):
    return _merges(w).certain(TODAY).entity.select("entity_id", "resolved_by")


@query(
    _MERGE + "SELECT (SELECT count(*) FROM ent) AS total_entities, (SELECT count(*) FROM ent e LEFT JOIN (SELECT * FROM queue WHERE status = 'pending' AND match_score >= 0.95) q ON q.entity_b_id = e.entity_id WHERE coalesce(q.entity_a_id, e.resolved_by) IS NOT NULL) AS resolved_entities, "
    "(SELECT count(*) FROM queue WHERE status = 'pending' AND match_score < 0.95 AND NOT queue_id % 2 = 0) AS pending_merges, (SELECT count(*) FROM queue WHERE status = 'pending' AND match_score >= 0.95) AS applied_merges, (SELECT count(*) FROM queue WHERE status = 'rejected' OR (match_score < 0.95 AND queue_id % 2 = 0)) AS rejected_merges",
    base=False,
)
def merge_stats(w):
    return _merges(w).certain(TODAY).rejected(F.col("queue_id") % 2 == 0, TODAY).stats()


_LOWER = "SELECT entity_id AS id, lower(trim(naml)) AS l, lower(trim(namf)) AS f, lower(trim(nams)) AS s, lower(trim(city)) AS c FROM entity WHERE naml IS NOT NULL"
_LSIM = _SIM.format(a=_TRI.format("x.l"), b=_TRI.format("y.l"))


@query(
    f"SELECT source_id, target_id, round(CAST(m AS DOUBLE) + b, 4) AS match_score FROM (SELECT x.id AS source_id, y.id AS target_id, {_LSIM} AS m, CASE WHEN x.f = y.f THEN 0.2 ELSE 0 END + CASE WHEN x.s = y.s THEN 0.1 ELSE 0 END + CASE WHEN x.c = y.c THEN 0.1 ELSE 0 END AS b FROM ({_LOWER}) x JOIN ({_LOWER}) y ON x.id <> y.id AND levenshtein(x.l, y.l) <= 3 WHERE contains(x.l, 'ton')) "
    "WHERE m > CAST(0.6 AS FLOAT) ORDER BY match_score DESC, source_id, target_id LIMIT 500",
    base=False,
)
def matches_of_name(w):
    e = w.t("entity").withColumn("entity_id", F.col("entity_id").cast("long"))
    return matches_of(e, "T'ON", limit=500)


# ---- races, spenders, entities ----

_COMMITTEE = "(SELECT x.xref_id AS spender_id, n AS committee FROM cmte_filer x JOIN filer_name USING (filer_id))"
_RACE = f"office_state = 'CA' AND office_district = '2' AND election_year = {YEAR} AND election_type[1] = 'P'"


def _race(w: Warehouse) -> DataFrame:
    return E.of_race(w.ie(), "CA", "2", YEAR, "primary")


def _committee(w: Warehouse) -> DataFrame:
    return V.committee_names(w.t("filer_xref_cd"), w.t("filername_cd")).withColumnRenamed("xref_id", "spender_id")


def _sums(side: str, name: str) -> str:
    return f"{_M.format(f'sum(expenditure_amount) FILTER (WHERE support_oppose = {chr(39)}{side}{chr(39)})')} AS {name}_total, count(*) FILTER (WHERE support_oppose = '{side}') AS {name}_count"


@query(
    f"SELECT *, round(sum(for_total) OVER (), 2) AS race_for, round(sum(against_total) OVER (), 2) AS race_against FROM (SELECT resolved_candidate_id AS candidate_id, max(resolved_candidate_name) AS candidate_name, {_sums('S', 'for')}, {_sums('O', 'against')} FROM ie WHERE {_RACE} AND resolved_candidate_id IS NOT NULL GROUP BY 1 ORDER BY for_total + against_total DESC, candidate_id LIMIT 5)"
)
def race_by_district(w):
    return E.race_candidates(_race(w), 5)


@query(
    f"SELECT t.spender_id, coalesce(committee, t.spender_id) AS org, candidate_id, candidate, side, CASE side WHEN 'for' THEN 'in support of ' WHEN 'against' THEN 'in opposition to ' ELSE 'unknown regarding ' END || candidate AS purpose, amount, ie_count "
    f"FROM (SELECT spender_id, resolved_candidate_id AS candidate_id, coalesce(max(resolved_candidate_name), resolved_candidate_id) AS candidate, CASE support_oppose WHEN 'S' THEN 'for' WHEN 'O' THEN 'against' ELSE 'unknown' END AS side, {_M.format('sum(expenditure_amount)')} AS amount, count(*) AS ie_count FROM ie WHERE {_RACE} AND resolved_candidate_id IS NOT NULL GROUP BY spender_id, resolved_candidate_id, support_oppose HAVING amount > 100 ORDER BY amount DESC, spender_id, candidate_id, support_oppose LIMIT 200) t LEFT JOIN {_COMMITTEE} USING (spender_id)"
)
def race_spending_by_org(w):
    return E.spending_by_org(_race(w), _committee(w), 100)


@query(f"SELECT t.spender_id, coalesce(committee, t.spender_id) AS spender_name, ies, total FROM (SELECT spender_id, count(*) AS ies, {_M.format('sum(expenditure_amount)')} AS total FROM ie WHERE {_RACE} AND support_oppose = 'O' GROUP BY 1 ORDER BY total DESC, spender_id NULLS LAST LIMIT 5) t LEFT JOIN {_COMMITTEE} USING (spender_id)")
def race_top_spenders(w):
    return E.top_spenders(_race(w), "against", _committee(w))


_FACE = "SELECT '{0}' AS face, {1} AS value, {2} AS name, {3} AS side, expenditure_amount FROM ie WHERE spender_id = '9210883'"
_FACES = " UNION ALL ".join(_FACE.format(*x) for x in (("total", "NULL", "NULL", "NULL"), ("payee", "payee", "NULL", "NULL"), ("purpose", "purpose", "NULL", "NULL"), ("target", "resolved_candidate_id", "resolved_candidate_name", "CASE support_oppose WHEN 'S' THEN 'for' WHEN 'O' THEN 'against' ELSE 'unknown' END")))


@query(f"SELECT face, value, side, max(name) AS name, count(*) AS records, {_M.format('sum(expenditure_amount)')} AS total FROM ({_FACES}) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY face ORDER BY total DESC, value NULLS LAST, side NULLS LAST) <= 20")
def spender_faces(w):
    return E.spender_breakdown(w.ie().where("spender_id = '9210883'"), 20)


_NSIM = _SIM.format(a=_TRI.format("resolved_candidate_name"), b=_TRI.format("'nurses'"))


@query(f"SELECT resolved_candidate_id AS candidate_id, max(resolved_candidate_name) AS candidate_name, count(*) AS ie_records, round(CAST(max({_NSIM}) AS DOUBLE), 6) AS match FROM ie WHERE resolved_candidate_id IS NOT NULL AND office_state = 'CA' AND election_year = {YEAR} AND (resolved_candidate_name ILIKE '%nurses%' OR {_NSIM} >= CAST(0.3 AS FLOAT)) GROUP BY 1 ORDER BY match DESC, candidate_name, candidate_id LIMIT 20")
def find_candidate_in_state(w):
    return T.find_candidate(E.of_race(w.ie(), state="CA", cycle=YEAR), "nurses").withColumn("match", F.round(F.col("match").cast("double"), 6))


def _federal_gifts(w: Warehouse) -> DataFrame:
    rows = w.t("contribution_records").where(T.in_year("rcpt_date", YEAR)).select(F.lower(F.trim("source")).alias("s"), F.col("rcpt_date").alias("contribution_date"), F.col("amount").alias("contribution_amount"), F.col("donor_name").alias("contributor_name"), F.col("cmte_id").alias("other_committee_id"))
    return E.contributions_union(rows.where("s = 'rcpt_cd'"), rows.where("s <> 'rcpt_cd' or s is null"))


def _state_gifts(w: Warehouse) -> DataFrame:
    name = F.coalesce(F.when(F.col("donor_name") != "", F.col("donor_name")), "donor_naml", F.lit("UNKNOWN"))
    return w.receipts().where(T.in_year("receipt_date", YEAR)).select(F.col("receipt_date").alias("date"), "amount", name.alias("name"), F.lit(None).cast("string").alias("side"))


_FED_GIFTS = f"SELECT 'federal' AS source, coalesce(nullif(donor_name, ''), cmte_id, 'UNKNOWN') AS name, CAST(NULL AS VARCHAR) AS side, amount, rcpt_date AS date FROM contribution_records WHERE year(rcpt_date) = {YEAR}"
_STATE_GIFTS = f"SELECT 'state', coalesce(nullif(donor_name, ''), donor_naml, 'UNKNOWN'), NULL, amount, receipt_date FROM receipts WHERE year(receipt_date) = {YEAR}"
_PARTNERS = f"SELECT source, name, side, count(*) AS records, {_M.format('sum(amount)')} AS amount FROM ({{0}}) GROUP BY 1, 2, 3 HAVING sum(amount) >= {{1}} ORDER BY amount DESC, source, name, side NULLS LAST LIMIT 200"


@query(_PARTNERS.format(f"{_FED_GIFTS} UNION ALL {_STATE_GIFTS}", 2000))
def entity_contributors(w):
    return E.greatest_partners([("federal", _federal_gifts(w)), ("state", _state_gifts(w))], 2000)


@query(f"SELECT source, CAST(year(date) AS VARCHAR) AS year, count(*) AS records, {_M.format('sum(amount)')} AS total FROM ({_FED_GIFTS} UNION ALL {_STATE_GIFTS}) GROUP BY 1, 2")
def entity_contributions_by_year(w):
    return E.by_source_and_year([("federal", _federal_gifts(w)), ("state", _state_gifts(w))]).withColumn("year", F.col("year").cast("string"))


_OLD_IE = f"(SELECT * FROM ie_raw WHERE year(expenditure_date) = {YEAR} QUALIFY row_number() OVER (PARTITION BY spender_id, transaction_id ORDER BY expenditure_amount DESC NULLS FIRST, row_id) = 1)"
_SIDE = "CASE support_oppose WHEN 'S' THEN 'for' WHEN 'O' THEN 'against' ELSE 'unknown' END"


@query(_PARTNERS.format(f"SELECT 'federal' AS source, resolved_candidate_name AS name, {_SIDE} AS side, expenditure_amount AS amount FROM ie WHERE year(expenditure_date) = {YEAR} UNION ALL SELECT 'federal', coalesce(nullif(candidate_name, ''), '(candidate not captured)'), {_SIDE}, expenditure_amount FROM {_OLD_IE} UNION ALL SELECT 'state', coalesce(nullif(payee_naml, ''), '(unknown payee)'), NULL, amount FROM expns WHERE year(expn_date) = {YEAR}", 3000))
def entity_targets(w):
    inside = T.in_year("expenditure_date", YEAR)
    federal = E.spending_union(w.ie().where(inside), w.ie_raw().where(inside), "row_id")
    state = w.expn_all().where(T.in_year("expn_date", YEAR)).select(F.coalesce(F.when(F.col("payee_naml") != "", F.col("payee_naml")), F.lit("(unknown payee)")).alias("name"), F.lit(None).cast("string").alias("side"), "amount")
    return E.greatest_partners([("federal", federal), ("state", state)], 3000)


@query(f"SELECT coalesce(f.n, '(unknown)') AS committee, c.xref_id AS cmte_id, category, coalesce(category = 40002, false) AS is_candidate, count(*) AS payments, {_M.format('sum(amount)')} AS total FROM expn e JOIN filer_filings ff USING (filing_id) LEFT JOIN filer_name f ON f.filer_id = ff.filer_id LEFT JOIN filer_cmte c ON c.filer_id = ff.filer_id LEFT JOIN (SELECT filer_id, CASE upper(trim(filer_type)) WHEN 'CANDIDATE' THEN 40002 ELSE 40001 END AS category FROM filername_cd WHERE filer_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY effect_dt DESC NULLS LAST, category DESC) = 1) k ON k.filer_id = ff.filer_id WHERE {_VEND} AND category = 40002 GROUP BY 1, 2, 3, 4 ORDER BY total DESC, committee, cmte_id NULLS LAST LIMIT 10")
def candidates_paying_vendor(w):
    classes = w.t("filername_cd").where("filer_id is not null").select("filer_id", F.when(F.upper(F.trim("filer_type")) == "CANDIDATE", 40002).otherwise(40001).alias("category"), "effect_dt")
    return T.committees_paying_vendor(w.expn(), w.filer_filings(), w.t("filer_xref_cd"), w.t("filername_cd"), VENDOR, classes=classes, candidate=40002, candidate_only=True)


@query("SELECT committee_id, coalesce(CAST(x.filer_id AS BIGINT), CASE WHEN regexp_full_match(committee_id, '[0-9]+') THEN TRY_CAST(committee_id AS BIGINT) END, -1) AS filer_id FROM (SELECT DISTINCT cmte_id AS committee_id FROM rcpt_cd) r LEFT JOIN (SELECT * FROM filer_xref_cd WHERE filer_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY xref_id ORDER BY effect_dt DESC NULLS LAST, filer_id) = 1) x ON x.xref_id = r.committee_id", base=False)
def resolved_filers(w):
    return T.resolved_filers(w.t("rcpt_cd").select(F.col("cmte_id").alias("committee_id")), w.t("filer_xref_cd"))


def _race_expn(w: Warehouse) -> DataFrame:
    office = F.when(F.col("line_item") % 3 == 0, "SEN").when(F.col("line_item") % 3 == 1, "ASM")
    return w.expn().where("form_type = 'D'").withColumns({"cand_naml": F.col("payee_naml"), "cand_namf": F.col("payee_namf"), "office_cd": office, "sup_opp_cd": F.when(F.col("line_item") % 2 == 0, "S").otherwise("O"), "dist_no": (F.col("filing_id") % 2).cast("string"), "expn_code": F.lit("IND")})


def _district(w: Warehouse) -> DataFrame:
    return T.race_lines(_race_expn(w), V.filing_filer(w.filer_filings()), "1", YEAR)


_LN = f"ln AS (SELECT {_PNAME} AS candidate, CASE line_item % 3 WHEN 0 THEN 'SEN' WHEN 1 THEN 'ASM' END AS office, CASE WHEN line_item % 2 = 0 THEN 'S' ELSE 'O' END AS side, amount, expn_date AS \"on\" FROM expn WHERE form_type = 'D' AND filing_id % 2 = 1 AND year(expn_date) = {YEAR})"
_OF = "sum(CASE WHEN side = '{0}' THEN {1} ELSE 0 END)"


@query(
    RECURSIVE.rstrip() + ", " + _LN + ", " + merged_sql("SELECT candidate AS x FROM ln") + ", " + _SHOWN
    + f" SELECT shown AS candidate, {_M.format(_OF.format('S', 'amount'))} AS for_total, {_M.format(_OF.format('O', 'amount'))} AS against_total, CAST({_OF.format('S', '1')} AS BIGINT) AS for_count, CAST({_OF.format('O', '1')} AS BIGINT) AS against_count, min(\"on\") AS first_date, max(\"on\") AS last_date FROM rw JOIN sh USING (g) WHERE office = 'SEN' GROUP BY g, shown",
    base=False,
)
def race_roster(w):
    return T.race_roster(_district(w), "SEN")


@query(BASE.rstrip() + ", " + _LN + f" SELECT coalesce(trim(candidate), '(unnamed)') AS candidate, office, {_M.format('sum(amount)')} AS total, count(*) AS lines FROM ln WHERE office IS DISTINCT FROM 'SEN' GROUP BY 1, 2", base=False)
def race_unmatched(w):
    return T.race_unmatched(_district(w), "SEN")
