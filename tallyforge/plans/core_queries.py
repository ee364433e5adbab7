"""The queries on orphans, snapshots, heavy keys and rejects, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.keys import key_form
from tallyforge.operators.orphans import orphan_references
from tallyforge.operators.rejects import parse_rows, read_layouts, typed_rows
from tallyforge.operators.skew import exact_quantiles, heavy_keys
from tallyforge.operators.snapshots import counted_deliveries, snapshot_changes
from tallyforge.sources.tables import table

#: Share of a table's rows from which a committee is heavy.
HEAVY_SHARE = 0.03
#: Columns of filername_cd whose changes count.
FILERNAME_FIELDS = ["filer_id", "filer_type", "status", "effect_dt", "naml", "namf", "namt", "nams", "city", "st"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = {
        "filing_id": table(spark, d, "filings_cd").select(F.col("filing_id").alias("key"), "loaded_at", "deleted_at"),
        "cmte_id": table(spark, d, "filer_xref_cd").select(key_form(F.col("xref_id")).alias("key"), "loaded_at", "deleted_at"),
    }
    found = []
    for field, parent in parents.items():
        facts = []
        for name in ("rcpt_cd", "expn_cd"):
            facts.append(table(spark, d, name).select(F.lit(name).alias("table_name"), F.lit(field).alias("ref_field"), "row_id", "loaded_at", (F.col(field) if field == "filing_id" else key_form(F.col(field))).alias("ref")))
        refs = reduce(DataFrame.unionByName, facts)
        found.append(orphan_references(refs, parent, ref_key="ref", ref_time="loaded_at", keep=["table_name", "ref_field", "row_id", "loaded_at"], parent_key="key", since="loaded_at", until="deleted_at"))
    return reduce(DataFrame.unionByName, found)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "ref_field", "row_id", "orphan_kind")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format(F.col("loaded_at").cast("date"), "yyyy-MM")
    return _orphans(spark, d).groupBy("table_name", "ref_field", "orphan_kind", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filername_cd").withColumn("delivery", F.regexp_extract("source_file", "([0-9]{8})", 1))
    counted = counted_deliveries(table(spark, d, "load_checkpoint"), "filername_cd")
    return snapshot_changes(rows, counted, key="id", snapshot="delivery", order=["line_no"], fields=FILERNAME_FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("id", "delivery", "change_kind")


def p2_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("change_kind = 'changed'").select("id", "delivery", "changed_fields")


def _committees(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(key_form(F.col("cmte_id")).alias("cmte_key"), (F.col("amount") * 100).cast("long").alias("cents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [heavy_keys(_committees(spark, d, t), "cmte_key", HEAVY_SHARE).select(F.lit(t).alias("table_name"), "cmte_key") for t in ("rcpt_cd", "contribution_records")]
    return parts[0].unionByName(parts[1])


def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t in ("rcpt_cd", "contribution_records"):
        q = exact_quantiles(_committees(spark, d, t), "cmte_key", "cents", [0.25, 0.5, 0.9])
        parts.append(q.select(F.lit(t).alias("table_name"), "cmte_key", "quantile", "n", "cents"))
    return parts[0].unionByName(parts[1])


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t in ("rcpt_cd", "contribution_records"):
        rows = _committees(spark, d, t).where("cmte_key is not null")
        parts.append(rows.groupBy("cmte_key").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents")).select(F.lit(t).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    layouts = read_layouts(table(spark, d, "file_columns"))
    lines = table(spark, d, "etl_dead_letter")
    return parse_rows(lines, layouts, id_col="id", table_col="table_name", line_col="row_data", keep=["source_file"]), layouts


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)[0].where("reason is not null").select("id", "reason")


def p7_rejects_by_file(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)[0].groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.count("reason").alias("rejected"))


def _valid(spark: SparkSession, d: str, name: str, amount: str) -> DataFrame:
    parsed, layouts = _parsed(spark, d)
    return typed_rows(parsed, name, layouts[name], "table_name", ["id", "source_file"]).withColumn(amount, F.col(amount).cast("double"))


def p7_valid_rcpt(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "rcpt_cd", "amount")


def p7_valid_individual_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "fec_individual_contributions", "contribution_amount")


def p7_valid_ie_targeted(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "fec_ie_targeted", "expenditure_amount")


QUERIES = {f.__name__: f for f in (p1_found, p1_by_month, p2_found, p2_changed_fields, p6_found, p6_quantiles, p6_totals, p7_found, p7_rejects_by_file, p7_valid_rcpt, p7_valid_individual_contributions, p7_valid_ie_targeted)}

KEY = "CASE WHEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') SIMILAR TO '.*[0-9].*' THEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') END"

_ORPHANS = f"""
WITH refs AS (
  SELECT 'rcpt_cd' AS table_name, 'filing_id' AS ref_field, row_id, loaded_at, CAST(filing_id AS VARCHAR) AS k FROM rcpt_cd
  UNION ALL SELECT 'expn_cd', 'filing_id', row_id, loaded_at, CAST(filing_id AS VARCHAR) FROM expn_cd
  UNION ALL SELECT 'rcpt_cd', 'cmte_id', row_id, loaded_at, {KEY.format('cmte_id')} FROM rcpt_cd
  UNION ALL SELECT 'expn_cd', 'cmte_id', row_id, loaded_at, {KEY.format('cmte_id')} FROM expn_cd),
parents AS (
  SELECT 'filing_id' AS ref_field, CAST(filing_id AS VARCHAR) AS k, loaded_at AS since, deleted_at AS until FROM filings_cd
  UNION ALL SELECT 'cmte_id', {KEY.format('xref_id')}, loaded_at, deleted_at FROM filer_xref_cd),
judged AS (
  SELECT r.table_name, r.ref_field, r.row_id, r.loaded_at, count(p.k) AS n, count(p.k) FILTER (WHERE p.until IS NULL) AS alive,
    count(p.k) FILTER (WHERE p.since <= r.loaded_at AND (p.until IS NULL OR p.until > r.loaded_at)) AS in_force
  FROM refs r LEFT JOIN parents p ON p.ref_field = r.ref_field AND p.k = r.k
  WHERE r.k IS NOT NULL GROUP BY ALL),
orphans AS (
  SELECT table_name, ref_field, row_id, loaded_at, CASE WHEN n = 0 THEN 'missing' WHEN alive = 0 THEN 'deleted' WHEN in_force = 0 THEN 'late' END AS orphan_kind FROM judged)
"""

_CHANGES = """
WITH counted AS (
  SELECT regexp_extract(source_file, '[0-9]{8}') AS delivery FROM load_checkpoint WHERE lower(trim(table_name)) = 'filername_cd'
  GROUP BY 1 HAVING bool_and(coalesce(rows_processed, 0) > 0) AND delivery <> ''),
steps AS (SELECT delivery, lead(delivery) OVER (ORDER BY delivery) AS after FROM counted),
last AS (
  SELECT f.id, s.delivery, s.after, %s
  FROM (SELECT *, regexp_extract(source_file, '[0-9]{8}') AS delivery FROM filername_cd) f JOIN steps s USING (delivery)
  WHERE f.id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY f.id, s.delivery ORDER BY line_no DESC, source_file DESC) = 1)
""" % ", ".join(f"nullif(trim(CAST(f.{c} AS VARCHAR)), '') AS {c}" for c in FILERNAME_FIELDS)
_DIFFERS = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in FILERNAME_FIELDS)
_FIELD_LIST = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in sorted(FILERNAME_FIELDS))

_P7_REASON = """
WITH layout AS (SELECT table_name, any_value(delimiter) AS d, any_value(quote_char) AS q, count(*) AS width FROM file_columns GROUP BY 1),
lines AS (
  SELECT e.id, e.source_file, e.table_name, e.row_data, l.d, l.q, l.width,
    l.q IS NOT NULL AND NOT regexp_full_match(e.row_data, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS misquoted,
    CASE WHEN l.q IS NULL THEN string_split(e.row_data, l.d)
         ELSE list_transform(regexp_extract_all(',' || e.row_data, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
                             lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) END AS f
  FROM etl_dead_letter e LEFT JOIN layout l USING (table_name)),
cells AS (
  SELECT x.id, bool_or(CASE WHEN trim(x.f[c.col_no], ' ') = '' THEN c.is_required
      WHEN c.value_type = 'int' THEN NOT regexp_full_match(trim(x.f[c.col_no], ' '), '-?[0-9]{1,9}')
      WHEN c.value_type = 'decimal' THEN NOT regexp_full_match(trim(x.f[c.col_no], ' '), '-?[0-9]{1,10}([.][0-9]{1,2})?')
      WHEN c.value_type = 'date' AND c.date_format = 'M/d/yyyy' THEN NOT (regexp_full_match(trim(x.f[c.col_no], ' '), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') AND try_strptime(trim(x.f[c.col_no], ' '), '%m/%d/%Y') IS NOT NULL)
      WHEN c.value_type = 'date' AND c.date_format = 'MMddyyyy' THEN NOT (regexp_full_match(trim(x.f[c.col_no], ' '), '[0-9]{8}') AND try_strptime(trim(x.f[c.col_no], ' '), '%m%d%Y') IS NOT NULL)
      WHEN c.value_type = 'date' THEN NOT (regexp_full_match(trim(x.f[c.col_no], ' '), '[0-9]{2}-[A-Za-z]{3}-[0-9]{2}') AND try_strptime(trim(x.f[c.col_no], ' '), '%d-%b-%y') IS NOT NULL)
      ELSE false END) AS bad
  FROM lines x JOIN file_columns c USING (table_name) WHERE len(x.f) = x.width AND NOT x.misquoted GROUP BY 1),
judged AS (
  SELECT x.*, CASE WHEN x.misquoted THEN 'quoting' WHEN x.width IS NULL OR x.row_data IS NULL OR len(x.f) <> x.width THEN 'column_count' WHEN c.bad THEN 'invalid_value' END AS reason
  FROM lines x LEFT JOIN cells c USING (id))
"""


def _valid_sql(name: str, columns: list[tuple[str, str]]) -> str:
    """The typed columns of one layout: (column, text, int, decimal or the date's format)."""
    forms = {"text": "CASE WHEN trim(f[{i}], ' ') <> '' THEN f[{i}] END", "int": "CAST(nullif(trim(f[{i}], ' '), '') AS INTEGER)", "decimal": "CAST(CAST(nullif(trim(f[{i}], ' '), '') AS DECIMAL(12,2)) AS DOUBLE)"}
    cells = [forms.get(kind, f"strptime(nullif(trim(f[{{i}}], ' '), ''), '{kind}')").format(i=i) + f" AS {column}" for i, (column, kind) in enumerate(columns, 1)]
    return _P7_REASON + f"SELECT id, source_file, {', '.join(cells)} FROM judged WHERE reason IS NULL AND table_name = '{name}'"


_INDIVIDUAL = [
    ("committee_id", "text"), ("amendment_ind", "text"), ("report_type", "text"), ("contributor_name", "text"), ("city", "text"), ("state", "text"), ("zip_code", "text"), ("contribution_date", "%m%d%Y"),
    ("contribution_amount", "decimal"), ("transaction_id", "text"), ("file_number", "int"), ("memo_text", "text"), ("receipt_no", "int"),
]
_TARGETED = [
    ("candidate_id", "text"), ("candidate_name", "text"), ("spender_id", "text"), ("spender_name", "text"), ("election_type", "text"), ("expenditure_date", "%d-%b-%y"), ("expenditure_amount", "decimal"),
    ("supported_opposed", "text"), ("purpose", "text"), ("payee", "text"), ("file_number", "int"), ("transaction_id", "text"),
]


def _p6_union(template: str) -> str:
    return " UNION ALL ".join(template.format(t=t, k=KEY.format("cmte_id")) for t in ("rcpt_cd", "contribution_records"))


SQL = {
    "p1_found": _ORPHANS + "SELECT table_name, ref_field, row_id, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
    "p1_by_month": _ORPHANS + "SELECT table_name, ref_field, orphan_kind, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p2_found": _CHANGES
    + f"""SELECT coalesce(b.id, a.id) AS id, coalesce(b.delivery, a.after) AS delivery,
        CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
      FROM (SELECT * FROM last WHERE after IS NOT NULL) a FULL JOIN (SELECT * FROM last WHERE delivery > (SELECT min(delivery) FROM counted)) b ON a.id = b.id AND a.after = b.delivery
      WHERE a.id IS NULL OR b.id IS NULL OR {_DIFFERS}""",
    "p2_changed_fields": _CHANGES + f"SELECT b.id, b.delivery, concat_ws(',', {_FIELD_LIST}) AS changed_fields FROM last a JOIN last b ON a.id = b.id AND a.after = b.delivery WHERE {_DIFFERS}",
    "p6_found": _p6_union("SELECT '{t}' AS table_name, cmte_key FROM (SELECT {k} AS cmte_key, count(*) AS n FROM {t} GROUP BY 1) WHERE cmte_key IS NOT NULL AND n >= 0.03 * (SELECT count(*) FROM {t})"),
    "p6_quantiles": _p6_union(
        "SELECT '{t}' AS table_name, cmte_key, q AS quantile, any_value(n) AS n, min(cents) FILTER (WHERE r >= ceil(q * n)) AS cents FROM (SELECT cmte_key, cents, row_number() OVER (PARTITION BY cmte_key ORDER BY cents) AS r, count(*) OVER (PARTITION BY cmte_key) AS n "
        "FROM (SELECT {k} AS cmte_key, CAST(amount * 100 AS BIGINT) AS cents FROM {t}) WHERE cmte_key IS NOT NULL AND cents IS NOT NULL), (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.9)) AS w(q) GROUP BY 2, 3"
    ),
    "p6_totals": _p6_union("SELECT '{t}' AS table_name, cmte_key, count(*) AS records, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents FROM (SELECT {k} AS cmte_key, CAST(amount * 100 AS BIGINT) AS cents FROM {t}) WHERE cmte_key IS NOT NULL GROUP BY 2"),
    "p7_found": _P7_REASON + "SELECT id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_rejects_by_file": _P7_REASON + "SELECT source_file, count(*) AS lines, count(reason) AS rejected FROM judged GROUP BY 1",
    "p7_valid_rcpt": _P7_REASON
    + """SELECT id, source_file, CAST(nullif(trim(f[1]), '') AS INTEGER) AS filing_id, CAST(nullif(trim(f[2]), '') AS INTEGER) AS amend_id, CAST(nullif(trim(f[3]), '') AS INTEGER) AS line_item,
        CASE WHEN trim(f[4]) <> '' THEN f[4] END AS form_type, CASE WHEN trim(f[5]) <> '' THEN f[5] END AS rec_type, CASE WHEN trim(f[6]) <> '' THEN f[6] END AS tran_id,
        CASE WHEN trim(f[7]) <> '' THEN f[7] END AS ctrib_naml, CASE WHEN trim(f[8]) <> '' THEN f[8] END AS ctrib_namf, CAST(CAST(nullif(trim(f[9]), '') AS DECIMAL(12,2)) AS DOUBLE) AS amount,
        strptime(nullif(trim(f[10]), ''), '%m/%d/%Y') AS rcpt_date, CASE WHEN trim(f[11]) <> '' THEN f[11] END AS cmte_id
      FROM judged WHERE reason IS NULL AND table_name = 'rcpt_cd'""",
    "p7_valid_individual_contributions": _valid_sql("fec_individual_contributions", _INDIVIDUAL),
    "p7_valid_ie_targeted": _valid_sql("fec_ie_targeted", _TARGETED),
}
