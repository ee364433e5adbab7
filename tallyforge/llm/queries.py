"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.keys import key_form, placeholder_list
from tallyforge.llm.leakage import leaked_items
from tallyforge.llm.linkage import linked
from tallyforge.llm.packing import pack, token_counts
from tallyforge.llm.survivors import Bundle, best_representatives
from tallyforge.llm.truncation import truncated_texts
from tallyforge.llm.variants import variant_clusters, variant_pairs
from tallyforge.sources.tables import table

#: A public byte-level vocabulary, readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens a container holds.
CAPACITY = 2048
#: Sources of a gift from most to least trusted.
SOURCES = ["rcpt_cd", "s498_cd", "s497_cd"]
GIFT_FIELDS = {
    "rcpt_cd": ("row_id", ["amount", "rcpt_date", "memo_refno", "ctrib_dscr", "ctrib_naml"]),
    "contribution_records": ("rec_id", ["amount", "rcpt_date", "memo_refno", "purpose", "donor_name"]),
}


def _gift_trust(name: str) -> list[Column]:
    trust = [F.col("amend_id"), F.col("loaded_at")]
    if name == "contribution_records":
        source = F.lower(F.regexp_replace("source", " ", ""))
        rank = F.lit(0)
        for i, s in enumerate(SOURCES):
            rank = F.when(source == s, len(SOURCES) - i).otherwise(rank)
        trust.insert(1, rank)
    return trust


def _gift_keys() -> list[Column]:
    return [key_form(F.col("cmte_id")), key_form(F.col("tran_id"))]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    words = placeholder_list(table(spark, d, "placeholder_words"))
    parts = []
    for name, (id_col, fields) in GIFT_FIELDS.items():
        best = best_representatives(table(spark, d, name), _gift_keys(), id_col=id_col, bundles=[Bundle(f, (f,)) for f in fields], trust=_gift_trust(name), placeholders=words)
        parts.append(best.select(F.lit(name).alias("table_name"), "group_id", F.col("bundle").alias("field_name"), "from_id"))
    return parts[0].unionByName(parts[1])


def p3_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Name and address of a donor as whole bundles that must stand together in some row of the gift."""
    words = placeholder_list(table(spark, d, "placeholder_words"))
    bundles = [Bundle("name", ("ctrib_naml", "ctrib_namf")), Bundle("address", ("ctrib_city", "ctrib_st")), Bundle("amount", ("amount",))]
    return best_representatives(table(spark, d, "rcpt_cd"), _gift_keys(), id_col="row_id", bundles=bundles, trust=_gift_trust("rcpt_cd"), placeholders=words, dependencies=[("name", "address")])


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain some of an item, and the longest passage in words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents"), doc_id="doc_id", source="source", text="text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each source lost their end."""
    return _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut"), F.avg(F.col("cut").cast("int")).alias("rate"))


def _entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    return variant_clusters(table(spark, d, "entity"), row_id="entity_id", last="naml", first="namf", kind="entity_type", town="city", state="st", code="zip4")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(_entity_clusters(spark, d)).select(F.col("id_a").cast("int").alias("entity_id_a"), F.col("id_b").cast("int").alias("entity_id_b"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every entity row and the number of spellings in it."""
    c = _entity_clusters(spark, d)
    sizes = c.groupBy("cid").agg(F.count(F.lit(1)).alias("spellings"))
    return c.join(sizes, "cid").select(F.col("id").cast("int").alias("entity_id"), F.col("cid").cast("int").alias("cluster_id"), "spellings")


def _committee_links(spark: SparkSession, d: str) -> DataFrame:
    fec = table(spark, d, "fec_committees").where("committee_id is not null").withColumn("number", F.xxhash64("committee_id"))
    entity = table(spark, d, "entity")
    cited = table(spark, d, "contribution_records").select("donor_name", key_form(F.col("cmte_id")).alias("ck")).where("donor_name is not null and ck is not null").groupBy("donor_name", "ck").agg(F.count(F.lit(1)).alias("n"))
    ids = fec.select(key_form(F.col("committee_id")).alias("ck"), F.col("number").alias("rid"))
    names = entity.select(F.col("entity_id").cast("long").alias("id"), F.col("fullname").alias("donor_name")).where("donor_name is not null")
    hints = cited.join(ids, "ck").join(names, "donor_name").groupBy("id", "rid").agg(F.sum("n").alias("n"))
    links = linked(
        entity, fec, hints,
        left_id="entity_id", left_names={"last": "naml", "first": "namf", "kind": "entity_type", "town": "city", "state": "st", "code": "zip4"},
        right_id="number", right_names={"last": "committee_name", "first": None, "kind": None, "town": "city", "state": "state", "code": "zip"},
    )
    return links.join(fec.select("number", "committee_id"), "number").select(F.col("entity_id").cast("int").alias("entity_id"), "committee_id", "confidence")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _committee_links(spark, d).select("entity_id", "committee_id")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The matched rows with the model's posterior."""
    return _committee_links(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each piece of a document above the capacity."""
    sizes = token_counts(table(spark, d, "documents"), doc_id="doc_id", text="text", vocabulary=VOCABULARY)
    return pack(sizes, item_id="doc_id", size="tokens", capacity=CAPACITY)


QUERIES = {f.__name__: f for f in (p3_found, p3_bundles, p4_found, p4_entities, p5_found, p5_confidence, p9_found, p9_by_item, p8_containers, p10_found, p10_rates)}

_KEY = "CASE WHEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') SIMILAR TO '.*[0-9].*' THEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') END"


def _filled(field: str) -> str:
    if field in ("amount", "rcpt_date"):
        return f"{field} IS NOT NULL"
    return f"coalesce(regexp_matches({field}, '[\\p{{L}}\\p{{N}}]') AND upper(trim({field})) NOT IN (SELECT upper(trim(word)) FROM placeholder_words WHERE word IS NOT NULL), false)"


def _p3_sql() -> str:
    parts = []
    for name, (id_col, fields) in GIFT_FIELDS.items():
        rank = "CASE lower(replace(source, ' ', '')) WHEN 'rcpt_cd' THEN 3 WHEN 's498_cd' THEN 2 WHEN 's497_cd' THEN 1 ELSE 0 END" if name != "rcpt_cd" else "0"
        keyed = f"SELECT *, {_KEY.format('cmte_id')} AS ck, {_KEY.format('tran_id')} AS tk, {rank} AS sr FROM {name}"
        grouped = f"SELECT *, count(*) OVER (PARTITION BY ck, tk) AS n, min({id_col}) OVER (PARTITION BY ck, tk) AS group_id FROM ({keyed}) WHERE ck IS NOT NULL AND tk IS NOT NULL"
        for f in fields:
            parts.append(
                f"SELECT '{name}' AS table_name, group_id, '{f}' AS field_name, {id_col} AS from_id FROM ({grouped}) WHERE n >= 2 AND {_filled(f)} "
                f"QUALIFY row_number() OVER (PARTITION BY ck, tk ORDER BY amend_id DESC NULLS LAST, sr DESC, loaded_at DESC NULLS LAST, {id_col}) = 1"
            )
    return " UNION ALL ".join(parts)


_GRAMS = "SELECT {id}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}))"

_LONGEST = (
    "WITH d AS (SELECT doc_id, gram, pos FROM (SELECT doc_id, unnest(range(1, len(w) - 10)) AS pos, array_to_string(w[pos:pos + 11], ' ') AS gram FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents))), "
    "i AS (SELECT item_id, gram, pos FROM (SELECT item_id, unnest(range(1, len(w) - 10)) AS pos, array_to_string(w[pos:pos + 11], ' ') AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items))), "
    "hits AS (SELECT doc_id, item_id, d.pos AS p, d.pos - i.pos AS line FROM d JOIN i USING (gram)), "
    "runs AS (SELECT doc_id, item_id, line, p - row_number() OVER (PARTITION BY doc_id, item_id, line ORDER BY p) AS run FROM (SELECT DISTINCT * FROM hits)), "
    "sizes AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM runs GROUP BY doc_id, item_id, line, run) "
    "SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(words) AS INTEGER) AS longest FROM sizes GROUP BY 1"
)


def _bundles_sql() -> str:
    """Every combination of the distinct values of a gift's bundles, one of them possibly left empty; the cheapest allowed one, bundle by bundle the smaller of equals."""
    bundles = {"name": ("ctrib_naml", "ctrib_namf"), "address": ("ctrib_city", "ctrib_st"), "amount": ("amount",)}
    filled = {b: " + ".join(f"CAST({_filled(f)} AS INTEGER)" for f in fs) for b, fs in bundles.items()}
    value = {b: "concat_ws('|', " + ", ".join(f"CASE WHEN {_filled(f)} THEN '{f}=' || CAST({f} AS VARCHAR) END" for f in fs) + ")" for b, fs in bundles.items()}
    keyed = f"SELECT *, {_KEY.format('cmte_id')} AS ck, {_KEY.format('tran_id')} AS tk FROM rcpt_cd"
    sql = f"WITH keyed AS (SELECT *, min(row_id) OVER (PARTITION BY ck, tk) AS g, count(*) OVER (PARTITION BY ck, tk) AS n FROM ({keyed}) WHERE ck IS NOT NULL AND tk IS NOT NULL), rows AS (SELECT *"
    sql += "".join(f", CASE WHEN {filled[b]} > 0 THEN {value[b]} END AS v_{b}, {filled[b]} AS f_{b}" for b in bundles) + " FROM keyed WHERE n >= 2)"
    for b in bundles:
        order = f"f_{b} DESC, amend_id DESC NULLS LAST, loaded_at DESC NULLS LAST, row_id"
        sql += f", best_{b} AS (SELECT g, v_{b} AS v, f_{b}, amend_id, loaded_at, row_id FROM rows WHERE v_{b} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, v_{b} ORDER BY {order}) = 1)"
        sql += f", opt_{b} AS (SELECT g, v, row_id AS id, row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS r, row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS cost FROM best_{b} UNION ALL SELECT g, NULL, NULL, 1000000, count(*) FROM best_{b} GROUP BY g UNION ALL SELECT g, NULL, NULL, 1000000, 0 FROM (SELECT DISTINCT g FROM rows) ANTI JOIN best_{b} USING (g))"
    sql += (
        ", choices AS (SELECT n.g, n.id AS name, a.id AS address, m.id AS amount, row_number() OVER (PARTITION BY n.g ORDER BY n.cost + a.cost + m.cost, n.r, a.r, m.r) AS k FROM opt_name n JOIN opt_address a ON a.g = n.g JOIN opt_amount m ON m.g = n.g"
        " WHERE n.v IS NULL OR a.v IS NULL OR EXISTS (SELECT 1 FROM rows r WHERE r.g = n.g AND r.v_name = n.v AND r.v_address = a.v))"
    )
    return sql + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT g AS group_id, '{b}' AS bundle, {b} AS from_id FROM choices WHERE k = 1" for b in bundles) + ") WHERE from_id IS NOT NULL"


SQL = {
    "p3_found": _p3_sql(),
    "p3_bundles": _bundles_sql(),
    "p9_by_item": _LONGEST,
    "p9_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_GRAMS.format(id='doc_id', t='documents')}) d JOIN ({_GRAMS.format(id='item_id', t='eval_items')}) i USING (gram)",
}
