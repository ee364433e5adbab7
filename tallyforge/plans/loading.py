"""Loading files into stored tables: skip what is known, reject what does not fit, put in the rest by key."""

from __future__ import annotations

import datetime
import logging

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import REFRESH_ORDER, spec_from_header
from tallyforge.plans.views import deduped, expn_all, filing_filer, ie_dedup, ie_resolved, receipts_all
from tallyforge.session import checkpointed
from tallyforge.sources.delimited import TableSpec, judged_lines, rejects_of, rows_of
from tallyforge.sources.store import Snapshots, dead_letters, file_hashes, files_to_load

LOG = logging.getLogger(__name__)
MANIFEST = "table_name string, source string, file_hash string, source_file string, processed_date timestamp, rows_processed long"


def header_of(spark: SparkSession, path: str, delimiter: str = "\t") -> list[str]:
    """The fields of the first line with content."""
    first = spark.read.option("lineSep", "\n").text(path).where("trim(value) <> ''").first()
    return first["value"].rstrip("\r").split(delimiter) if first else []


def load_files(spark: SparkSession, store: Snapshots, path: str, spec: TableSpec | None, table: str, source: str, row_filter: Column | None = None) -> dict:
    """Loads the files of path that were not loaded before; returns what happened in numbers, and the files that gave no row.

    Without spec the first file's header decides. All files are read by one reader,
    once: what is made of their lines is written to the checkpoint folder, and the
    rows, the rejects and the counts are taken from there. Rows are put in by key, the
    last of equal keys in file order wins; tables without a key are replaced. Only the
    buckets that the new keys fall into are rewritten. Rows without a required column,
    or that row_filter drops, are skipped and counted; rows in error go to dead letters
    as JSON. A manifest remembers each file by its content.
    """
    manifest = store.current("load_checkpoint")
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    found = checkpointed(file_hashes(spark, path))
    todo = [r["source_file"] for r in files_to_load(found, manifest, table, source).select("source_file").collect()]  # names of files, not data
    done = {"files": len(todo), "skipped_files": found.count() - len(todo), "read": 0, "rows": 0, "skipped": 0, "rejected": 0, "empty_files": []}
    if not todo:
        return done
    spec = spec or spec_from_header(table, header_of(spark, todo[0]))
    judged = checkpointed(judged_lines(spark, todo, spec, row_filter))
    new = rows_of(judged).withColumn("_seq", F.struct("file", "at")).drop("at", "file")
    stored = store.upsert(table, new, spec.key, "_seq") if spec.key else store.write(table, new.drop("_seq"))
    tally = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad = F.col("error").isNotNull()
    per_file = checkpointed(judged.groupBy(F.col("file").alias("source_file")).agg(F.count(F.lit(1)).alias("read"), tally(~bad & ~F.col("skip")).alias("rows_processed"), tally(bad).alias("rejected"), tally(F.col("skip")).alias("skipped")))
    sums = per_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "rejected", "skipped")]).first()
    if sums["rejected"]:
        store.add("etl_dead_letter", dead_letters(rejects_of(judged), table, "error", "file"))
    now = F.lit(datetime.datetime.now(datetime.timezone.utc))
    loaded = found.where(F.col("source_file").isin(todo)).join(per_file, "source_file", "left").withColumn("rows_processed", F.coalesce("rows_processed", F.lit(0)).cast("long"))
    loaded = checkpointed(loaded.select(F.lit(table).alias("table_name"), F.lit(source).alias("source"), "file_hash", "source_file", now.alias("processed_date"), "rows_processed"))
    store.add("load_checkpoint", loaded)
    empty = sorted(r["source_file"] for r in loaded.where("rows_processed = 0").select("source_file").collect())  # names of files
    for f in empty:
        LOG.warning("%s gave no row for %s", f, table)
    return done | sums.asDict() | {"rows": stored.count(), "empty_files": empty}


def refresh_views(store: Snapshots) -> None:
    """Builds the stored views anew, each after what it builds on; those of independent expenditures where that table is loaded."""
    builders = {
        "filing_filer": lambda: filing_filer(store.current("filer_filings_cd")),
        "receipts_all": lambda: receipts_all(*[deduped(store.current(t), t) for t in ("rcpt_cd", "s497_cd", "s498_cd")], store.current("filing_filer")),
        "expn_all": lambda: expn_all(deduped(store.current("expn_cd"), "expn_cd"), store.current("lexp_cd"), store.current("s496_cd"), store.current("filing_filer")),
    }
    store.refresh([(n, builders[n]) for n in REFRESH_ORDER])
    if store.current("fec_ie_targeted") is not None:
        store.refresh([("fec_ie_targeted_resolved", lambda: ie_resolved(ie_dedup(store.current("fec_ie_targeted"), "sub_id")))])


