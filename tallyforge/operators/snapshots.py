"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(name: str, dtype: str) -> Column:
    c = F.trim(F.col(name).cast("string"))
    return F.when(c != "", c)


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, *, key: str, snapshot: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, snapshot, change_kind, changed_fields) between consecutive snapshots.

    rows holds all snapshots below each other, ``snapshot`` naming the one a row
    belongs to; ``snapshots`` (one column of that name) lists those that count, in
    their sort order. Of a key's rows in one snapshot the one that is last by
    ``order`` counts. Values are compared as text without outer spaces, an empty
    one equal to null. change_kind is added, removed or changed against the counted
    snapshot just before; changed_fields names the differing fields, sorted and
    joined by commas (empty unless changed).

    Method: the last row of each (key, snapshot) is found with map-side combining;
    then rows are placed by key once, unpivoted into cells (key, step, field, value)
    with sign +1 in their own step and -1 in the following one, next to a presence
    marker. Sums that are not zero are the differences: a marker of +1 or -1 means
    added or removed, other cells give the changed fields. All groupings after the
    placement use it, so cells are never shuffled, and no key has more rows there
    than there are snapshots.

    Defined results: rows with a null key or a snapshot that does not count are
    ignored, repeated rows and ties in order change nothing as long as their values
    agree (else the greatest values count); one snapshot or none gives no rows;
    other columns are ignored, whatever their names.
    """
    types = dict(rows.dtypes)
    w = Window.orderBy("s")  # one row per snapshot
    steps = snapshots.select(F.col(snapshot).alias("s")).where("s is not null").distinct().withColumn("more", F.lead("s").over(w).isNotNull()).withColumn("no", F.row_number().over(w))
    values = [_text(f, types[f]).alias(f"v{i}") for i, f in enumerate(fields)]
    last = (
        rows.select(F.col(key).alias("k"), F.col(snapshot).alias("s"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *values).alias("row"))
        .where("k is not null and s is not null")
        .join(steps, "s")
        .groupBy("k", "no", "more")
        .agg(F.max("row").alias("row"))
    )
    cells = F.array(
        F.struct(F.lit(-1).alias("f"), F.lit(None).cast("string").alias("v")),
        *[F.struct(F.lit(i).alias("f"), F.col(f"row.v{i}").alias("v")) for i in range(len(fields))],
    )
    signed = F.array(F.struct(F.when(F.col("no") > 1, F.col("no")).alias("step"), F.lit(1).alias("sign")), F.struct(F.when(F.col("more"), F.col("no") + 1).alias("step"), F.lit(-1).alias("sign")))
    sums = (
        last.repartition("k")
        .withColumn("x", F.explode(signed))
        .where("x.step is not null")
        .withColumn("cell", F.explode(cells))
        .groupBy("k", F.col("x.step").alias("step"), F.col("cell.f").alias("f"), F.col("cell.v").alias("v"))
        .agg(F.sum("x.sign").alias("d"))
        .where("d <> 0")
    )
    presence = F.max(F.when(F.col("f") == -1, F.col("d")))
    names = F.array(*[F.lit(f) for f in fields])
    changed = F.array_sort(F.transform(F.collect_set(F.when(F.col("f") >= 0, F.col("f"))), lambda i: F.element_at(names, i + 1)))
    return (
        sums.groupBy("k", "step")
        .agg(presence.alias("p"), changed.alias("c"))
        .join(steps.select("s", F.col("no").alias("step")), "step")
        .select(
            F.col("k").alias(key),
            F.col("s").alias(snapshot),
            F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("p").isNull(), F.array_join("c", ",")).otherwise(F.lit("")).alias("changed_fields"),
        )
    )


def counted_deliveries(files: DataFrame, table_name: str, date_pattern: str = r"([0-9]{8})") -> DataFrame:
    """(delivery): eight-digit dates all of whose recorded files have rows_processed > 0, without those that repeat the one before.

    A delivery whose files have the same contents, by file_hash, as those of the counted
    delivery just before it changes nothing, and the next one differs from it as from
    its predecessor: it is left out, so that none of its rows is unpivoted or compared.
    Files without a hash are never equal.
    """
    days = (
        files.where(F.lower(F.trim("table_name")) == table_name.lower())
        .select(F.regexp_extract("source_file", date_pattern, 1).alias("delivery"), (F.coalesce("rows_processed", F.lit(0)) > 0).alias("ok"), "file_hash")
        .where("delivery <> ''")
        .groupBy("delivery")
        .agg(F.min("ok").alias("ok"), F.array_sort(F.collect_list("file_hash")).alias("hashes"), F.count(F.lit(1)).alias("n"))
        .where("ok")
    )
    before = F.lag("hashes").over(Window.orderBy("delivery"))  # one row per delivery
    return days.withColumn("repeats", F.coalesce((F.size("hashes") == F.col("n")) & (F.col("hashes") == before), F.lit(False))).where("not repeats").select("delivery")
