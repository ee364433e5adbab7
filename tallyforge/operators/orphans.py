"""References to records that do not exist, were deleted or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.keys import run_domain, run_number
from tallyforge.operators.skew import salted_join
from tallyforge.session import checkpointed

#: Keys per block: runs are cut at block ends, so a block has at most half as many runs.
BLOCK = 128
#: Runs up to which the run table is broadcast (about 50 bytes each).
BROADCAST_RUNS = 1_000_000


def _integer_key(df: DataFrame, key: str) -> tuple[Column, Column]:
    if dict(df.dtypes)[key] in ("int", "bigint", "smallint", "tinyint"):
        return F.lit("#"), F.col(key).cast("long")
    return run_domain(F.col(key)), run_number(F.col(key))


def key_runs(parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """(domain, block, runs): the parent keys as sorted contiguous runs, cut at block ends.

    A run is (first, last, live, sure_from): neighbouring integers that are all
    live (some row without ``until``) or all deleted; from sure_from on every key
    of a live run is in force. A text key is taken apart into a domain (what stands
    before its trailing digits, and their number) and an integer, so that ids such
    as C1000258 run as well.
    """
    domain, number = _integer_key(parents, key)
    keys = (
        parents.select(domain.alias("domain"), number.alias("num"), F.col(key).alias("key"), F.col(since).alias("since"), F.col(until).alias("until"))
        .where("key is not null")
        .groupBy("domain", "num")
        .agg(F.max(F.col("until").isNull()).alias("live"), F.min(F.when(F.col("until").isNull(), F.col("since"))).alias("sure_from"), F.max(F.col("until").isNull() & F.col("since").isNull()).alias("unsure"))
        .withColumn("block", F.floor(F.col("num") / BLOCK))
    )
    w = Window.partitionBy("domain", "block", "live").orderBy("num")
    return (
        keys.withColumn("island", F.col("num") - F.row_number().over(w))
        .groupBy("domain", "block", "live", "island")
        .agg(F.min("num").alias("first"), F.max("num").alias("last"), F.max("sure_from").alias("sure_from"), F.max("unsure").alias("unsure"))
        .groupBy("domain", "block")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last", "live", "sure_from", "unsure"))).alias("runs"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, *, ref_key: str, ref_time: str, keep: list[str], parent_key: str, since: str, until: str) -> DataFrame:
    """keep columns and orphan_kind of the rows of refs whose key is no parent in force.

    orphan_kind is ``missing`` (no parent row has the key), ``deleted`` (all parent
    rows with the key have ``until``) or ``late`` (a row without ``until`` exists, but
    none was in force at ref_time: since <= ref_time and until null or later).

    Method: the parents' keys are compressed into contiguous runs; every reference
    is matched as-of to the preceding run start of its block and is missing when it
    lies beyond that run's end. The run also tells most references that are surely
    in force; only the rest is checked against the single validity periods, by an
    anti join that spreads heavy keys. The run table is broadcast when it has at
    most BROADCAST_RUNS runs and joined with salted heavy blocks otherwise.

    Defined results: a null ref_key is no reference and gives no row; with a null
    ref_time a key can be missing or deleted but not late; a parent row with null
    ``since`` never is in force but makes its key known; repeated rows of refs come
    out as often as they stand there; with empty parents every reference is missing;
    columns that are not named are ignored, whatever their names.
    """
    runs = checkpointed(key_runs(parents, parent_key, since, until))
    domain, number = _integer_key(refs, ref_key)
    kept = [f"_tf_c{i}" for i in range(len(keep))]
    rows = refs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(ref_key).alias("_tf_key"), domain.alias("domain"), number.alias("num"), F.col(ref_time).alias("_tf_t")).where("_tf_key is not null")
    rows = rows.withColumn("block", F.floor(F.col("num") / BLOCK))
    if (runs.agg(F.sum(F.size("runs")).alias("n")).first()["n"] or 0) <= BROADCAST_RUNS:
        matched = rows.join(F.broadcast(runs), ["domain", "block"], "left")
    else:
        matched = salted_join(rows, runs, ["domain", "block"], "left")
    num = F.col("num")
    before = F.filter(F.col("runs"), lambda r: r["first"] <= num)
    matched = matched.withColumn("run", F.try_element_at(before, F.lit(-1))).drop("runs")
    kind = F.when(F.col("run").isNull() | (num > F.col("run.last")), "missing").when(~F.col("run.live"), "deleted")
    open_rows = (
        matched.withColumn("kind", kind)
        .where(F.col("kind").isNotNull() | (F.col("_tf_t").isNotNull() & (F.col("run.unsure") | F.col("run.sure_from").isNull() | (F.col("_tf_t") < F.col("run.sure_from")))))
        .select(*kept, "domain", "num", "_tf_t", "kind")
    )
    open_rows = checkpointed(open_rows)  # few rows; read twice below
    p_domain, p_number = _integer_key(parents, parent_key)
    periods = (
        parents.select(p_domain.alias("domain"), p_number.alias("num"), F.col(parent_key).alias("key"), F.col(since).alias("since"), F.col(until).alias("until"))
        .where("key is not null and since is not null")
        .groupBy("domain", "num", "until")  # of periods with one end only the longest counts
        .agg(F.min("since").alias("since"))
    )
    orphans = salted_join(
        open_rows,
        periods,
        ["domain", "num"],
        "left_anti",
        lambda l, r: l["kind"].isNull() & (r["since"] <= l["_tf_t"]) & (r["until"].isNull() | (r["until"] > l["_tf_t"])),
    )
    return orphans.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], F.coalesce("kind", F.lit("late")).alias("orphan_kind"))
