"""Per-key results when a few keys hold most rows.

Nothing here brings the rows of one key together: totals come from mergeable
counts, exact quantiles from value histograms that are refined round by round,
and joins spread the heavy keys over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import checkpointed

#: A table of open ranges is broadcast only up to so many rows (about 50 bytes each).
BROADCAST_ROWS = 200_000
#: Hash values that heavy_keys selects among; light keys that share one only cost a count.
HASHES = 1 << 24


def key_histograms(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, bin, c, lo, hi): rows of every key by the binary magnitude of an integer value, with the least and greatest value.

    bin is 0 for 0, and for other values the number of binary digits with the
    value's sign (at most 127 bins); null values count under a null bin and a null
    key is a key. Counts merge on the map side: what is shuffled is bins, not rows.
    """
    v = F.col(value).cast("long")
    size = F.length(F.bin(F.abs(v))).cast("int")
    magnitude = F.when(v == 0, 0).when(v > 0, size).when(v < 0, -size)
    return df.select(F.col(key).alias("k"), magnitude.alias("bin"), v.alias("v")).groupBy("k", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def selected_ranks(rows: DataFrame, ranks: Callable[[Column], Column], bins: int, below: int | None = None) -> DataFrame:
    """(k, i, n, v): of every key k of rows (k, v) the value v at each wanted rank, among its n values in order.

    ranks makes the array of structs (i, rank) from n. Distributed selection: a first
    histogram, by binary magnitudes, or in ``bins`` equal bins where all values are known
    to lie from 0 to under ``below``, gives n and, for every rank, the bin that holds it;
    each round counts the rows within the ranges still open in at most ``bins`` equal
    bins, and the bin that holds a rank, narrowed to the values it has, is its next
    range, until ranges are single values. Ranks in one range share its histogram.
    Counts merge on the map side, so a round shuffles bins and never values. Each
    round's ranges are written to the checkpoint folder; a round is not repeated when an
    executor is lost later.
    """
    per_key = Window.partitionBy("k")  # one row per bin
    if below is None:
        first = key_histograms(rows, "k", "v")
    else:
        first = rows.groupBy("k", F.expr(f"v div {-(-below // bins)}").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sized = first.withColumn("n", F.sum("c").over(per_key)).withColumn("upto", F.sum("c").over(per_key.orderBy("bin")))
    state = sized.withColumn("x", F.explode(ranks(F.col("n")))).where("upto >= x.rank and upto - c < x.rank")
    state = checkpointed(state.select("k", F.col("x.i").alias("i"), "n", (F.col("x.rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi"))
    done = state.where("lo = hi")
    left = state.where("lo < hi")
    while many := left.count():
        ranges = left.select("k", "lo", "hi").distinct().withColumn("width", F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(float(bins))).cast("long"))
        open_rows = rows.join(F.broadcast(ranges), "k") if many <= BROADCAST_ROWS else salted_join(rows, ranges, ["k"], "inner")
        counted = open_rows.where("v >= lo and v <= hi").groupBy("k", "lo", F.expr("(v - lo) div width").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "lo").orderBy("bin")))  # at most `bins` rows
        held = counted.join(left.select("k", "i", "n", "rank", "lo"), ["k", "lo"]).where("upto >= rank and upto - c < rank")
        state = checkpointed(held.select("k", "i", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        done, left = done.unionByName(state.where("lo = hi")), state.where("lo < hi")
    return done.select("k", "i", "n", F.col("lo").alias("v"))


def heavy_keys(df: DataFrame, key: str, share: float, bins: int = 4096) -> DataFrame:
    """(key, n, total): non-null keys that hold at least the given share of all rows of df.

    total counts every row, also those with a null key. An empty df gives no rows.

    Method: exact selection. In the order of the keys' hashes, the rows of one key lie
    side by side, so a key with a share of all rows covers at least one of the ranks
    that stand that share apart. The hashes at these ranks (1 / share at most) are
    selected from histograms that are refined until the ranks resolve; only the keys
    with one of these hashes are then counted, exactly. Neither the number of keys nor
    the rows of the heaviest matter to any shuffle.
    """
    total = df.count()
    step = max(1, math.ceil(share * total))
    hashed = df.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(HASHES)).alias("v"), F.col(key).alias("key"))
    at = lambda n: F.when(n >= step, F.transform(F.sequence(F.lit(step).cast("long"), n, F.lit(step).cast("long")), lambda r: F.struct(r.alias("i"), r.alias("rank"))))
    found = selected_ranks(hashed.select(F.lit(0).alias("k"), "v"), at, bins, HASHES).select("v").distinct()
    counts = hashed.join(F.broadcast(found), "v", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.lit(total)).where(F.col("n") >= F.lit(share) * F.col("total")).select(F.col("key").alias(key), "n", "total")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, condition=None, keys: int = 200, least: int = 1000, salts: int = 32) -> DataFrame:
    """left join right on equal keys, with the heavy keys of left spread over salts tasks.

    Heavy are the most frequent keys, ``keys`` of them at most (hence a bounded
    broadcast, and every key with more than a 200th of the rows is among them) and
    with at least ``least`` rows. They get a random salt in left, and right's rows of
    those keys are repeated for every salt. how is inner, left, left_semi or left_anti.
    condition, where given, is a function of (left, right) that returns a Column.
    Null keys never match.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    on = list(on)
    names = [f"_tf_k{i}" for i in range(len(on))]
    counts = left.select(*[F.col(c).alias(n) for c, n in zip(on, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_tf_n"))
    heavy = F.broadcast(counts.where(F.col("_tf_n") >= least).orderBy(F.col("_tf_n").desc(), *names).limit(keys).select(*names))

    def marked(df: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, [df[c] == heavy[n] for c, n in zip(on, names)])
        return df.join(heavy.withColumn("_tf_hot", F.lit(True)), same, "left").drop(*names)

    l = marked(left).withColumn("_tf_salt", F.when(F.col("_tf_hot"), F.floor(F.rand(7) * salts).cast("int")).otherwise(F.lit(0))).drop("_tf_hot")
    r = marked(right).withColumn("_tf_salt_r", F.explode(F.when(F.col("_tf_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_tf_hot")
    r = r.withColumnsRenamed({c: f"_tf_r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [l[c] == r[f"_tf_r_{c}"] for c in on] + [l["_tf_salt"] == r["_tf_salt_r"]])
    if condition is not None:
        cond = cond & condition(l, r)
    return l.join(r, cond, how).drop("_tf_salt", "_tf_salt_r", *[f"_tf_r_{c}" for c in on])


def exact_quantiles(df: DataFrame, key: str, value: str, quantiles: Sequence[float], bins: int = 1024) -> DataFrame:
    """(key, quantile, n, value): exact discrete quantiles of an integer column per key.

    The quantile q of n values is the smallest value with at least ceil(q * n)
    values not above it (the minimum for q = 0). See selected_ranks for the method; a
    key that holds a third of all rows costs no task more than another, and the number
    of rounds follows from the widest open range alone. Values must lie within plus or
    minus 2**62. Null keys and null values are left out; a key without values gives no
    row; ties and repeated rows count as often as they occur.
    """
    qs = [float(q) for q in quantiles]
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles must lie within 0 and 1")
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).where("k is not null and v is not null")
    at = lambda n: F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(n * F.lit(q))).cast("long").alias("rank")) for i, q in enumerate(qs)])
    q_of = F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1)
    return selected_ranks(rows, at, bins).select(F.col("k").alias(key), q_of.alias("quantile"), "n", F.col("v").alias(value))
