"""A total order over all rows without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import checkpointed


def ranked(df: DataFrame, order: Sequence[Column], name: str, parts: int = 0) -> DataFrame:
    """df with the rank of every row, from 1, by order, which must be total to be repeatable.

    The rows are split into ranges of the order and written to the checkpoint folder, so
    that every later pass sees the same ranges; a rank is the number of rows in the
    ranges before and the place within the row's own. parts is the number of ranges, by
    default the session's shuffle partitions.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.repartitionByRange(n, *order).withColumn("_tf_part", F.spark_partition_id()))
    sizes = cut.groupBy("_tf_part").agg(F.count(F.lit(1)).alias("_tf_n"))
    before = sizes.withColumn("_tf_before", F.sum("_tf_n").over(Window.orderBy("_tf_part")) - F.col("_tf_n")).drop("_tf_n")  # one row per range
    within = F.row_number().over(Window.partitionBy("_tf_part").orderBy(*order))
    return cut.withColumn(name, within).join(F.broadcast(before), "_tf_part").withColumn(name, F.col(name) + F.col("_tf_before")).drop("_tf_part", "_tf_before")
