"""Connected components and the merging of name variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import candidate_tokens
from tallyforge.operators.skew import salted_join
from tallyforge.session import checkpointed


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): component is the smallest node reached; edges are (a, b), in any direction, repeated or not.

    Each round hooks every root to its smallest neighbouring root, if that is smaller,
    follows the hooks to their ends and contracts the edges to the roots that are left.
    A root that neither hooks nor is hooked to by all its neighbours is next to a
    smaller root in the following round, so that at least half of the roots go in two
    rounds; the rounds end when no edge is left, and more than ``rounds`` raise an
    error. Each round is written to the checkpoint folder. Edges to nodes that are not
    in nodes are ignored.
    """
    labels = checkpointed(nodes.select("node", F.col("node").alias("component")).distinct())
    known = labels.select("node")
    inside = edges.where("a <> b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    left = checkpointed(inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if left.isEmpty():
            return labels
        hooks = checkpointed(left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up")))
        while True:  # the hooks lead downwards, so that each pass halves the longest way
            over = hooks.select(F.col("root").alias("r2"), F.col("up").alias("up2"))
            further = checkpointed(hooks.join(over, hooks["up"] == over["r2"], "left").select("root", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
            hooks = further.select("root", "up")
            if further.where("moved").isEmpty():
                break
        labels = checkpointed(labels.join(hooks, labels["component"] == hooks["root"], "left").select("node", F.coalesce("up", "component").alias("component")))
        for c in ("a", "b"):
            left = left.join(hooks.withColumnRenamed("root", c), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        left = checkpointed(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if left.isEmpty():
        return labels
    raise RuntimeError(f"components are unfinished after {rounds} rounds")


def merged_names(names: DataFrame, name: str) -> DataFrame:
    """(name, group): names whose word sets contain one another (the smaller with two words or more) share a group.

    Candidate pairs share a word: the rarest word of the smaller set must occur in the
    larger, so names are joined on it alone. Null and blank names are left out.
    """
    n = names.select(F.trim(F.col(name)).alias("node")).where("node <> ''").distinct().withColumn("t", candidate_tokens(F.col("node")))
    words = n.select("node", "t", F.explode("t").alias("w"))
    rarity = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(rarity, "w")
    rarest = ranked.where(F.size("t") >= 2).groupBy("node").agg(F.min(F.struct("n", "w")).alias("m"), F.first("t").alias("t")).select(F.col("node").alias("a"), F.col("t").alias("ta"), F.col("m.w").alias("w"))
    larger = words.select(F.col("node").alias("b"), F.col("t").alias("tb"), "w")
    pairs = salted_join(rarest, larger, ["w"], "inner", lambda l, r: (F.col("a") != F.col("b")) & (F.size(F.array_except("ta", "tb")) == 0)).select("a", "b")
    return connected_components(n, pairs).select(F.col("node").alias(name), F.col("component").alias("group"))
