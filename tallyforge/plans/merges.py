"""Merging of entities: suggestions, their queue, and what applying them changes. All steps take and give tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import trigrams
from tallyforge.operators.similar import name_classes, similar_names, similar_pairs
from tallyforge.session import checkpointed

QUEUE = "queue_id long, entity_a_id long, entity_b_id long, match_score double, match_method string, status string, reviewed_by string, reviewed_at timestamp_ntz, notes string"
#: Score from which a suggestion is applied without review.
CERTAIN = 0.95


def matches_of(entities: DataFrame, name: str, city: str | None = None, state: str | None = None, threshold: float = 0.7, edits: int = 3, limit: int = 10) -> DataFrame:
    """(source_id, target_id, match_score): entities whose family name contains the text, with similar others, best first.

    The score is the similarity of the family names, above threshold - 0.1 and within
    ``edits``, with 0.2 for an equal given name, 0.1 for an equal suffix and 0.1 for an
    equal town. Similar family names are searched among the distinct ones. Entities that
    agree in all that is compared score alike, so that only the limit + 1 smallest ids
    among them can come first; so copies never multiply.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    rows = entities.select(F.col("entity_id").alias("id"), low("naml").alias("l"), low("namf").alias("f"), low("nams").alias("s"), low("city").alias("c"), F.upper(F.trim("st")).alias("st")).where("id is not null and l is not null")
    plain = "".join(ch for ch in name.lower() if ch.isalnum() or ch == " ")[:50]
    own = F.col("l").contains(plain)
    if city:
        own &= F.coalesce(F.col("c") == city.strip().lower(), F.lit(False))
    if state:
        own &= F.coalesce(F.col("st") == state.strip().upper()[:2], F.lit(False))
    first = F.row_number().over(Window.partitionBy(*"lfsc").orderBy("id"))
    side = lambda df, x: df.withColumn("place", first).where(F.col("place") <= limit + 1).select(F.col("id").alias(f"{x}_id"), *[F.col(c).alias(f"{c}{x[0]}") for c in "lfsc"])
    names = rows.groupBy(F.col("l").alias("name")).agg(F.max(own).alias("own")).withColumn("l", F.col("name"))
    least = F.lit(threshold - 0.1).cast("float")
    near = checkpointed(similar_names(names, "l", threshold - 0.1, edits, "own").where(F.col("similarity") > least))  # each pair once, used both ways
    same = names.where(F.col("own") & (F.size(trigrams(F.col("l"))) > 0)).select(F.col("l").alias("ls"), F.col("l").alias("lt"), F.lit(1.0).cast("float").alias("similarity")).where(F.col("similarity") > least)
    close = near.select(F.col("a").alias("ls"), F.col("b").alias("lt"), "similarity").unionByName(near.select(F.col("b").alias("ls"), F.col("a").alias("lt"), "similarity")).unionByName(same).withColumn("similarity", F.col("similarity").cast("double"))
    wide = side(rows.where(own), "source").join(close, "ls").join(side(rows, "target"), "lt").where("source_id <> target_id")
    bonus = sum((F.when(F.col(f"{c}s") == F.col(f"{c}t"), v).otherwise(0.0) for c, v in (("f", 0.2), ("s", 0.1), ("c", 0.1))), F.lit(0.0))
    return wide.select("source_id", "target_id", F.round(F.col("similarity") + bonus, 4).alias("match_score")).orderBy(F.col("match_score").desc(), "source_id", "target_id").limit(limit)


@dataclass(frozen=True)
class Merges:
    """entity (entity_id, resolved_by, ...), alias (entity_id, alias_name, source_filer_id, source_table) and queue (QUEUE)."""

    entity: DataFrame
    alias: DataFrame
    queue: DataFrame

    def scan(self, threshold: float = 0.7, edits: int = 3, name: str = "naml") -> DataFrame:
        """(a, b, score): pairs of unresolved entities with similar names that are not pending yet.

        Entities with one and the same name are paired with the first of them only; pairs
        of different names are those of the first of each name. So every entity with a
        partner comes up, and copies never multiply.
        """
        free = self.entity.where("resolved_by is null")
        equal = name_classes(free, "entity_id", name).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
        near = similar_pairs(free, "entity_id", name, threshold, edits).select("a", "b", F.round(F.col("similarity").cast("double"), 4).alias("score"))
        waiting = self.queue.where("status = 'pending'").select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"))
        return equal.unionByName(near).join(waiting, ["a", "b"], "left_anti")

    def suggested(self, pairs: DataFrame, method: str = "manual", notes: Column | None = None) -> Merges:
        """With pairs (a, b, score) added as pending; their numbers follow the greatest and need not be dense."""
        last = self.queue.agg(F.coalesce(F.max("queue_id"), F.lit(0))).scalar()
        number = (last + 1 + F.monotonically_increasing_id()).alias("queue_id")
        text = F.lit(None).cast("string")
        new = pairs.select(number, F.col("a").cast("long").alias("entity_a_id"), F.col("b").cast("long").alias("entity_b_id"), F.col("score").alias("match_score"), F.lit(method).alias("match_method"), F.lit("pending").alias("status"), text.alias("reviewed_by"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), (text if notes is None else notes).alias("notes"))
        return replace(self, queue=self.queue.unionByName(new))

    def pending(self, limit: int = 100) -> DataFrame:
        """Pending suggestions, best first."""
        rows = self.queue.where("status = 'pending'").select("queue_id", "entity_a_id", "entity_b_id", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), F.coalesce("match_method", F.lit("")).alias("match_method"), "notes")
        return rows.orderBy(F.col("match_score").desc(), "entity_a_id", "entity_b_id", "queue_id").limit(limit)

    def _reviewed(self, chosen: DataFrame, status: str, by: str | None, at: str) -> DataFrame:
        marked = self.queue.join(chosen.select("queue_id", F.lit(True).alias("chosen")), "queue_id", "left")
        put = lambda c, v: F.when(F.col("chosen"), v).otherwise(F.col(c)).alias(c)
        return marked.select("queue_id", "entity_a_id", "entity_b_id", "match_score", "match_method", put("status", F.lit(status)), put("reviewed_by", F.lit(by).cast("string")), put("reviewed_at", F.lit(at).cast("timestamp_ntz")), "notes")

    def applied(self, where: Column, by: str | None, at: str) -> Merges:
        """With the pending suggestions that the condition holds for applied: b points to a, a has b's aliases, the queue says so.

        An alias that a has already is not copied; the aliases copied are those before
        the call. Of several suggestions for one b the one with the best score counts for
        its pointer. ValueError when nothing pending is chosen.
        """
        chosen = self.queue.where((F.col("status") == "pending") & where).select("queue_id", "entity_a_id", "entity_b_id", "match_score")
        if chosen.isEmpty():
            raise ValueError("no pending suggestion is chosen")
        new = self.alias.join(chosen.select(F.col("entity_b_id").alias("entity_id"), "entity_a_id"), "entity_id").select(F.col("entity_a_id").alias("entity_id"), "alias_name", "source_filer_id", "source_table")
        new = new.groupBy("entity_id", "alias_name").agg(F.min(F.struct("source_filer_id", "source_table")).alias("s")).select("entity_id", "alias_name", "s.*")
        missing = new.join(self.alias.select("entity_id", "alias_name"), ["entity_id", "alias_name"], "left_anti")
        best = chosen.groupBy(F.col("entity_b_id").alias("entity_id")).agg(F.max_by("entity_a_id", F.struct("match_score", -F.col("entity_a_id"))).alias("into"))
        entity = self.entity.join(best, "entity_id", "left").withColumn("resolved_by", F.coalesce("into", "resolved_by")).drop("into")
        return Merges(entity, self.alias.unionByName(missing), self._reviewed(chosen, "applied", by, at))

    def rejected(self, where: Column, at: str) -> Merges:
        """With the pending suggestions that the condition holds for rejected."""
        return replace(self, queue=self._reviewed(self.queue.where((F.col("status") == "pending") & where), "rejected", None, at))

    def certain(self, at: str, least: float = CERTAIN) -> Merges:
        """With all pending suggestions of at least ``least`` applied; unchanged when there are none."""
        where = F.col("match_score") >= least
        return self if self.queue.where((F.col("status") == "pending") & where).isEmpty() else self.applied(where, "auto_apply", at)

    def stats(self) -> DataFrame:
        """One row of counts: entities, resolved ones, and suggestions by status."""
        e = self.entity.agg(F.count(F.lit(1)).alias("total_entities"), F.count("resolved_by").alias("resolved_entities"))
        q = self.queue.agg(*[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(f"{s}_merges") for s in ("pending", "applied", "rejected")])
        one = lambda df: df.select(F.struct("*")).scalar()
        row = self.entity.sparkSession.range(1).select(one(e).alias("e"), one(q).alias("q"))
        return row.select("e.*", *[F.coalesce(f"q.{s}_merges", F.lit(0)).alias(f"{s}_merges") for s in ("pending", "applied", "rejected")])
