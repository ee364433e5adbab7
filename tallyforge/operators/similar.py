"""Pairs of similar names by letter triples, without comparing all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import trigrams
from tallyforge.operators.skew import salted_join
from tallyforge.session import checkpointed


def name_classes(df: DataFrame, row_id: str, name: str) -> DataFrame:
    """(id, rep): rows with equal names, whatever their case and outer spaces, and the smallest id among them.

    Null names and ids are left out.
    """
    rows = df.select(F.col(row_id).alias("id"), F.lower(F.trim(F.col(name))).alias("name")).where("id is not null and name is not null")
    reps = rows.groupBy("name").agg(F.min("id").alias("rep"))
    return rows.join(reps, "name").select("id", "rep")


#: Sizes of triple sets that are joined at once; smaller classes mean fewer pairs and more copies of the postings.
SIZES = 4
#: An edit takes at most so many triples from a name's set, and adds at most so many.
TRIPLES_AN_EDIT = 3


def letter_counts(name: str, half: int) -> Column:
    """How often the letters of a half of all occur in name, modulo 8, as 16 Johnson counters of 4 bits.

    Letters are counted by their code points modulo 32: half 0 has those below 16. One
    more of a letter flips one bit, so that the bits in which two names differ are at
    most the letters that one has and the other has not.
    """
    at = "4 * (c % 16)"
    now = f"(shiftrightunsigned(k, {at}) & 15)"
    codes = f"filter(transform(filter(split({name}, ''), x -> x <> ''), x -> ascii(x) % 32), c -> c div 16 = {half})"
    return F.expr(f"aggregate({codes}, 0L, (k, c) -> k ^ shiftleft({now} ^ ((shiftleft({now}, 1) | (1 - shiftright({now}, 3))) & 15), {at}))")


def similar_names(names: DataFrame, label: str, threshold: float, edits: int | None = None, own: str | None = None) -> DataFrame:
    """(a, b, similarity): the labels of pairs of names (name, label) whose letter triples agree by at least threshold, within edits.

    The names are distinct. Each pair comes once, the smaller set first. Where a Boolean column own is named, only
    pairs with such a name in them are searched. Triples are ordered by rarity. Two sets
    of sizes x <= y with a similarity of t share at least t / (1 + t) * (x + y) triples
    (and y less what the edits can take), so that the rarest triples of both, as many as
    may be missing and one, have one in common: only these are joined, within classes of
    the larger size and with frequent ones in slices. In the join, sizes, positions,
    lengths and 128-bit signatures of the sets rule pairs out, and counts of letters
    those with more than twice the edits between them, less what the lengths differ
    by; then every pair is verified exactly. Triples are numbers made of their letters' code points: joins on
    numbers need little of the driver's memory when they are broadcast. Wordless names
    have no pairs.
    """
    flag = F.lit(True) if own is None else F.col(own)
    n = names.select(F.monotonically_increasing_id().alias("id"), "name", F.col(label).alias("label"), flag.alias("own"), trigrams(F.col("name")).alias("t")).where(F.size("t") > 0)
    n = checkpointed(n)  # the ids stay as they are
    letter = lambda i: F.ascii(F.substring("g", i, 1)).cast("long")
    grams = n.select("id", F.explode("t").alias("g")).select("id", (F.shiftleft(letter(1), 42) + F.shiftleft(letter(2), 21) + letter(3)).alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("g"), F.lit(128)).cast("int")
    bits = lambda low: F.bit_or(F.when((place < 64) if low else (place >= 64), F.expr("shiftleft(1L, cast(pmod(xxhash64(g), 64) as int))")).otherwise(F.lit(0).cast("long")))
    sets = grams.join(rarity, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s"), bits(True).alias("u"), bits(False).alias("v"))
    marks = ["u", "v"] if edits is None else ["u", "v", "c", "d"]
    counts = [] if edits is None else [letter_counts("name", 0).alias("c"), letter_counts("name", 1).alias("d")]
    sets = checkpointed(sets.join(n.drop("t"), "id").select("id", "name", "label", "own", F.length("name").alias("len"), F.col("s.g").alias("s"), F.size("s").alias("z"), "u", "v", *counts))

    def shared(x: Column, y: Column) -> Column:
        least = F.ceil(F.lit(max(threshold, 0) / (1 + max(threshold, 0))) * (x + y) - 1e-4).cast("int")
        return F.greatest(F.lit(1), least, *([] if edits is None else [y - TRIPLES_AN_EDIT * edits]))

    z, width = F.col("z"), SIZES if threshold >= 0.2 or edits is not None else 1 << 20
    most = F.floor(z / threshold + 1e-4).cast("int") if threshold > 0 else F.lit((1 << 20) - 1)
    least = F.ceil(z * max(threshold, 0) - 1e-4).cast("int")
    if edits is not None:
        most, least = F.least(most, z + TRIPLES_AN_EDIT * edits), F.greatest(least, z - TRIPLES_AN_EDIT * edits)
    class_of = lambda c: F.floor(c / width).cast("int")
    least = F.greatest(F.lit(1), least)

    def postings(df: DataFrame, x: str, sizes: Column, k: Column) -> DataFrame:
        each = df.withColumn("class", F.explode(sizes)).select("id", "len", "z", *marks, "class", F.posexplode(F.slice("s", 1, k)).alias("p", "g"))
        return each.select(F.xxhash64("g", "class").alias("k"), *[F.col(c).alias(f"{c}{x}") for c in ("id", "len", "z", *marks, "p")])

    smaller = lambda df: postings(df, "a", F.sequence(class_of(z), class_of(most)), F.greatest(F.lit(0), z - shared(z, F.greatest(z, F.col("class") * width)) + 1))
    larger = lambda df: postings(df, "b", F.array(class_of(z)), F.greatest(F.lit(0), z - shared(least, z) + 1))
    za, zb, pa, pb = (F.col(c) for c in ("za", "zb", "pa", "pb"))
    need = shared(za, zb)
    fits = ((za < zb) | (za == zb) & (F.col("ida") < F.col("idb"))) & (F.least(pa, pb) + F.least(za - pa, zb - pb) >= need)
    differing = lambda x, y: sum(F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in (x, y))
    fits &= differing("u", "v") <= za + zb - 2 * need
    if edits is not None:
        apart = F.abs(F.col("lena") - F.col("lenb"))
        fits &= (apart <= edits) & (differing("c", "d") <= 2 * edits - apart)
    both = [(sets, sets)] if own is None else [(sets.where("own"), sets), (sets.where("not own"), sets.where("own"))]
    found = [salted_join(smaller(x), larger(y), ["k"], "inner", lambda a, b: fits).select("ida", "idb") for x, y in both]
    candidates = reduce(DataFrame.unionByName, found).distinct()
    for x in "ab":
        candidates = candidates.join(sets.select(F.col("id").alias(f"id{x}"), F.col("name").alias(f"n{x}"), F.col("label").alias(x), F.col("s").alias(f"s{x}")), f"id{x}")
    if edits is not None:
        candidates = candidates.where(F.levenshtein("na", "nb", edits) >= 0)
    common = F.size(F.array_intersect("sa", "sb"))
    score = (common / (F.size("sa") + F.size("sb") - common)).cast("float")
    return candidates.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= F.lit(threshold).cast("float"))


def similar_pairs(df: DataFrame, row_id: str, name: str, threshold: float, edits: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: different names whose letter triples agree by at least threshold, and whose edit distance is at most edits.

    The ids are those of name_classes: one pair stands for all rows with the two
    names, and rows with equal names are no pairs but one class, so that copies never
    multiply. See similar_names for the search. Null and wordless names have no pairs.
    """
    rows = df.select(F.col(row_id).alias("id"), F.lower(F.trim(F.col(name))).alias("name")).where("id is not null and name is not null")
    pairs = similar_names(rows.groupBy("name").agg(F.min("id").alias("rep")), "rep", threshold, edits)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def scored_matches(df: DataFrame, row_id: str, last: str, first: str, suffix: str, town: str, threshold: float, edits: int) -> DataFrame:
    """(a, b, score), a < b: records with similar family names, with bonuses of 0.2 for an equal given name, 0.1 for suffix and 0.1 for town, 1 at most.

    Equal records are one, with the smallest id. Pairs are searched from threshold -
    0.1 on, and kept when the score reaches threshold; records with one family name
    are paired only when the given name agrees as well.
    """
    part = lambda c: F.upper(F.coalesce(F.trim(F.col(c)), F.lit("")))
    rows = df.where(F.col(row_id).isNotNull() & F.col(last).isNotNull()).select(F.col(row_id).alias("id"), F.lower(F.trim(F.col(last))).alias("l"), part(first).alias("f"), part(suffix).alias("s"), part(town).alias("t"))
    records = rows.groupBy("l", "f", "s", "t").agg(F.min("id").alias("id"))
    names = records.groupBy("l").agg(F.min("id").alias("rep"))
    close = similar_pairs(records, "id", "l", threshold - 0.1, edits)
    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    side = lambda x: records.join(names, "l").select(F.col("rep").alias(f"rep{x}"), F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in "fst"])
    across = both.select(F.col("a").alias("repa"), F.col("b").alias("repb"), F.col("similarity").cast("double").alias("similarity")).join(side("a"), "repa").join(side("b"), "repb").where("a < b")
    same = side("a").join(side("b"), (F.col("repa") == F.col("repb")) & (F.col("fa") == F.col("fb")) & (F.col("fa") != "")).where("a < b").withColumn("similarity", F.lit(1.0))
    cols = ["a", "b", "similarity", *[f"{c}{x}" for c in "fst" for x in "ab"]]
    wide = across.select(*cols).unionByName(same.select(*cols))
    bonus = sum((F.when((F.col(f"{c}a") == F.col(f"{c}b")) & (F.col(f"{c}a") != ""), v).otherwise(0.0) for c, v in (("f", 0.2), ("s", 0.1), ("t", 0.1))), F.lit(0.0))
    return wide.select("a", "b", F.least(F.lit(1.0), F.round(F.col("similarity") + bonus, 4)).alias("score")).where(F.col("score") >= threshold)
