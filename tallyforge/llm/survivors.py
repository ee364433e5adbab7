"""One surviving record for each group of duplicates, built from consistent bundles of fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.keys import is_blank
from tallyforge.session import checkpointed


@dataclass(frozen=True)
class Bundle:
    """Fields that are only taken together, from one and the same row."""

    name: str
    fields: tuple[str, ...]


def _prepared(df: DataFrame, keys: Sequence[Column], id_col: str, bundles: Sequence[Bundle], trust: Sequence[Column], placeholders: list[str]) -> DataFrame:
    """k*, id, and for each bundle b*: its candidate struct (filled, trust..., -id), null where all fields are blank; with v*: the values as text."""
    types = dict(df.dtypes)
    out = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(id_col).cast("long").alias("id")]
    for i, b in enumerate(bundles):
        filled = [F.when(is_blank(F.col(f), types[f], placeholders), 0).otherwise(1) for f in b.fields]
        n = sum(filled[1:], filled[0])
        order = F.struct(n.alias("filled"), *[t.alias(f"t{j}") for j, t in enumerate(trust)], (-F.col(id_col).cast("long")).alias("minus_id"))
        out.append(F.when(n > 0, order).alias(f"b{i}"))
        out.append(F.when(n > 0, F.to_json(F.struct(*[F.when(x == 1, F.col(f)).alias(f) for f, x in zip(b.fields, filled)]))).alias(f"v{i}"))
    rows = df.select(*out)
    for i in range(len(keys)):
        rows = rows.where(F.col(f"k{i}").isNotNull())
    return rows


def _search(options: list[list[int]], allowed: dict[tuple[int, int], set[tuple[int, int]]], missing: list[int]) -> tuple[int, list[int | None]]:
    """Branch and bound: one option (its rank) or None per bundle with the least sum of ranks.

    options[i] are the ranks of bundle i, best first; leaving a bundle with options
    empty costs missing[i]. allowed[(i, j)] holds the rank pairs of bundles i < j that
    stand together in some row; other pairs may be chosen only with one side empty.
    The bound of a partial choice is its own cost, since later bundles cost at least 0.
    Of equal sums the one that is smaller bundle by bundle wins.
    """
    n = len(options)
    best: tuple[int, list[int | None]] = (sum(m for m, o in zip(missing, options) if o), [None] * n)
    chosen: list[int | None] = []

    def descend(cost: int) -> None:
        nonlocal best
        i = len(chosen)
        if i == n:
            if cost < best[0]:
                best = (cost, chosen.copy())
            return
        for rank in options[i]:
            if cost + rank >= best[0]:
                break
            if all(chosen[j] is None or (chosen[j], rank) in pairs for (j, k), pairs in allowed.items() if k == i):
                chosen.append(rank)
                descend(cost + rank)
                chosen.pop()
        empty = missing[i] if options[i] else 0
        if cost + empty < best[0]:
            chosen.append(None)
            descend(cost + empty)
            chosen.pop()

    descend(0)
    return best


def best_representatives(
    df: DataFrame,
    keys: Sequence[Column],
    *,
    id_col: str,
    bundles: Sequence[Bundle],
    trust: Sequence[Column],
    placeholders: list[str] = (),
    dependencies: Sequence[tuple[str, str]] = (),
    first_width: int = 16,
) -> DataFrame:
    """(group_id, bundle, from_id): for each group of two or more rows with equal keys, the row that supplies each bundle.

    group_id is the group's smallest id. A row is a candidate for a bundle when some
    field of it is not blank; candidates are ordered by filled fields, then by the
    trust columns (greater is better, null is worst), then by smaller id.
    dependencies are pairs of bundles that must agree: the chosen values of both must
    stand together in some row of the group (a functional dependency as the group
    itself shows it). The cost of a candidate is its rank among the bundle's distinct
    values; the choice minimises the summed ranks, leaving a bundle empty costing as
    many ranks as it has values.

    Method: branch and bound over whole bundles. The root of every group's search is the
    relaxation without dependencies, each bundle's best candidate; its cost of 0 bounds
    all other choices, so it is the optimum wherever it meets the dependencies, and the
    search ends there. The root is an aggregate that merges on the map side, so that a
    group may hold any share of the rows; it meets a dependency when one row supplies
    both sides or one side is blank, and only for the groups left are the chosen values
    looked up in other rows. What is open then is searched, over the ``first_width``
    best distinct values of each bundle; a result cheaper than that width is optimal,
    and the rest is searched again with the width times 16 until none is left. All
    groups of all calls take this way; where every bundle may be chosen freely, the
    bound closes them at the root.

    Defined results: rows with a null key belong to no group; repeated ids count as
    rows; a bundle that is blank in all rows, or left empty, gives no row; an empty df
    gives none; columns that are not named are ignored, whatever their names.
    """
    rows = _prepared(df, keys, id_col, bundles, trust, list(placeholders))
    ks = [f"k{i}" for i in range(len(keys))]
    root = (
        rows.groupBy(*ks)
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id"), *[F.max(f"b{i}").alias(f"b{i}") for i in range(len(bundles))])
        .where("n >= 2")
    )

    def long(df: DataFrame) -> DataFrame:
        picks = F.array(*[F.struct(F.lit(b.name).alias("bundle"), (-F.col(f"b{i}.minus_id")).alias("from_id")) for i, b in enumerate(bundles)])
        return df.select("group_id", F.explode(picks).alias("p")).where("p.from_id is not null").select("group_id", "p.bundle", "p.from_id")

    at = {b.name: i for i, b in enumerate(bundles)}
    pairs = [tuple(sorted((at[a], at[b]))) for a, b in dependencies]
    free = F.lit(True)
    for i, j in pairs:
        free = free & (F.col(f"b{i}").isNull() | F.col(f"b{j}").isNull() | (F.col(f"b{i}.minus_id") == F.col(f"b{j}.minus_id")))
    root = root.withColumn("met", free)
    result = long(root.where("met"))
    if not pairs:
        return result
    return result.unionByName(_branched(rows, checkpointed(root), ks, [b.name for b in bundles], pairs, first_width, long))


def _branched(rows: DataFrame, root: DataFrame, ks: list[str], names: list[str], pairs: list[tuple[int, int]], width: int, long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group_id, bundle, from_id) of the groups whose root does not show by itself that it meets the dependencies."""
    numbers = range(len(names))
    unmet = root.where("not met").select(*ks, "group_id", *[F.col(f"b{i}.minus_id").alias(f"m{i}") for i in numbers])
    rows = checkpointed(rows.join(unmet, ks))
    # the values the root chose, and whether other rows have them together
    values = rows.groupBy(*ks).agg(*[F.max(F.when(-F.col("id") == F.col(f"m{i}"), F.col(f"v{i}"))).alias(f"c{i}") for i in numbers])
    together = [F.max((F.col(f"v{i}") == F.col(f"c{i}")) & (F.col(f"v{j}") == F.col(f"c{j}"))).alias(f"ok{p}") for p, (i, j) in enumerate(pairs)]
    fine = F.lit(True)
    for p, (i, j) in enumerate(pairs):
        fine = fine & (F.col(f"m{i}").isNull() | F.col(f"m{j}").isNull() | F.coalesce(f"ok{p}", F.lit(False)))
    judged = checkpointed(rows.join(values, ks).groupBy(*ks, *[f"m{i}" for i in numbers]).agg(*together).select(*ks, fine.alias("fine")))
    result = long(root.join(judged.where("fine"), ks, "left_semi"))
    left = judged.where("not fine").select(*ks)
    while not left.isEmpty():
        found = checkpointed(_searched(rows.join(left, ks, "left_semi"), ks, names, pairs, width))
        result = result.unionByName(found.where("from_id is not null").join(unmet.select(*ks, "group_id"), ks).select("group_id", "bundle", "from_id"))
        left = found.where("not solved").select(*ks).distinct()
        width *= 16
    return result


def _searched(rows: DataFrame, ks: list[str], names: list[str], pairs: list[tuple[int, int]], width: int) -> DataFrame:
    """ks, bundle, from_id, solved: the searched groups; an unsolved one is a row with null bundle.

    The values of a hot group are ranked from its distinct values; rows beyond the width
    are dropped before they are shuffled (a rank limit on the map side), so that a task
    gets at most the width from each map task.
    """
    one = None
    for i in range(len(names)):
        part = rows.where(F.col(f"v{i}").isNotNull()).groupBy(*ks, F.lit(i).alias("b"), F.col(f"v{i}").alias("v")).agg(F.max(f"b{i}").alias("best"))
        one = part if one is None else one.unionByName(part)
    count = one.groupBy(*ks, "b").agg(F.count(F.lit(1)).alias("values"))
    w = Window.partitionBy(*ks, "b").orderBy(F.col("best").desc())
    top = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width).select(*ks, "b", "v", (F.col("rank") - 1).alias("rank"), (-F.col("best.minus_id")).alias("id"))
    top = checkpointed(top)
    options = top.join(count, [*ks, "b"]).select(*ks, F.lit(0).alias("what"), F.col("b").alias("x"), F.col("rank").alias("y"), F.lit(0).alias("z"), F.col("id").alias("id"), "values")
    everything = options
    for p, (i, j) in enumerate(pairs):
        together = (
            rows.where(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()).select(*ks, F.col(f"v{i}").alias("vi"), F.col(f"v{j}").alias("vj")).distinct()
            .join(top.where(F.col("b") == i).select(*ks, F.col("v").alias("vi"), F.col("rank").alias("ri")), [*ks, "vi"])
            .join(top.where(F.col("b") == j).select(*ks, F.col("v").alias("vj"), F.col("rank").alias("rj")), [*ks, "vj"])
        )
        everything = everything.unionByName(together.select(*ks, F.lit(1).alias("what"), F.lit(p).alias("x"), F.col("ri").alias("y"), F.col("rj").alias("z"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("values")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        opts = pdf[pdf["what"] == 0].sort_values(["x", "y"])
        options = [opts.loc[opts["x"] == i, "y"].tolist() for i in range(len(names))]
        missing = [int(opts.loc[opts["x"] == i, "values"].max()) if options[i] else 0 for i in range(len(names))]
        allowed: dict[tuple[int, int], set] = {p: set() for p in pairs}
        for r in pdf[pdf["what"] == 1].itertuples():
            allowed[pairs[r.x]].add((r.y, r.z))
        cost, choice = _search(options, allowed, missing)
        key = {k: pdf[k].iloc[0] for k in ks}
        whole = all(m <= width for m in missing)
        if not whole and cost >= width:  # an option beyond the width could cost as much and come first
            return pd.DataFrame([key | {"bundle": None, "from_id": None, "solved": False}])
        ids = opts.set_index(["x", "y"])["id"]
        return pd.DataFrame([key | {"bundle": names[i], "from_id": None if c is None else int(ids[(i, c)]), "solved": True} for i, c in enumerate(choice)])

    types = dict(everything.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in ks) + ", bundle string, from_id long, solved boolean"
    return everything.groupBy(*ks).applyInPandas(solve, schema)
