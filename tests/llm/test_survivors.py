import itertools
import random

from pyspark.sql import functions as F

from tallyforge.llm.survivors import Bundle, _search, best_representatives

SCHEMA = "id long, k string, t string, name string, city string, st string, trust int, bundle string, from_id int"


def run(spark, rows, bundles, dependencies=(), width=16):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    out = best_representatives(df, [F.col("k"), F.col("t")], id_col="id", bundles=bundles, trust=[F.col("trust")], placeholders=["TBD"], dependencies=dependencies, first_width=width)
    return {(r["group_id"], r["bundle"]): r["from_id"] for r in out.collect()}


def test_fields_one_by_one(spark):
    rows = [(1, "a", "t", "X", None, "CA", 1), (2, "a", "t", " tbd", "Y", None, 2), (3, "a", "t", "Z", "-", "", None), (4, "a", "u", "X", "Y", "Z", 1), (5, None, "t", "X", "Y", "Z", 1), (6, None, "t", "X", "Y", "Z", 1), (7, "b", "b", None, "", "..", 1), (8, "b", "b", None, None, None, 2), (9, "c", "c", "P", None, None, 5), (10, "c", "c", "Q", None, None, 5)]
    bundles = [Bundle(f, (f,)) for f in ("name", "city", "st")]
    assert run(spark, rows, bundles) == {(1, "name"): 1, (1, "city"): 2, (1, "st"): 1, (9, "name"): 9}
    assert run(spark, [], bundles) == {}


def test_whole_bundles_and_dependencies(spark):
    bundles = [Bundle("name", ("name",)), Bundle("place", ("city", "st"))]
    rows = [(1, "a", "t", "A", "P", "CA", 9), (2, "a", "t", "B", None, None, 10), (3, "a", "t", None, "Q", "NY", 11), (4, "a", "t", "B", "R", "UT", 1), (5, "a", "t", "A", "Q", None, 0)]
    assert run(spark, rows, bundles) == {(1, "name"): 2, (1, "place"): 3}
    assert run(spark, rows, bundles, [("name", "place")]) == {(1, "name"): 2, (1, "place"): 4}
    assert run(spark, rows, bundles, [("name", "place")], width=1) == {(1, "name"): 2, (1, "place"): 4}


def test_every_width_gives_the_same(spark):
    r = random.Random(11)
    rows = [(i, f"g{r.randrange(12)}", "t", r.choice(["A", "B", "C", "D", None]), r.choice(["P", "Q", "R", None]), r.choice(["CA", None]), r.choice([1, 2, 3, None])) for i in range(90)]
    bundles = [Bundle("name", ("name",)), Bundle("place", ("city", "st"))]
    got = [run(spark, rows, bundles, [("name", "place")], width=w) for w in (1, 2, 3, 64)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) > 20


def test_search_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        options = [list(range(r.randrange(4))) for _ in range(3)]
        allowed = {(i, j): {p for p in itertools.product(options[i], options[j]) if r.random() < 0.4} for i, j in [(0, 1), (1, 2)]}
        missing = [len(o) for o in options]
        cost, choice = _search(options, allowed, missing)
        best = min(
            sum(missing[i] if c is None and options[i] else c or 0 for i, c in enumerate(pick))
            for pick in itertools.product(*[[*o, None] for o in options])
            if all(pick[i] is None or pick[j] is None or (pick[i], pick[j]) in p for (i, j), p in allowed.items())
        )
        assert cost == best


def test_random_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.choice("xy"), r.choice(["N", "M", None, "TBD"]), r.choice(["c", "d", None]), r.choice(["e", None]), r.choice([1, 2, None])) for i in range(80)]
    rows += [(100, "hot", "hot", "n%d" % 1, None, None, 1)] * 50
    want = {}
    for key in {(k, t) for _, k, t, *_ in rows}:
        group = [x for x in rows if (x[1], x[2]) == key]
        if len(group) > 1:
            for f, i in (("name", 3), ("city", 4)):
                ok = [x for x in group if x[i] not in (None, "TBD")]
                if ok:
                    want[min(x[0] for x in group), f] = min(ok, key=lambda x: (x[6] is None, -(x[6] or 0), x[0]))[0]
    assert run(spark, rows, [Bundle("name", ("name",)), Bundle("city", ("city",))]) == want
