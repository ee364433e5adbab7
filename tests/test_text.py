import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import similar
from tallyforge.operators.components import connected_components, merged_names
from tallyforge.operators.similar import name_classes, scored_matches, similar_pairs
from tallyforge.plans import tools as T


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_name(spark):
    assert col(spark, ["Brandt, Odile van", "  ", None, "O'Neil-Bo"], X.canonical_name) == ["BRANDT ODILE VAN", "", "", "BO NEIL O"]


def test_trigram_similarity(spark):
    got = col(spark, ["word", "two words", None, "!!"], lambda c: X.trigram_similarity(c, F.lit("two words")))
    assert got == pytest.approx([4 / 11, 1.0, 0.0, 0.0])


def test_word_starts_and_words(spark):
    names = ["AL MEDIA LLC", "CENTRAL MEDIA", "al media", "AL+MEDIA", None]
    assert col(spark, names, lambda c: X.starts_word(c, "AL Media")) == [True, False, True, False, None]
    assert col(spark, ["a.b", "axb"], lambda c: X.starts_word(c, "a.b")) == [True, False]
    assert col(spark, ["Ortun Quell, Amara", "QUELL AMARAX"], lambda c: X.has_all_words(c, "amara quell")) == [True, False]


@pytest.mark.parametrize("text", ["Mirko Varn", "Varn, Mirko", "Varn, Mirko G", "Mirko G. Varn"])
def test_person_in_any_order(spark, text):
    rows = [("Varn", "Mirko Ortun"), ("Varn, Mirko", None), ("Mirko", "Varn"), ("", "Varn Mirko"), (None, "Mirko J. Varn"), ("Mirko Ortun Varn", ""), ("VARN", "mirko")]
    others = [("Ovarns", "Mirko"), (None, "Varn"), ("Varn", "Ann"), ("Mirko", None), (None, None), ("Varnish", ""), ("Mirkovarn", "")]
    df = spark.createDataFrame(rows + others, "l string, f string")
    assert [r["y"] for r in df.select(X.person_predicate(F.col("l"), F.col("f"), text).alias("y")).collect()] == [True] * len(rows) + [False] * len(others)


def test_person_by_one_name(spark):
    df = spark.createDataFrame([("Varn", "A"), ("A", "Varn"), ("Varnon", None), ("Ovarn", "A"), (None, None)], "l string, f string")
    assert [r["y"] for r in df.select(X.person_predicate(F.col("l"), F.col("f"), "Varn").alias("y")).collect()] == [True, True, True, False, False]
    assert X.name_tokens("O'Brien, 3M. St-Jude '") == ["O'BRIEN", "3M", "ST", "JUDE"] and X.name_parts("") == ("", "")


def test_candidate_tokens_and_display(spark):
    assert col(spark, ["Amara Quell for Senate 2024", None], X.candidate_tokens) == [["AMARA", "QUELL"], []]
    assert col(spark, ["Doe", " "], lambda c: X.display_name(c, F.lit("Jo"), F.lit(None).cast("string"))) == ["Doe, Jo", "Jo"]
    assert col(spark, ["RETURN OF CONTRIB", "refund", None], X.is_refund_memo) == [True, False, None]


def test_components(spark):
    n = spark.createDataFrame([(i,) for i in range(40)], "node long")
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(35, 33), (35, 33), (5, 5), (99, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(n, e).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[35] == got[33] == 33 and got[34] == 34 and len(got) == 40


def test_components_of_long_chains(spark):
    way = [2, *range(10, 90), 1]  # the smallest node is the last of a chain that starts low
    r = random.Random(3)
    edges = list(zip(way, way[1:])) + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)]
    want = {x: x for x in {*way, *range(1000, 1400)}}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        want[y] = x
    got = connected_components(spark.createDataFrame([(x,) for x in want], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["component"] for x in got.collect()} == {x: root(x) for x in want}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 2)], "a long, b long"), rounds=0)


def test_merged_names(spark):
    df = spark.createDataFrame([(x,) for x in ["Amara Quell", "Quell Amara", "Amara Ortun Quell", "Amara Quell for Senate 2024", "Quell", "John Smith", "Jane Smith", None, " "]], "n string")
    got = {r["n"]: r["group"] for r in merged_names(df, "n").collect()}
    assert len({got[x] for x in ("Amara Quell", "Quell Amara", "Amara Ortun Quell", "Amara Quell for Senate 2024")}) == 1
    assert len({got[x] for x in ("Quell", "John Smith", "Jane Smith", "Amara Quell")}) == 4


def test_similar_pairs_are_all_found(spark):
    names = ["Acme Corp", "ACME CORPS", "acme corp ", "Acme Corporation", "Smith John", "Smyth John", None, "", "Completely Different"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, n string")
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    one = {}
    for i, n in enumerate(names):
        if n:
            one.setdefault(n.lower().strip(), i)
    want = {(i, j) for a, i in one.items() for b, j in one.items() if i < j and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    assert {(r["a"], r["b"]) for r in similar_pairs(df, "id", "n", 0.5).collect()} == want
    assert similar_pairs(df.limit(0), "id", "n", 0.5).count() == 0
    assert {(r["id"], r["rep"]) for r in name_classes(df, "id", "n").collect() if r["id"] != r["rep"]} == {(2, 0)}


def test_letter_counts_differ_by_at_most_two_an_edit(spark):
    r = random.Random(8)
    rows = [("", "é"), ("a" * 9, "a"), ("a" * 12, "a" * 9), ("kj", "jk")]
    for _ in range(400):
        a = b = "".join(r.choice("aeeq 01'éж\U0001f600t") for _ in range(r.randrange(30)))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(b) + 1)
            b = b[:i] + r.choice(["", "a", "e", "é", "0"]) + b[i + r.randrange(2) :]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    apart = sum(F.bit_count(similar.letter_counts("a", h).bitwiseXOR(similar.letter_counts("b", h))) for h in (0, 1))
    got = df.select("a", "b", apart.alias("d"), F.levenshtein("a", "b").alias("edits")).collect()
    assert all(x["d"] <= 2 * x["edits"] - abs(len(x["a"]) - len(x["b"])) for x in got)
    assert [x["d"] for x in got[:4]] == [1, 0, 3, 0]  # eight more of a letter look like none


@pytest.mark.parametrize(("threshold", "edits"), [(0.7, 3), (0.45, 2), (0.3, None), (0.0, 6)])
def test_similar_pairs_against_all_pairs(spark, threshold, edits, monkeypatch):
    r = random.Random(5)
    names = ["".join(r.choice("ab éx1 -") for _ in range(r.randrange(1, 24))) for _ in range(40)] + [f"{w} for school board 20{y}" for w in ("lanton", "lantin", "boardle") for y in (18, 20)] + ["x" * 60, "x" * 57]
    for n in names[:40]:
        for _ in range(2):
            i, c = r.randrange(len(n)), r.choice(["", "a", " ", "é", "b a"])
            names.append(n[:i] + c + n[i + r.randrange(2) :])
    names = sorted({n.strip(" ") for n in names} - {""})
    words = lambda s: "".join(c if c.isalnum() else " " for c in s).split()
    grams = {n: {f"  {w} "[i : i + 3] for w in words(n) for i in range(len(w) + 1)} for n in names}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            if (shared := len(grams[a] & grams[b])) and shared / len(grams[a] | grams[b]) >= threshold - 1e-9 and (edits is None or distance(a, b) <= edits):
                want.add((j, i))
    kinds, join = [], similar.salted_join
    monkeypatch.setattr(similar, "salted_join", lambda l, *a, **k: kinds.append(l.schema["k" if "k" in l.columns else "g"].dataType.typeName()) or join(l, *a, **k))
    got = [(x["a"], x["b"]) for x in similar.similar_pairs(spark.createDataFrame(list(enumerate(names)), "id int, n string"), "id", "n", threshold, edits).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert set(kinds) == {"long"}  # a broadcast by texts takes 64 MB of the driver however few they are


def test_scored_matches(spark):
    df = spark.createDataFrame([(1, "Smithson", "Al", None, "X"), (2, "Smithsen", "AL", None, "x"), (3, "Smithson", "Bo", "", "Y"), (4, "SMITHSON", "al", None, "x"), (5, "smithson", "AL", None, "Z"), (None, "Smithson", "Al", None, "X"), (6, None, "Al", None, "X")], "id int, l string, f string, s string, t string")
    got = {(r["a"], r["b"]): r["score"] for r in scored_matches(df, "id", "l", "f", "s", "t", 0.6, 2).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 5)} and got[1, 5] == 1.0 and got[1, 2] >= 0.8 and got[2, 5] < got[1, 2]


def test_race_overview(spark):
    rows = [("Pellam Ives", 56993.92, 1), ("Amara Quell", 39171.03, 2), ("Quell Amara", 4612.0, 3), ("Amara Ortun Quell", 165.87, 2), ("Amara Quell for Senate 2024", 157.18, 4)]
    lines = spark.createDataFrame([(n, "S", a, f) for n, a, f in rows], "candidate string, side string, amount double, filer_id int")
    names = spark.createDataFrame([(1, 1, None, "HARBOUR PAC", None), (2, 2, None, "GLADE", None), (3, 2, None, "GLADE NEW", None)], "id int, filer_id int, effect_dt timestamp_ntz, naml string, namf string")
    got = {(r["candidate"], r["spender"]): (r["side_total"], r["side_lines"], r["spender_total"]) for r in T.race_overview(lines, names, 1).collect()}
    assert got == {("Pellam Ives", "HARBOUR PAC"): (56993.92, 1, 56993.92), ("Quell Amara", "GLADE NEW"): (44106.08, 4, 39336.9)}


def test_phase():
    with pytest.raises(ValueError):
        T.phase("nonsense")
