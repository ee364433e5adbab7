import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.names import GIVEN, distance
from tallyforge.llm.variants import form_pairs, placed_forms, placeless_pairs, respelt, shared_keys, variant_clusters, variant_pairs, vocabulary

NAMES = {"last": "naml", "first": "namf", "kind": "kind", "town": "city", "state": "st", "code": "zip4"}
SCHEMA = "entity_id int, naml string, namf string, kind string, city string, st string, zip4 string, pid int, form string"


def clustered(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r["id"]: r["cid"] for r in variant_clusters(df, row_id="entity_id", **NAMES).collect()}


ROWS = [
    (1, "SMITHERSON", "WILLIAM", "IND", "North Town", "CA", "90001"), (2, "Smitherson", "Bill", "IND", "N. TOWN", None, None), (3, "SMITHRESON", "W.", None, "North Town", "CA", "90001-1234"),
    (4, "SMITHERSON", "PATRICIA", "IND", "North Town", "CA", "90007"), (5, "SMITHERSON", "WILLIAM", "IND", "Elsewhere", "NY", "10001"), (6, "WILLIAM", "SMITHERSON", "IND", "North Town", "CA", "90010"),
    (7, "SMITHERSON FOR MAYOR 2020", None, "COM", "North Town", "CA", "90001"), (8, "FRIENDS OF BILL SMITHERSON FOR MAYOR '20", None, "COM", "North Town", "CA", "90001"), (9, "SMITHERSON FOR MAYOR 2024", None, "COM", "North Town", "CA", "90001"),
    (10, "VANDERBLOK NURSES UNION LOCAL 12", None, "OTH", "South Town", "TX", "70001"), (11, "VANDERBLOK NURSES UNION LOCAL 21", None, "OTH", "South Town", "TX", "70001"), (12, "Vanderblok Nurses Union, # 12", None, "OTH", None, "TX", None),
    (13, "SMITHERSON", "WILLIAM", "IND", None, None, None), (14, None, "X", None, None, None, None), (None, "SMITHERSON", "WILLIAM", "IND", "North Town", "CA", "90001"), (15, "", "", "", "", "", ""), (16, "QUIXOTTER", "OSCAR", "IND", None, None, None), (17, "QUIXOTTER", "OSCAR", None, "South Town", "TX", "70009"),
]


@pytest.fixture(scope="module")
def got(spark):
    return clustered(spark, ROWS)


def test_same_entity(got):
    assert got[1] == got[2] == got[3] == got[6] == 1
    assert got[7] == got[8] == 7
    assert got[10] == got[12] == 10
    assert got[16] == got[17] == 16


def test_different_entities(got):
    assert len({got[i] for i in (1, 4, 5, 7, 9, 10, 11, 15, 16)}) == 9
    assert got[13] == 13  # two namesakes in two towns: cannot be told
    assert 14 not in got and None not in got


def test_repeated_rows_and_empty_tables(spark):
    many = [(i, "SMITHERSON", "WILLIAM", "IND", "North Town", "CA", "90001") for i in range(1, 60)]
    got = clustered(spark, many)
    assert set(got.values()) == {1} and len(got) == 59
    assert clustered(spark, []) == {}


def test_pairs(spark):
    c = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(100 + i, 50) for i in range(1200)], "id long, cid long")
    pairs = variant_pairs(c)
    assert pairs.count() == pairs.distinct().count() == 3 * 3 + 1200 * 1199 // 2
    assert pairs.where("id_a >= id_b").isEmpty()


SIDES = "pid long, kind string, heads array<string>, given string, formal array<string>, initials string, office string, year string, words array<string>, numbers string, town string, state string, zip string, members long"


def persons(spark, rows):
    return spark.createDataFrame([(i, "P", ["SMITH"], g, [g], "", "", "", [], "", town, state, code, n) for i, g, town, state, code, n in rows], SIDES)


def test_the_rarest_shared_form_decides(spark):
    p = persons(spark, [(1, "WILLIAM", "X", "CA", "90001", 9), (2, "WILLIAM", "", "CA", "", 1), (3, "WILLIAM", "Y", "NY", "10001", 9), (4, "WALTER", "Y", "CA", "95001", 1), (5, "WALTER", "", "", "", 1), (6, "WALTER", "Z", "CA", "91001", 2), (7, "ZENO", "", "", "", 1), (8, "ZENO", "", "TX", "", 1)])
    got = {(r["a"], r["b"]): r["score"] for r in placeless_pairs(p, shared_keys(p)).collect()}
    assert set(got) == {(1, 2), (7, 8)}  # W. is in many places, WILLIAM in one of the state; WALTER is in two
    assert got[1, 2] == 1.0 and got[7, 8] == 1.0
    more = persons(spark, [(1, "WILLIAM", "X", "CA", "90001", 9), (2, "WILLIAM", "", "", "", 1), (3, "WILLIAM", "Y", "NY", "10001", 1)])
    assert [(r["a"], r["b"], r["score"]) for r in placeless_pairs(more, shared_keys(more)).collect()] == [(1, 2, 0.9)]


def name_of(i):
    return "".join("BA KO MI RU TE DO LA FI SU NE".split()[int(c)] for c in f"{i:05d}")


def test_frequent_names_are_refined(spark):
    given = sorted(GIVEN)[:100]
    p = persons(spark, [(i, given[i % 100], f"{name_of(7919 * (i // 100))} CITY", "CA", f"{10000 + 1000 * (i // 100)}", 1) for i in range(3000)])
    pairs = form_pairs(placed_forms(p, shared_keys(p))).count()
    assert 0 < pairs < 30_000 and placeless_pairs(p, shared_keys(p)).isEmpty()  # of 4.5 million with the name
    lost = persons(spark, [(9000 + i, given[i], "", "CA", "", 1) for i in range(100)])
    assert placeless_pairs(p.unionByName(lost), shared_keys(p)).isEmpty()  # each name is known in 30 places


def test_result_is_the_same_inside_a_larger_table(spark, got):
    name = name_of
    others = [(1000 + i, f"{name(i)} {'NURSES UNION' if i % 2 else 'COAST PILOTS GUILD'} LOCAL {i}", None, "OTH", f"{name(99999 - i)} CITY", "CA", f"{20000 + i}") for i in range(1500)]
    others += [(5000 + i, "SMITHERSON", f"{name(i)[:4]}", "IND", f"{name(50000 + i)} CITY", "CA", f"{30000 + 7 * i}") for i in range(500)]
    large = clustered(spark, [r for r in ROWS if r[0] is not None] + others)
    assert {i: c for i, c in large.items() if i < 100} == got


def test_vocabulary(spark):
    rows = [("SMITH", "JOHN", f"{i:05d}") for i in range(10000, 90000, 2000)] + [("SMITH CONSLTG", None, f"{i:05d}") for i in range(10000, 30000, 2000)] + [("BLUEGRASS PICKERS", None, f"{i:05d}") for i in range(10000, 30000, 2000)]
    rows += [("QUICK CONSULTING", None, f"{i:05d}") for i in range(10000, 40000, 2000)]
    rows += [("KEVIN JONES", None, "10001"), ("JONES", "KEVIN", "11001")] + [("X", "KEVIN", f"{i:05d}") for i in range(10000, 30000, 2000)] + [("ODDLY", None, "10001")] * 9 + [(None, None, None)]
    v = vocabulary(spark.createDataFrame(rows, "l string, f string, z string"), "l", "f", "l", "z")
    assert {"BLUEGRASS", "PICKERS"} <= v.common and not {"SMITH", "JOHN", "ODDLY"} & v.common and v.given == {"KEVIN"} and v.alias["CONSLTG"] == "CONSULTING"
    empty = vocabulary(spark.createDataFrame([], "l string, f string, z string"), "l", "f", "l", "z")
    assert "UNION" in empty.common and not empty.given


def test_all_tolerated_respellings_meet(spark):
    places = [("North Town", "CA", "90001"), ("Norht Town", "CA", "90040")]
    names = [("GIPPIMIBBON", "GIPIMIBON"), ("WEROMILEZ", "VEROMILES"), ("KARTOLD", "KARXOLD"), ("BELVANTIR", "EBLVANTRI")]
    rows = [(10 * i + j, n, "ANTHONY", "IND", *places[j]) for i, pair in enumerate(names, 1) for j, n in enumerate(pair)]
    rows += [(91, "SMITHERSON", "QUILL", "IND", *places[0]), (92, "SMITHERSON", "UQILL", "IND", *places[1]), (93, "VORBEKK", "ANTHONY", "IND", None, "CA", "90021"), (94, "VORBEK", "ANTHONY", "IND", "North Town", "CA", "90001")]
    got = clustered(spark, rows + [(95, "VORBEQQ", "BILL", "IND", "North Town", "CA", "90001")])
    assert all(got[10 * i] == got[10 * i + 1] == 10 * i for i in range(1, 5))
    assert got[91] == got[92] and got[93] == got[94] and got[95] == 95


def test_respelt_words_share_keys(spark):
    r = random.Random(5)
    words = ["".join(r.choice("ABC") for _ in range(r.randrange(1, 9))) for _ in range(150)]
    tolerated = lambda x: 2 if len(x) >= 6 else 1 if len(x) >= 4 else 0
    same = lambda x, y: distance(x, y, 2) <= min(tolerated(x), tolerated(y))
    words = sorted(set(words))
    long = F.length("word")
    keys = {}
    for row in respelt(spark.createDataFrame([(w, 1 + len(w) % 3) for w in words], "word string, n long"), F.when(long >= 6, 2).when(long >= 4, 1).otherwise(0), same).collect():
        keys.setdefault(row["word"], set()).add(row["key"])
    assert all(keys[x] & keys[y] for x in words for y in words if same(x, y))
    assert all(x == k or same(x, k) for x in words for k in keys[x])
