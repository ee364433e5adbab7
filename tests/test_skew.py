import math
import random

import pytest

from tallyforge.operators import skew
from tallyforge.operators.skew import exact_quantiles, heavy_keys, salted_join


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 60 + [("b", None)] * 30 + [(None, 2)] * 7 + [("c", 0)] * 3, "k string, c long")
    got = {(r["k"], r["n"], r["total"]) for r in heavy_keys(df, "k", 0.03).collect()}
    assert got == {("a", 60, 100), ("b", 30, 100), ("c", 3, 100)}
    assert heavy_keys(df.limit(0), "k", 0.03).count() == 0


@pytest.mark.parametrize("hashes", [1, 7, 1 << 24])
def test_heavy_keys_among_many_light_ones(spark, hashes, monkeypatch):
    monkeypatch.setattr(skew, "HASHES", hashes)
    r = random.Random(hashes)
    keys = [f"k{r.randrange(400)}" for _ in range(900)] + ["hot"] * 300 + ["warm"] * 36 + ["cool"] * 35 + [None] * 29
    total = len(keys)
    assert total == 1300 and math.ceil(0.0276 * total) == 36
    got = {x["k"]: x["n"] for x in heavy_keys(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 0.0276, bins=16).collect()}
    assert got == {k: n for k in {*keys} - {None} if (n := keys.count(k)) >= 0.0276 * total} and {"hot", "warm"} <= set(got) and "cool" not in got


@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_against_sorting(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    r = random.Random(1)
    rows = [(r.choice("aaaaab"), r.choice([0, 1, -1, 7, 10**6, -(10**9), r.randrange(-50, 50), r.randrange(2**40)])) for _ in range(400)]
    rows += [("c", 5)] * 9 + [("d", None), (None, 4), ("e", -3)]
    qs = [0, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "k string, v long, n int, bin string")
    got = {(x["k"], x["quantile"]): (x["n"], x["v"]) for x in exact_quantiles(df, "k", "v", qs, bins=16).collect()}
    want = {}
    for k in "abce":
        vs = sorted(v for q, v in rows if q == k and v is not None)
        for q in qs:
            want[k, q] = (len(vs), vs[max(1, math.ceil(q * len(vs))) - 1])
    assert got == want


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v long"), "k", "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([], "k string, v long"), "k", "v", [2])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    l = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2), ("alone", 3)], "k string, x int")
    r = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), (None, 4)], "k string, y int")
    cond = l["k"] == r["k"]
    want = l.join(r, cond, how)
    want = want.select(l["k"], "x", *(["y"] if how in ("inner", "left") else []))
    got = salted_join(l, r, ["k"], how, least=5).select(*want.columns)
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
