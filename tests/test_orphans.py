import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.keys import key_form
from tallyforge.operators import orphans
from tallyforge.operators.orphans import BLOCK, key_runs, orphan_references


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def found(spark, refs, parents, kind="int"):
    r = spark.createDataFrame([(i, k, day(t), "x", 1) for i, (k, t) in enumerate(refs)], f"row_id long, ref {kind}, at timestamp_ntz, num string, block int")
    p = spark.createDataFrame([(k, day(a), day(b), "y") for k, a, b in parents], f"k {kind}, since timestamp_ntz, until timestamp_ntz, runs string")
    out = orphan_references(r, p, ref_key="ref", ref_time="at", keep=["row_id", "num"], parent_key="k", since="since", until="until")
    assert out.columns == ["row_id", "num", "orphan_kind"]
    return {x["row_id"]: x["orphan_kind"] for x in out.collect()}


def brute(refs, parents):
    out = {}
    for i, (k, t) in enumerate(refs):
        if k is None:
            continue
        own = [(a, b) for q, a, b in parents if q == k]
        if not own:
            out[i] = "missing"
        elif all(b is not None for _, b in own):
            out[i] = "deleted"
        elif t is not None and not any(a is not None and a <= t and (b is None or b > t) for a, b in own):
            out[i] = "late"
    return out


def test_kinds_ties_and_repeats(spark):
    parents = [(1, 0, None), (2, 0, 5), (3, 9, None), (3, 0, 4), (3, 0, 4), (BLOCK, 0, None), (BLOCK + 1, 0, None), (-7, 0, None)]
    refs = [(1, 3), (2, 3), (3, 3), (3, 4), (3, 9), (4, 3), (BLOCK, 1), (BLOCK + 1, 0), (BLOCK + 2, 0), (-7, 1), (-8, 1), (None, 1), (1, None), (9, None), (4, 3)]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 0, None)]) == {}
    assert found(spark, [(1, 0), (None, 0)], []) == {0: "missing"}


def test_parent_never_in_force(spark):
    assert found(spark, [(1, 5), (2, 5)], [(1, None, None), (2, None, 3)]) == {0: "late", 1: "deleted"}


def test_text_keys_are_exact(spark):
    keys = ["C1", "C01", "C1A", "1", "01", "A1B2", "C" + "9" * 30, "C" + "9" * 31, "A1"]
    refs = [(k, 5) for k in keys] + [("C2", 5), ("9" * 18, 5)]
    assert found(spark, refs, [(k, 0, None) for k in keys], "string") == {len(keys): "missing", len(keys) + 1: "missing"}


def test_runs_are_compressed(spark):
    p = spark.createDataFrame([(i, day(0), None) for i in range(5000)], "k int, since timestamp_ntz, until timestamp_ntz")
    runs = key_runs(p, "k", "since", "until").select(F.sum(F.size("runs")).alias("n")).first()["n"]
    assert runs == -(-5000 // BLOCK)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_RUNS", -1)
    parents = [(1, 0, None), (2, 0, 5), (3, 9, None), (700, 0, None)]
    refs = [(k, t) for k in (1, 2, 3, 4, 699, 700, 701) for t in (3, 9)] * 3
    assert found(spark, refs, parents) == brute(refs, parents)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.integers(0, 9)), max_size=25),
    st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9), st.one_of(st.none(), st.integers(0, 9))), max_size=15),
)
def test_against_brute_force(spark, refs, parents):
    assert found(spark, refs, parents) == brute(refs, parents)


def test_key_form(spark):
    got = spark.createDataFrame([(x,) for x in [" c-12 ", "n/a", None, "", "É7"]], "x string").select(key_form(F.col("x")).alias("k")).collect()
    assert [r["k"] for r in got] == ["C12", None, None, None, "7"]
