import random

from tallyforge.operators.snapshots import counted_deliveries, snapshot_changes


def changes(spark, rows, snapshots):
    df = spark.createDataFrame([(k, s, o, a, b, "n", 0) for k, s, o, a, b in rows], "id long, snap string, line int, a string, b int, no string, d int")
    sn = spark.createDataFrame([(s,) for s in snapshots], "snap string")
    out = snapshot_changes(df, sn, key="id", snapshot="snap", order=["line"], fields=["a", "b"])
    return sorted((r["id"], r["snap"], r["change_kind"], r["changed_fields"]) for r in out.collect())


def brute(rows, snapshots):
    clean = lambda a: (a or "").strip(" ") or None
    state = {}
    for k, s, o, a, b in rows:
        if k is not None and s in snapshots:
            v = (o, clean(a), b)
            cur = state.setdefault(s, {}).get(k)
            if cur is None or (v[0], v[1] or "", v[2] or 0) > (cur[0], cur[1] or "", cur[2] or 0):
                state[s][k] = v
    out = []
    order = sorted(set(snapshots))
    for x, y in zip(order, order[1:]):
        p, q = state.get(x, {}), state.get(y, {})
        for k in p.keys() | q.keys():
            if k not in p:
                out.append((k, y, "added", ""))
            elif k not in q:
                out.append((k, y, "removed", ""))
            else:
                f = [n for n, i in (("a", 1), ("b", 2)) if p[k][i] != q[k][i]]
                if f:
                    out.append((k, y, "changed", ",".join(f)))
    return sorted(out)


def test_kinds(spark):
    rows = [(1, "1", 1, "x", 1), (1, "1", 2, " y ", None), (1, "2", 1, "y", None), (2, "1", 1, "", 5), (2, "2", 1, None, 6), (3, "2", 1, "q", 0), (4, "1", 1, "Q", 0), (4, "2", 1, "q", 0), (None, "1", 1, "x", 1), (5, "1", 1, "gone", 1)]
    rows += rows[:2]
    assert changes(spark, rows, ["1", "2"]) == brute(rows, ["1", "2"]) == [(2, "2", "changed", "b"), (3, "2", "added", ""), (4, "2", "changed", "a"), (5, "2", "removed", "")]


def test_skipped_and_few_snapshots(spark):
    rows = [(1, "1", 1, "x", 1), (1, "2", 1, "z", 1), (1, "3", 1, "x", 1)]
    assert changes(spark, rows, ["1", "3"]) == []
    assert changes(spark, rows, ["2"]) == []
    assert changes(spark, [], ["1", "2"]) == []
    assert changes(spark, rows, ["1", "1", "2"]) == [(1, "2", "changed", "a")]


def test_random(spark):
    r = random.Random(4)
    rows = [(r.randrange(6), str(r.randrange(4)), i, r.choice(["a", "b", " a", "", None]), r.choice([1, 2, None])) for i in range(60)]
    assert changes(spark, rows, ["0", "1", "2", "3"]) == brute(rows, ["0", "1", "2", "3"])


def test_counted_deliveries(spark):
    files = [("T", "x/20240101/a", 5), ("t ", "x/20240101/b", 3), ("t", "x/20240201/a", 5), ("t", "x/20240201/b", 0), ("t", "x/20240301/a", None), ("u", "x/20240401/a", 4), ("t", "nodate", 3)]
    df = spark.createDataFrame([(*f, None) for f in files], "table_name string, source_file string, rows_processed int, file_hash string")
    assert [r["delivery"] for r in counted_deliveries(df, "t").collect()] == ["20240101"]


def test_repeated_deliveries_are_left_out(spark):
    files = [("t", "20240101/a", 5, "h1"), ("t", "20240101/b", 5, "h2"), ("t", "20240201/x", 5, "h2"), ("t", "20240201/y", 5, "h1"), ("t", "20240301/a", 5, "h1"), ("t", "20240401/a", 0, "h9"), ("t", "20240501/a", 5, "h1"), ("t", "20240601/a", 5, None), ("t", "20240701/a", 5, None)]
    df = spark.createDataFrame(files, "table_name string, source_file string, rows_processed int, file_hash string")
    assert sorted(r["delivery"] for r in counted_deliveries(df, "T").collect()) == ["20240101", "20240301", "20240601", "20240701"]
