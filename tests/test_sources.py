import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.validate import Rule, split_valid, validated
from tallyforge.plans.sqlgate import describe_table, documentation, guarded, run_sql
from tallyforge.sources import delimited as D
from tallyforge.sources import store as S
from tallyforge.streaming.ingest import ingest_available, receipts_per_window

SPEC = D.TableSpec("rcpt", (("filing_id", "int"), ("name", "text"), ("amount", "decimal"), ("on", "date")), required=("filing_id",))


def test_reader(spark, tmp_path):
    lines = [b"FILING_ID\tNAME\tAMOUNT\tON", b"1\tA\x00B\t5.50\t5/15/2024\r", b"", b"  ", b'2\t"q\t1e3\t2024-05-15T01:02:03', b"3\tx\ry\t \t5/15/2024 1:02:03 PM", b"4", b"5\tn\t9\t05152024\textra", b"6\t\xff\t99999999999999\t", b"x\tn\t1\t", b"7.9\tn\tjunk\t13/45/2024"]
    (tmp_path / "a.tsv").write_bytes(b"\n".join(lines) + b"\n")
    rows, bad = D.read_delimited(spark, str(tmp_path / "a.tsv"), SPEC)
    got = {r["filing_id"]: (r["name"], None if r["amount"] is None else float(r["amount"]), None if r["on"] is None else r["on"].isoformat()) for r in rows.collect()}
    assert got == {1: ("AB", 5.5, "2024-05-15T00:00:00"), 2: ('"q', 1000.0, "2024-05-15T01:02:03"), 3: ("x\ry", None, "2024-05-15T13:02:03"), 4: (None, None, None), 5: ("n", 9.0, None), 7: ("n", None, None)}
    assert sorted((r["cells"][0], r["error"]) for r in bad.collect()) == [("6", "numeric overflow")]
    again, _ = D.read_text(spark, b"\n".join(lines), SPEC, F.col("filing_id") < 5)
    assert sorted(r["filing_id"] for r in again.collect()) == [1, 2, 3, 4]
    typed = D.hinted(spark.createDataFrame([("1.5", "yes", "2", "x"), (None, "0", "3.0", "1")], "a string, b string, c string, d string"), {"a": "float", "b": "bool", "c": "int", "d": "int"})
    assert dict(typed.dtypes) == {"a": "double", "b": "boolean", "c": "bigint", "d": "string"} and sorted(map(str, map(tuple, typed.collect()))) == ["(1.5, True, 2, 'x')", "(None, False, 3, '1')"]


def test_pipe_files_csv_and_json(spark, tmp_path):
    (tmp_path / "p.txt").write_text("C1|A|x|y\nC2||\n")
    spec = D.TableSpec("cm", (("id", "text"), ("name", "text"), ("rest", "text")), delimiter="|", header=False, constants={"cycle": 2024})
    assert sorted(map(tuple, D.read_delimited(spark, str(tmp_path / "p.txt"), spec)[0].drop("file").collect())) == [("C1", "A", "x|y", 2024), ("C2", None, None, 2024)]
    (tmp_path / "i.csv").write_text('Spe_Id,Tran_Id,Dat\n"S,1",T1,01-JAN-70\nS2,,31-DEC-24\n')
    df = D.read_csv_with_ids(spark, str(tmp_path / "i.csv"), {"spe_id": "spender_id", "tran_id": "transaction_id", "dat": "d", "none": "x"}, "BULK", ["spender_id", "transaction_id"])
    assert sorted((r["sub_id"], r["x"], str(r["d2"])) for r in df.withColumn("d2", D.short_date(F.col("d"))).collect()) == [("BULK:S,1:T1", None, "1970-01-01"), ("BULK:S2:None", None, "2024-12-31")]
    (tmp_path / "page1.json").write_text(json.dumps({"results": [{"a": " ", "b": 5}, {"a": "q", "b": None}]}))
    assert sorted(map(str, map(tuple, D.read_json_pages(spark, str(tmp_path / "page1.json"), {"a": "x", "b": "y", "c": "z"}).collect()))) == ["('q', None, None)", "(None, '5', None)"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1, "n"), (2, "d", 2, "n"), (3, "e", 1, "n")], "k int, v string, seq int, extra string")
    got = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert got(S.upserted(old, new, ["k"], "seq")) == [(1, "a"), (2, "d"), (3, "e")]
    assert got(S.upserted(old, new, ["k"], "seq", update=False)) == [(1, "a"), (2, "b"), (3, "e")]
    assert got(S.upserted(None, new, ["k"], "seq")) == [(2, "d"), (3, "e")]
    assert len(got(S.upserted(old, new, [], "seq"))) == 5
    assert got(S.with_deltas(old, new.select("k", "v").where("k = 3"), old.where("k = 1"), "k")) == [(2, "b"), (3, "e")]


def test_snapshots_and_stream(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    assert store.current("t") is None
    for i, rows in enumerate([[(1, 0, "a"), (2, 0, "b"), (1, 2, "z")], [(2, 1, "c"), (1, 1, "old")]]):
        spark.createDataFrame(rows, "k int, v int, x string").write.parquet(str(tmp_path / "land" / f"b{i}"))
        ingest_available(spark, str(tmp_path / "land" / "*"), "k int, v int, x string", store, "t", ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, store.current("t").collect())) == [(1, 2, "z"), (2, 1, "c")]
    store.refresh([("u", lambda: store.current("t").where("k = 1")), ("w", lambda: store.current("u").select("k"))])
    assert store.current("w").count() == 1
    spark.createDataFrame([(i, 0, "n") for i in range(3, 300)], "k int, v int, x string").createOrReplaceTempView("many")
    store.upsert("t", spark.table("many").withColumn("s", F.lit(1)), ["k"], "s")
    before = set(store._newest("t")[1]["parts"])
    store.upsert("t", spark.createDataFrame([(7, 1, "q", 1, 5)], "k int, v int, x string, s int, more int"), ["k"], "s")
    after = set(store._newest("t")[1]["parts"])
    assert len(before - after) == 1 == len(after - before)  # one bucket was rewritten
    assert store.current("t").count() == 299 and tuple(store.current("t").where("k = 7").select("v", "x", "more").first()) == (1, "q", 5)
    with pytest.raises(RuntimeError):
        store._publish("t", store._newest("t")[0], {})
    store.write("p", store.current("t"), partition_by=["k"], sort_by=["v"])
    assert store.current("p").where("k = 2").count() == 1
    e = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 12:00:00", "a", 2), ("2024-01-02 00:00:00", "a", 4)], "t string, k string, n int").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["total"] for r in receipts_per_window(e, "t", "k", "n").collect()) == [3, 4]


def test_manifest_dead_letters_archives(spark, tmp_path):
    for n, body in (("a.TSV", "1"), ("b.tsv", "2")):
        (tmp_path / n).write_text(body)
    hashes = S.file_hashes(spark, str(tmp_path / "*.[tT][sS][vV]"))
    done = hashes.where(F.col("source_file").endswith("a.TSV")).select(F.lit("T").alias("table_name"), F.lit("s").alias("source"), "file_hash", F.lit(3).alias("rows_processed"))
    assert [r["source_file"][-5:] for r in S.files_to_load(hashes, done, "t", "s").collect()] == ["b.tsv"]
    assert S.files_to_load(hashes, done.withColumn("rows_processed", F.lit(0)), "t", "s").count() == 2
    bad = spark.createDataFrame([(1, "x", "e", "f")], "a int, b string, error string, file string")
    assert S.dead_letters(bad, "t", "error", "file").first()["row_data"] == '{"a":1,"b":"x"}'
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("D/DATA/RCPT_CD.TSV", "r")
        z.writestr("cm.txt", "c")
    assert S.archive_members(str(tmp_path / "z.zip")) == ["D/DATA/RCPT_CD.TSV"]
    assert open(S.extract_member(str(tmp_path / "z.zip"), "rcpt_cd.tsv", str(tmp_path / "out"))).read() == "r"
    assert open(S.extract_member(str(tmp_path / "z.zip"), "cm", str(tmp_path / "out"))).read() == "c"
    assert open(S.extract_member(str(tmp_path / "z.zip"), "cm", str(tmp_path / "shared"), spark)).read() == "c"
    with pytest.raises(FileNotFoundError):
        S.extract_member(str(tmp_path / "z.zip"), "nothing", str(tmp_path))
    assert [f[-5:] for f in S.local_files(str(tmp_path))] == ["a.TSV", "b.tsv"]


def test_rules(spark):
    rules = [Rule("a", "required"), Rule("n", "numeric", 0, 10), Rule("d", "date"), Rule("e", "enum", values=("x", "y")), Rule("a", "length", 1, 3)]
    df = spark.createDataFrame([("ok", "5", "2024-01-31", "x"), (None, None, None, None), ("long", "11", "2024-02-31", "z"), (" ", "q", "", "")], "a string, n string, d string, e string")
    assert [len(r["_validation_errors"]) for r in validated(df, rules).collect()] == [0, 1, 4, 2]
    crossed = validated(df, [Rule("a", "cross_field", values=("<=", "e"))]).select("a", F.size("_validation_errors").alias("n"))
    assert {r["a"]: r["n"] for r in crossed.collect()} == {"ok": 0, None: 0, "long": 0, " ": 0} and validated(df, [Rule("a", "cross_field", values=(">", "e"))]).where(F.size("_validation_errors") > 0).count() == 2
    good, bad = split_valid(df, rules)
    assert (good.count(), bad.count()) == (1, 3) and validated(df, []).count() == 4


@pytest.mark.parametrize("sql", ["drop table x", "select 1; select 2", "select ';'", "explain analyze select 1", "", "insert into x select 1"])
def test_guard(sql, spark):
    with pytest.raises(ValueError):
        guarded(sql)
    assert "error" in run_sql(spark, sql)


@pytest.mark.parametrize("sql", [
    "with x as (select 2 as a) insert into gate_t select a from x", "with x as (select 2 as a) insert overwrite gate_t select a from x", "with x as (select 1 as a) from x insert into gate_t select a", "explain insert into gate_t select 3",
    "select transform(a) using 'cat' from gate_t", "select reflect('java.lang.System', 'lineSeparator')", "select 1 where 1 in (select java_method('java.lang.Math', 'abs', 1))", "with x as (select try_reflect('a', 'b')) select * from x",
])
def test_gate_lets_nothing_but_reads_through(sql, spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "t"))
    spark.sql(f"create table gate_t using parquet location '{tmp_path / 't'}'")
    try:
        assert run_sql(spark, sql) == {"error": "only queries are allowed"}
        assert spark.table("gate_t").count() == 1
        assert run_sql(spark, "with x as (select max(a) as a from gate_t) select (select a from x) as m, a from gate_t where a in (select a from x)")["rows"] == [{"m": 1, "a": 1}]
    finally:
        spark.sql("drop table gate_t")


def test_documentation():
    assert documentation({"b": len, "a": lambda: 0}) == "# Queries\n\n* `a`\n* `b`: Return the number of items in a container.\n"


def test_run_sql(spark):
    spark.range(5).createOrReplaceTempView("five")
    got = run_sql(spark, "select id, cast(id as decimal(5,2)) d, date '2024-01-01' t from five order by id", 2)
    assert got == {"columns": ["id", "d", "t"], "rows": [{"id": 0, "d": 0.0, "t": "2024-01-01"}, {"id": 1, "d": 1.0, "t": "2024-01-01"}], "truncated": True}
    assert run_sql(spark, "select * from five", 99)["truncated"] is False and "error" in run_sql(spark, "select nothing from nowhere")
    assert [(r["column_name"], r["row_count"]) for r in describe_table(spark.table("five"), "five").collect()] == [("id", 5)]
    with pytest.raises(ValueError):
        describe_table(spark.table("five"), "Five;")
