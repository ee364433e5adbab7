import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators.rejects import Layout, date_parser, parse_lines, parse_rows, read_layouts, read_quoted_files, record_ends, split_records, typed_rows
from tallyforge.plans import core_queries

L = Layout(",", '"', ("a", "b", "c"), ("text", "int", "date"), (None, None, "dd-MMM-yy"), (True, False, False))
T = Layout("\t", None, ("a", "b"), ("text", "decimal"), (None, None), (False, True))


def one(line, layout=L):
    reason, fields = parse_lines(pa.array([line], pa.string()), layout)
    return reason[0], fields[0]


@pytest.mark.parametrize(
    "line, reason",
    [
        ("x,1,01-JAN-20", None), ('"x","1","01-jan-20"', None), ('"a,b",1,', None), ('"a\nb",1,', None), ('"a""b",,', None), ('"""",,', None), ('"x"y,1,', "quoting"), ('x"y,1,', "quoting"), ('"x,1,', "quoting"),
        (' "x",1,', "quoting"), ('"a"" ,1,', "quoting"), ("x,1", "column_count"), ("x,1,,", "column_count"), ("", "column_count"), (None, "column_count"), (",1,", "invalid_value"), ('"",1,', "invalid_value"), ("  ,1,", "invalid_value"),
        ("x,1.0,", "invalid_value"), ("x, -12 ,", None), ("x,1234567890,", "invalid_value"), ("x,+1,", "invalid_value"), ("x,,31-FEB-20", "invalid_value"), ("x,,1-FEB-20", "invalid_value"), ("x,, 29-Feb-20 ", None), ("ü,١,", "invalid_value"),
    ],
)
def test_reasons(line, reason):
    assert one(line)[0] == reason


def test_values():
    assert one('"a""b, c", 7 ,01-MAR-21')[1] == ['a"b, c', "7", "2021-03-01"]
    assert one('x"y\t 12.50', T) == (None, ['x"y', "12.50"])
    assert one("\t1.234", T)[0] == "invalid_value"
    assert one("\t-1234567890.1", T)[0] is None
    assert one("é" * 5000 + "\t1", T)[1] == ["é" * 5000, "1"]


def test_many_lines_against_csv():
    r = random.Random(2)
    lines, want = [], []
    for _ in range(400):
        row = ["".join(r.choice('ab,"\n é') for _ in range(r.randrange(6))) for _ in range(r.choice([2, 3, 3, 3]))]
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(row)
        lines.append(out.getvalue())
        want.append(row)
    layout = Layout(",", '"', ("a", "b", "c"), ("text",) * 3, (None,) * 3, (False,) * 3)
    reason, fields = parse_lines(pa.array(lines), layout)
    for w, x, f in zip(want, reason, fields):
        assert x == (None if len(w) == 3 else "column_count")
        assert f is None or f == [v if v.strip(" ") else None for v in w]


@pytest.mark.parametrize("pattern, good, bad", [("M/d/yyyy", ["1/2/2020", "01/02/2020", "12/31/1999"], ["13/1/2020", "1/2/20", "2/30/2020", "001/1/2020"]), ("MMddyyyy", ["01022020"], ["1022020", "13012020", "00012020"]), ("dd-MMM-yy", ["01-Jan-20", "29-FEB-24"], ["1-Jan-20", "29-FEB-23", "01-XXX-20"])])
def test_dates(pattern, good, bad):
    p = date_parser(pattern)
    assert all(p(x) for x in good) and not any(p(x) for x in bad)


def test_record_ends():
    data = np.frombuffer(b'a,"x\ny"\nb\n', dtype=np.uint8)
    assert record_ends(data, ord('"')).tolist() == [7, 9]
    assert record_ends(data, None).tolist() == [4, 7, 9]


def test_rows(spark):
    cols = spark.createDataFrame([("t", "\t", None, 1, "a", "text", None, False), ("t", "\t", None, 2, "b", "decimal", None, True)], "table_name string, delimiter string, quote_char string, col_no int, column_name string, value_type string, date_format string, is_required boolean")
    lines = spark.createDataFrame([(1, "t", "x\t1.5", "q"), (2, "t", "x", "q"), (3, "u", "x\t1", "q"), (4, None, "x\t1", "q"), (5, "t", None, "q"), (1, "t", "x\t1.5", "q")], "id int, table_name string, row_data string, reason string")
    layouts = read_layouts(cols)
    parsed = parse_rows(lines, layouts, id_col="id", table_col="table_name", line_col="row_data")
    assert sorted((r["id"], r["reason"]) for r in parsed.collect() if r["reason"]) == [(i, "column_count") for i in (2, 3, 4, 5)]
    typed = typed_rows(parsed, "t", layouts["t"], "table_name", ["id"]).collect()
    assert [(r["id"], r["a"], float(r["b"])) for r in typed] == [(1, "x", 1.5)] * 2
    assert parse_rows(lines.limit(0), layouts, id_col="id", table_col="table_name", line_col="row_data").count() == 0


def test_every_layout_has_its_typed_rows(spark, tmp_path):
    layouts = [("rcpt_cd", "\t", None, "row int, amount decimal"), ("fec_individual_contributions", "|", None, "committee_id text, contribution_amount decimal"), ("fec_ie_targeted", ",", '"', "spender_name text, expenditure_amount decimal")]
    columns = [(t, d, q, i, *c.split(" "), None, False) for t, d, q, cs in layouts for i, c in enumerate(cs.split(", "), 1)]
    lines = [(1, "rcpt_cd", "7\t1.5"), (2, "fec_individual_contributions", "C1|2.5"), (3, "fec_ie_targeted", '"A, ""B""", 3.5 '), (4, "fec_ie_targeted", '"A"x,1')]
    spark.createDataFrame(columns, "table_name string, delimiter string, quote_char string, col_no int, column_name string, value_type string, date_format string, is_required boolean").write.parquet(f"{tmp_path}/file_columns.parquet")
    spark.createDataFrame([(i, t, line, None, "f", None) for i, t, line in lines], "id int, table_name string, row_data string, error_message string, source_file string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/etl_dead_letter.parquet")
    typed = [n for n in core_queries.QUERIES if n.startswith("p7_valid_")]
    got = sorted(tuple(r) for n in typed for r in core_queries.QUERIES[n](spark, str(tmp_path)).collect())
    assert got == [(1, "f", 7, 1.5), (2, "f", "C1", 2.5), (3, "f", 'A, "B"', 3.5)]
    assert set(typed) <= set(core_queries.SQL)


def test_files_with_line_feeds_in_quotes(spark, tmp_path):
    (tmp_path / "ie_1.csv").write_bytes(b'a,"x\ny",1\r\n\nb,"say ""no""\n\n",2\nc,d,3')
    (tmp_path / "ie_2.csv").write_bytes(b'a,"x\nb,y,1\n')
    (tmp_path / "other.txt").write_bytes(b'a"\nb\n')
    layouts = {"ie": Layout(",", '"', ("p", "q", "n"), ("text", "text", "int"), (None,) * 3, (True, False, True))}
    rows = read_quoted_files(spark, str(tmp_path / "*"), layouts, F.when(F.col("source_file").contains("ie_"), "ie").otherwise("other"))
    got = {}
    for r in parse_rows(rows, layouts, id_col="line_no", table_col="table_name", line_col="row_data", keep=["source_file"]).collect():
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append((r["line_no"], r["reason"], r["fields"]))
    assert sorted(got["ie_1.csv"]) == [(1, None, ["a", "x\ny", "1"]), (2, None, ["b", 'say "no"\n\n', "2"]), (3, None, ["c", "d", "3"])]
    assert sorted(got["ie_2.csv"]) == [(1, "quoting", None), (2, None, ["b", "y", "1"])]
    assert [x[:2] for x in sorted(got["other.txt"])] == [(1, "column_count"), (2, "column_count")]
    assert split_records(b"", '"') == split_records(b"\n \n", None) == []
