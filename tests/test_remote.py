import datetime
import json
import zipfile

import pytest

from tallyforge import cli
from tallyforge.sources.delimited import read_json_pages
from tallyforge.sources.remote import dates_in, delta_files, first_kind, is_stale, land_pages, page_links


def test_staleness():
    assert not is_stale({"ETag": "a", "Content-Length": "5"}, {"etag": "a", "content-length": "6"})
    assert is_stale({"Last-Modified": "x"}, {"last-modified": "y"}) and not is_stale({"Content-Length": "5"}, {"content-length": "5"})
    assert is_stale({}, {"etag": "a"}) and is_stale({"etag": "a"}, {"content-length": "5"})


def test_pages_go_on_where_they_stopped(spark, tmp_path):
    pages = {0: [{"a": "1"}], 1: [{"a": "2"}, {"a": " "}], 2: []}
    asked, waits = [], []

    def get(query):
        asked.append(query.get("after", 0))
        if len(asked) == 2:
            return 429, {}
        if len(asked) == 4:
            return 500, {}
        n = query.get("after", 0)
        return 200, {"results": pages[n], "pagination": {"last_indexes": {"after": n + 1}}}

    with pytest.raises(RuntimeError):
        land_pages(get, str(tmp_path), {"per_page": 2}, wait=waits.append)
    assert land_pages(get, str(tmp_path), {"per_page": 2}) == 0 and asked == [0, 1, 1, 2, 2] and waits == [1.0]
    assert sorted(str(r["x"]) for r in read_json_pages(spark, str(tmp_path / "page-*.json"), {"a": "x"}).collect()) == ["1", "2", "None"]
    assert land_pages(get, str(tmp_path), {"per_page": 2}) == 0 and len(asked) == 5


def test_listings_links_and_dates():
    assert delta_files(["b_insert_1.zip", "x/deletes.zip", "base.zip", "inserted.zip", "a-INSERT.zip"]) == {"insert": ["a-INSERT.zip", "b_insert_1.zip"], "delete": ["x/deletes.zip"]}
    html = '<a href="/r/one.pdf">Results <b>of</b> 2026</a><a name="x">none</a><a href="two.html">Other</a><A HREF="/r/one.pdf">again</A>'
    assert page_links(html, "https://example.org/d/", r"\.pdf") == [("https://example.org/r/one.pdf", "Results of 2026")]
    text = "Due March 3rd, 2026 or the 14th of April, 2026; 5 May 2026, 6/30/2026, 2026-07-31, Marchy 99, 2026 and 2/30/2026."
    assert list(dates_in(text)) == [datetime.date(2026, m, d) for m, d in ((3, 3), (4, 14), (5, 5), (6, 30), (7, 31))]
    kinds = {"primary": ("primary",), "general": ("general", "november")}
    assert first_kind("The November Election", kinds) == "general" and first_kind("none", kinds, "other") == "other"


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.tsv").write_text("1")
    assert cli.main(["discover", str(tmp_path)]) == 0
    (tmp_path / "inv.json").write_text(capsys.readouterr().out)
    assert cli.main(["verify", str(tmp_path), str(tmp_path / "inv.json")]) == 0
    (tmp_path / "a.tsv").write_text("2")
    (tmp_path / "b.tsv").write_text("2")
    capsys.readouterr()
    assert cli.main(["verify", str(tmp_path), str(tmp_path / "inv.json")]) == 1 and json.loads(capsys.readouterr().out) == {"a.tsv": "changed", "b.tsv": "new"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("D/X.TSV", "r")
    assert cli.main(["fetch", str(tmp_path / "z.zip"), "x.tsv", str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "X.TSV").read_text() == "r"
