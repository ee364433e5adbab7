import random

from pyspark.sql import functions as F

from tallyforge.llm.truncation import features, field_widths, truncated_texts

WORDS = "the committee moved its account after a long meeting and asked for the missing schedule of every donor in town".split()


def text(r, n):
    out = []
    while sum(map(len, out)) + len(out) < n:
        s = " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 12)))
        out.append(s.capitalize() + r.choice(["."] * 8 + ["?", "!"]))
    t = " ".join(out)
    return t + r.choice(["", "", "\n\nTotal: $%d" % r.randrange(999), "\n\nJane Doe\nNorth Town", " (see form 460)", "\nRef. 2020-%d-A" % r.randrange(99)])


def corpus(seed, n):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t, src = text(r, r.randrange(150, 900)), r.choice(["memo", "mail", None])
        kind = r.random()
        if kind < 0.15 and src == "memo" and len(t) > 400 and t[399] not in ".?!" and t[:400].rstrip()[-1] not in ".?!":
            t, _ = t[:400], cut.add(i)
        elif kind > 0.94:
            at = r.randrange(80, len(t) - 60)
            if t[:at].rstrip()[-1] not in ".?!" and "\n" not in t[at - 5 : at]:
                t, _ = t[:at] + r.choice(["", "  ", "…", " (cont"]), cut.add(i)
        rows.append((i, t, src, 1.0))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus(1, 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = {r["doc_id"] for r in truncated_texts(df, doc_id="doc_id", source="source", text="text").where("cut").collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.95 and hit / len(got) > 0.95


def test_widths(spark):
    df = spark.createDataFrame([("a", "x" * n) for n in [50] * 20 + list(range(20, 90))] + [(None, "y" * 7)] * 9 + [("b", None)], "s string, t string")
    got = {(r["source"], r["width"]) for r in field_widths(df, source="s", text="t").collect()}
    assert got == {("a", 50), ("", 7)}


def test_odd_texts(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "x", "a"), (5, "word " * 40000, "a"), (6, "One. Two.", None), (6, "One. Two.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = truncated_texts(df, doc_id="doc_id", source="source", text="text")
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {2, 3, 4, 5, 6} and not got[2]["cut"] and not got[3]["cut"]
    assert out.where(F.col("doc_id") == 6).count() == 2
    assert truncated_texts(df.limit(0), doc_id="doc_id", source="source", text="text").count() == 0


def test_features_have_one_length():
    assert len({len(features(t, len(t), [10])) for t in ["", "a", "\n\n", "Total: $5", "a b (c"]}) == 1
