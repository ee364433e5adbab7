import random

import pytest

from tallyforge.llm import leakage
from tallyforge.llm.leakage import leaked_items, words_of


def found(spark, docs, items, window=3):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(a, b, "k", 1) for a, b in items], "item_id int, text string, t string, words int")
    out = leaked_items(d, i, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=window)
    return {(r["doc_id"], r["item_id"]): r["words"] for r in out.collect()}


def brute(docs, items, window=3):
    out = {}
    for d, t in docs:
        for i, u in items:
            if d is None or t is None or u is None:
                continue
            a, b = words_of(t), words_of(u)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= window:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_words():
    assert words_of("Año-2024, it's_ok\nÜBER") == ["año", "2024", "it", "s", "ok", "über"]
    assert words_of("A-B  c_d") == ["a", "b", "c", "d"]


def test_cases(spark):
    items = [(1, "the red fox ran"), (2, "The red FOX ran"), (3, "a b"), (4, None), (5, "x x x x"), (6, "ran far away home")]
    docs = [(1, "see THE...red\nfox!"), (2, "the red"), (3, None), (4, ""), (5, "x x x"), (6, "fox ran far away"), (7, "a b"), (1, "see THE...red\nfox!"), (None, "the red fox")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


@pytest.mark.parametrize("block", [2, 100])
def test_random(spark, block, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", block)
    r = random.Random(block)
    text = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    docs = [(i, text(r.randrange(30))) for i in range(40)] + [(99, text(3000))]
    items = [(i, text(r.randrange(2, 12))) for i in range(7)]
    assert found(spark, docs, items, 5) == brute(docs[:40], items, 5) | {k: v for k, v in brute(docs[40:], items, 5).items()}
