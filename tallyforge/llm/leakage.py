"""Passages of held-out items inside corpus documents: prefix-filtered join with exact verification."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are handled by one broadcast index; more are handled block by block.
ITEMS_PER_BLOCK = 20_000
#: Fixed value: a word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: ASCII bytes to lower case, all that is no letter or digit to a space.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """The words of text in lower case; whatever stands between them is dropped."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return WORD.findall(text.lower())


def _prefix_index(items: list[tuple[int, list[str]]], rarity: dict[str, int], window: int) -> dict[str, list[tuple[int, int]]]:
    """word -> [(item number, position)]: for every window of every item its rarest word.

    A document that contains a window contains all its words, so the rarest alone is a
    necessary prefix of the window in rarity order. Neighbouring windows share it.
    """
    index: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for n, (_, words) in enumerate(items):
        order = [(rarity.get(w, 0), w) for w in words]
        for start in range(len(words) - window + 1):
            at = min(range(start, start + window), key=lambda i: (order[i], i))
            index[words[at]].add((n, at))
    return {w: sorted(p) for w, p in index.items()}


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, window: int = 12) -> DataFrame:
    """(doc_id, item_id, words): documents with at least ``window`` consecutive words of an item.

    words is the length of the longest common run of words. Words are compared in
    lower case; anything but letters and digits between them does not matter.

    Method: one pass over the documents counts in how many of them each item word
    occurs. In every item window only the rarest word is joined against the documents
    (its prefix in rarity order); each hit fixes the alignment of item and document,
    windows that do not fit the document's ends are excluded by position, and the run
    of equal words around the hit is verified exactly. Items are the small side: they
    are broadcast in blocks of ITEMS_PER_BLOCK, so any number of them can be handled,
    and no pair of documents is ever formed.

    Defined results: null or empty texts, and items with fewer than ``window`` words,
    give no rows; equal items or documents each give their own rows; rows repeated in
    either table give one row; rows with a null id are ignored; no items or no
    documents give an empty result; other columns are ignored, whatever their names.
    """
    types = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"d {types[0]}, i {types[1]}, words int"
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    eval_rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    spark = docs.sparkSession
    block: list[tuple[int, list[str]]] = []
    found: list[DataFrame] = []
    for r in eval_rows.orderBy("i").toLocalIterator():
        words = words_of(r["t"])
        if len(words) >= window:
            block.append((r["i"], words))
        if len(block) == ITEMS_PER_BLOCK:
            found.append(_leaks(rows, block, window, schema))
            block = []
    if block or not found:
        found.append(_leaks(rows, block, window, schema) if block else spark.createDataFrame([], schema))
    result = found[0]
    for x in found[1:]:
        result = result.unionByName(x)
    return result.groupBy("d", "i").agg(F.max("words").alias("words")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "words")


def _leaks(rows: DataFrame, items: list[tuple[int, list[str]]], window: int, schema: str) -> DataFrame:
    vocabulary = frozenset(w for _, words in items for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = defaultdict(int)
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(t)):
                    n[w] += 1
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    # bounded by the block's own words, not by the corpus
    rarity = {r["w"]: r["n"] for r in rows.select("t").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    index = _prefix_index(items, rarity, window)
    keys = frozenset(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[int, int], int] = {}
            for row, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                if len(words) < window or keys.isdisjoint(words):
                    continue
                seen: dict[tuple[int, int], int] = {}  # (item, alignment) -> end of the run already verified
                for at, w in enumerate(words):
                    if w not in keys:
                        continue
                    for n, p in index[w]:
                        other = items[n][1]
                        line = (n, at - p)
                        if seen.get(line, -1) >= at:
                            continue
                        if min(at, p) + min(len(words) - at, len(other) - p) < window:
                            continue  # the ends leave no room for a window
                        lo = 0
                        while lo < min(at, p) and words[at - lo - 1] == other[p - lo - 1]:
                            lo += 1
                        hi = 1
                        while hi < min(len(words) - at, len(other) - p) and words[at + hi] == other[p + hi]:
                            hi += 1
                        seen[line] = at + hi - 1
                        if lo + hi >= window:
                            out[row, n] = max(out.get((row, n), 0), lo + hi)
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in out], pa.int64())), pa.array([items[n][0] for _, n in out], out_item), pa.array(list(out.values()), pa.int32())], names=["d", "i", "words"]
            )

    out_item = pa.int32() if " i int," in f" {schema.split(', ')[1]}," else pa.int64() if "bigint" in schema.split(", ")[1] else pa.string()
    return rows.mapInArrow(search, schema)
