"""Items of varying length packed into fixed-capacity containers by a histogram solved with non-negative least squares."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import checkpointed

#: Histogram bins a length is mapped to at most; capacities above are binned upwards.
MOST_BINS = 2048
#: Items that one ranking task sorts, about.
ITEMS_PER_CHUNK = 500_000
#: Deepest combination of pieces in one container pattern.
DEPTH = 3
#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("tallyforge", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, tokens): token counts of whole texts in a public byte-level vocabulary file.

    A null or empty text has 0 tokens. Every executor reads the file at the path given.
    """
    kind = dict(docs.dtypes)[doc_id]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["d", "n"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(count, f"d {kind}, n long").select(F.col("d").alias(doc_id), F.col("n").alias("tokens"))


def patterns(bins: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All non-increasing combinations of at most ``depth`` present bin sizes that fill the window bins exactly.

    Row i holds the sizes of pattern i, padded with zeros.
    """
    sizes = np.flatnonzero(present)
    have = np.zeros(bins + 1, dtype=bool)
    have[sizes] = True
    found = [(bins, 0, 0)] if have[bins] else []
    if depth >= 2:
        found += [(int(a), bins - int(a), 0) for a in sizes if a < bins and 2 * a >= bins and have[bins - a]]
    if depth >= 3:
        for a in sizes[(sizes < bins) & (3 * sizes >= bins)]:
            rest = bins - int(a)
            b = sizes[(sizes <= a) & (2 * sizes >= rest) & (sizes < rest)]
            b = b[have[rest - b]]
            found += [(int(a), int(x), rest - int(x)) for x in b]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |weight * (A x - target)|^2, by accelerated projected gradient.

    A is given by its columns: columns[j] lists the rows to which x[j] adds one each
    (0 is no row). Row 0 is ignored. Step sizes are scaled by the columns' norms.
    """
    m, n = len(target), len(columns)
    if not n:
        return np.zeros(0)
    w2 = weight**2
    w2[0] = 0.0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(columns.ravel(), weights=np.repeat(x, columns.shape[1]), minlength=m)

    rows = forward(np.ones(n))
    scale = 1.0 / np.maximum((w2[columns] * rows[columns]).sum(axis=1), 1e-12)  # row sums bound the curvature
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        residual = w2 * (forward(y) - target)
        new = np.maximum(0.0, y - scale * residual[columns].sum(axis=1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - x) @ (y - new) > 0:  # restart when the step goes against the momentum
            t_new = 1.0
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Container kinds [(size, how often), ...] with their number, which use up the histogram exactly.

    counts[s] items have size s (in bins); the capacity is len(counts) - 1. NNLS
    repeat counts of the shallow patterns are rounded down; what is left is packed
    greedily, always the largest size that still fits, whole runs of equal containers
    at a time.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    kinds: list[tuple[list[tuple[int, int]], int]] = []
    p = patterns(capacity, DEPTH, left > 0)
    if len(p):
        weight = 1.0 / np.sqrt(np.maximum(left, 1.0))
        repeats = np.floor(nnls(p, left.astype(float), weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-p[:, 0] * 1_000_000 - p[:, 1], kind="stable"):
            if repeats[j]:
                size, often = np.unique(p[j][p[j] > 0], return_counts=True)
                r = int(min(repeats[j], (left[size] // often).min()))
                if r:
                    left[size] -= r * often
                    kinds.append((list(zip(size.tolist(), often.tolist())), r))
    while left.any():
        room = capacity
        taken: dict[int, int] = {}
        present = np.flatnonzero(left).tolist()
        while present and room >= present[0]:
            at = bisect_right(present, room) - 1
            s = present[at]
            n = int(min(left[s], room // s))
            taken[s] = n
            room -= n * s
            present = present[:at]
        r = min(int(left[s]) // n for s, n in taken.items())
        for s, n in taken.items():
            left[s] -= r * n
        kinds.append((sorted(taken.items()), r))
    return kinds


def pack(items: DataFrame, *, item_id: str, size: str, capacity: int) -> DataFrame:
    """(item_id, piece, size, container): every item, or piece of an item above the capacity, in one container.

    Containers never hold more than ``capacity``; only items above it are split, into
    full pieces and a rest. Method: sizes are mapped to at most MOST_BINS histogram
    bins (rounded up, so a container is never overfull); shallow combinations of bins
    that fill the window exactly get repeat counts by non-negative least squares
    against the histogram; the counts are rounded down and the remaining histogram is
    packed greedily. The plan is as large as the histogram, not as the data. Items
    then take the places of their bin by rank; ranks come from counts per (bin, chunk)
    and a rank within the chunk, so that a bin that holds any share of the items is
    ranked in many tasks.

    Defined results: a null size or one below 0 is an error of the caller and counts
    as 0; items of size 0 use no space and go to container 0; repeated ids are items of
    their own; an empty input gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    width = -(-capacity // MOST_BINS)
    bins = capacity // width
    n = F.greatest(F.lit(0), F.coalesce(F.col(size).cast("long"), F.lit(0)))
    pieces = (
        items.select(F.col(item_id).alias("id"), n.alias("n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / F.lit(float(capacity))) - 1).cast("long"))))
        .select("id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n"))
        .withColumn("bin", F.least(F.lit(bins), F.ceil(F.col("n") / F.lit(float(width)))).cast("int"))
    )
    pieces = checkpointed(pieces)
    chunks = max(16, -(-pieces.count() // ITEMS_PER_CHUNK))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)).cast("int"))
    counted = pieces.groupBy("bin", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counted.withColumn("before", F.sum("c").over(Window.partitionBy("bin").orderBy("chunk")) - F.col("c")).select("bin", "chunk", "before")
    histogram = np.zeros(bins + 1, dtype=np.int64)
    for r in counted.groupBy("bin").agg(F.sum("c").alias("c")).collect():  # at most MOST_BINS + 1 rows
        histogram[r["bin"]] = r["c"]
    places: list[tuple[int, int, int, int, int]] = []  # bin, first rank, last rank, places per container, first container
    used = np.zeros(bins + 1, dtype=np.int64)
    base = 0 if not histogram[0] else 1
    for kind, r in plan(histogram):
        for s, often in kind:
            places.append((s, int(used[s]), int(used[s]) + r * often - 1, often, base))
            used[s] += r * often
        base += r
    if histogram[0]:
        places.append((0, 0, int(histogram[0]) - 1, int(histogram[0]), 0))
    by_bin: dict[int, list[tuple[int, int, int]]] = {}
    for s, first, _, often, container in sorted(places):
        by_bin.setdefault(s, []).append((first, often, container))
    tables = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in by_bin.items()}
    kind = dict(pieces.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bin_of, rank = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros(b.num_rows, dtype=np.int64)
            for s in np.unique(bin_of):
                at = bin_of == s
                first, often, container = tables[int(s)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = container[i] + (rank[at] - first[i]) // often[i]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("piece"), b.column("n"), pa.array(out)], names=["id", "piece", "n", "container"])

    within = Window.partitionBy("bin", "chunk").orderBy("id", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(within) - 1).join(before, ["bin", "chunk"]).select("id", "piece", "n", "bin", (F.col("before") + F.col("r")).cast("long").alias("rank"))
    packed = ranked.mapInArrow(place, f"id {kind}, piece long, n long, container long")
    return packed.select(F.col("id").alias(item_id), "piece", F.col("n").alias("size"), "container")
