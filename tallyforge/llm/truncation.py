"""Texts cut off by a field's width or in transfer, found by a model trained on artificial cuts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.skew import salted_join
from tallyforge.session import checkpointed

#: Size of the hashed feature space.
DIMENSIONS = 1 << 16
#: Closing characters that the features look at; the length counts the whole text.
TAIL = 480
#: Sources up to which their widths are broadcast.
BROADCAST_SOURCES = 100_000
#: Lengths that differ by so little from a field's width count as its width.
SLACK = 3

#: What senders put behind a text that goes on elsewhere; "" most of the time.
MARKS = ["", "", "", "", "", "", " ", "  ", "…", "...", " (cont", " (cont.", " (cont'd", " [", " [...]", " (", " (more", "-", " -"]

_TOKEN = re.compile(r"\S+")


def _shape(word: str, most: int = 12) -> str:
    """Letters as x or X, digits as 9, runs of the same kind shortened to two."""
    out: list[str] = []
    for ch in word:
        k = "9" if ch.isdigit() else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out[:most])


def features(tail: str, length: int, limits: list[int]) -> list[int]:
    """Hashed features of a text's closing characters, punctuation and distance to the width of its field."""
    body = tail.rstrip()
    spaces = len(tail) - len(body)
    lines = body.split("\n")
    last = lines[-1]
    before = lines[-2] if len(lines) > 1 else None
    tokens = _TOKEN.findall(last)
    word = tokens[-1] if tokens else ""
    previous = tokens[-2] if len(tokens) > 1 else ""
    sentence = re.split(r"(?<=[.!?])\s+", last)[-1]
    words = len(sentence.split())
    near = min((abs(length - spaces - x) for x in limits), default=99)
    exact = min((abs(length - x) for x in limits), default=99)
    at = "at" if exact <= 0 or near <= 0 else "near" if min(near, exact) <= SLACK else "far"
    plain = lambda w: re.sub("[0-9]", "9", w.lower())
    stop = body[-1:] if body[-1:] and not body[-1].isalnum() else "9" if body[-1:].isdigit() else "a"
    head = tokens[0] if tokens else ""
    line_shape = " ".join(_shape(t, 3) for t in tokens[-6:])
    before_shape = "-" if before is None else "_" if not before.strip() else " ".join(_shape(t, 3) for t in before.split()[-3:])
    named = [
        f"end1:{stop}",
        f"end2:{_shape(body[-2:])}",
        f"end3:{_shape(body[-3:])}|{stop}",
        f"raw2:{plain(body[-2:])}",
        f"word:{plain(word[-24:])}",
        f"wshape:{_shape(word)}",
        f"wlen:{min(len(word), 12)}",
        f"two:{_shape(previous, 4)} {_shape(word)}",
        f"prev:{plain(previous[-24:])}",
        f"head:{plain(head[:24])}|{stop}",
        f"head2:{plain(' '.join(tokens[:2])[:32])}",
        f"line:{line_shape}",
        f"lines:{before_shape}/{line_shape}",
        f"before:{before_shape}|{stop}",
        f"count:{min(len(tokens), 15)}|{stop}",
        f"sentence:{min(words, 20)}|{stop}",
        f"open:{sentence.count('(') - sentence.count(')')}|{sentence.count(chr(34)) % 2}",
        f"at:{at}",
        f"at:{at}|{stop}",
        f"at:{at}|{stop}|{before_shape == '_'}|{min(len(tokens), 6)}",
        f"spaces:{min(spaces, 3)}|{stop}",
        f"lower:{word[:1].islower()}|{stop}|{before_shape == '_'}",
        f"blank:{before_shape == '_'}|{min(len(tokens), 8)}|{_shape(word, 4)}",
    ]
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in named]


def _complete(text: str, at: int) -> bool:
    """Whether the first ``at`` characters show no cut: they end behind a finished sentence or within the number the text ends with."""
    body = text[:at].rstrip()
    if body[-1:].isdigit() and text[at : at + 1] in set("0123456789.,") and "\n" not in text[at:].strip():
        return True
    return not body or body[-1] in ".!?" or body[-2:] in ('."', '?"', '!"', ".)")


def field_widths(docs: DataFrame, *, source: str, text: str, least: int = 5, times: float = 6.0) -> DataFrame:
    """(source, width): lengths at which a source has far more texts than at the lengths around.

    A spike has at least ``least`` texts and ``times`` as many as the 80 neighbouring
    lengths have on average (a neighbour's average counts as 0.5 at least). The counts
    of (source, length) merge on the map side; a null source is a source of its own.
    """
    counts = docs.where(F.col(text).isNotNull()).groupBy(F.coalesce(F.col(source), F.lit("")).alias("source"), F.length(text).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    around = Window.partitionBy("source").orderBy("n").rangeBetween(-40, 40)  # at most one row per length
    mean = (F.sum("c").over(around) - F.col("c")) / F.lit(80.0)
    return counts.withColumn("mean", mean).where((F.col("c") >= least) & (F.col("c") >= times * F.greatest(F.col("mean"), F.lit(0.5)))).select("source", F.col("n").alias("width"))


def _fit(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by AdaGrad over rows of feature numbers; the last weight is the bias."""
    rng = np.random.default_rng(0)
    w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    x = np.concatenate([rows, np.full((len(rows), 1), DIMENSIONS)], axis=1)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // 256)):
            p = 1 / (1 + np.exp(-np.clip(w[x[part]].sum(axis=1), -30, 30)))
            error = (p - labels[part]) * weight[part]
            grad = np.bincount(x[part].ravel(), weights=np.repeat(error, x.shape[1]), minlength=DIMENSIONS + 1)
            touched = np.flatnonzero(grad)
            grad = grad[touched] + decay * w[touched]
            g[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(g[touched])
    return w


def _score(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[rows].sum(axis=1) + w[DIMENSIONS], -30, 30)))


def train(docs: DataFrame, limited: Callable[[DataFrame], DataFrame], *, doc_id: str, source: str, text: str, sample: int = 20_000, cuts: int = 2) -> np.ndarray:
    """Weights from artificial cuts of about ``sample`` texts, those with the smallest hashes of their ids.

    Texts that do not end at a width of their source are taken as intact and give
    one negative each; cutting them at random places, and at a width of their source
    where they are longer, gives the positives. Cuts behind a finished sentence are
    not used. limited adds the widths of a row's source. Each intact text also counts as one that just fills its field. Since some
    of the assumed intact texts were cut in transfer, those that a model of the other
    half calls cut are left out, twice, before the last model is fitted.
    """
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(text).alias("t"), F.xxhash64(F.col(doc_id)).alias("h"))
    share = min(1.0, sample / max(1, docs.select(F.col(doc_id)).count()))
    rows = limited(rows.where(F.pmod(F.col("h"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))).select("limits", "t", "h")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list[int]] = []
            label: list[int] = []
            group: list[int] = []
            for limits, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if any(abs(len(t) - x) <= SLACK or abs(len(t.rstrip()) - x) <= SLACK for x in limits):
                    continue
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                made.append(features(t[-TAIL:], len(t), limits))
                label.append(0)
                group.append(h % 2)
                if limits:  # a whole text may be just as long as its field is wide
                    made.append(features(t[-TAIL:], limits[int(rng.integers(0, len(limits)))], limits))
                    label.append(0)
                    group.append(h % 2)
                places = [int(x) for x in rng.integers(min(40, len(t)), len(t) + 1, cuts)] + [int(x) for x in rng.integers(max(1, len(t) - 60), len(t) + 1, 1)]
                places += [x for x in limits if x < len(t)]
                for at in places:
                    cut = t[:at]
                    if at >= len(t.rstrip()) or _complete(t, at):
                        continue
                    mark = MARKS[int(rng.integers(0, len(MARKS)))]
                    made.append(features((cut + mark)[-TAIL:], at + len(mark), limits))
                    label.append(1)
                    group.append(h % 2)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int32())), pa.array(label, pa.int32()), pa.array(group, pa.int32())], names=["x", "y", "fold"])

    got = rows.mapInArrow(examples, "x array<int>, y int, fold int").toPandas()  # bounded by sample * (cuts + 3 + widths of a source)
    if not (got["y"] == 1).any() or not (got["y"] == 0).any():
        return np.zeros(DIMENSIONS + 1) - 1.0 / 64
    x, y = np.array(got["x"].tolist(), dtype=np.int64), got["y"].to_numpy().astype(float)
    fold = got["fold"].to_numpy()
    weight = np.where(y == 1, max(0.5, 0.5 * (y == 0).sum() / (y == 1).sum()), 1.0)
    kept = np.ones(len(y), dtype=bool)
    for _ in range(2):  # each half is judged by a model of the other
        scores = np.zeros(len(y))
        for f in (0, 1):
            inside = kept & (fold != f)
            if inside.any():
                scores[fold == f] = _score(_fit(x[inside], y[inside], weight[inside], epochs=4), x[fold == f])
        kept = (y == 1) | (scores < 0.5)
    return _fit(x[kept], y[kept], weight[kept])


def truncated_texts(docs: DataFrame, *, doc_id: str, source: str, text: str, sample: int = 20_000) -> DataFrame:
    """(doc_id, source, score, cut) for every row with a text: the probability that its end is lost.

    cut is score >= 0.5. Method: field_widths finds the widths at which a source cuts;
    train fits a hashed logistic regression on artificially cut texts of a bounded
    sample; then every text is scored in one pass without a shuffle. Nothing depends
    on the corpus size but the sample's share of it.

    Defined results: null texts give no row; an empty or blank text is not cut and
    scores 0; a null source is a source of its own; equal texts of one source score
    alike; where no text can be learned from (none longer than a few characters) nothing
    is called cut; other columns are ignored, whatever their names.
    """
    limits: list[DataFrame] = []

    def limited(rows: DataFrame) -> DataFrame:
        if not limits:
            known = field_widths(docs, source=source, text=text).groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list("width")).alias("limits"))
            limits.append(checkpointed(known))
        few = limits[0].count() <= BROADCAST_SOURCES
        joined = rows.join(F.broadcast(limits[0]), "s", "left") if few else salted_join(rows, limits[0], ["s"], "left")
        return joined.withColumn("limits", F.coalesce("limits", F.array().cast("array<int>")))

    w = train(docs, limited, doc_id=doc_id, source=source, text=text, sample=sample).astype(np.float32)
    kind = dict(docs.dtypes)[doc_id]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails, sizes, fields = (b.column(i).to_pylist() for i in (2, 3, 4))
            x = np.array([features(t, n, widths) for t, n, widths in zip(tails, sizes, fields)], dtype=np.int64).reshape(len(tails), -1)
            p = _score(w, x) if len(tails) else np.zeros(0)
            p = np.where([bool(t.strip()) for t in tails], p, 0.0) if len(tails) else p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], names=["d", "s", "score"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(source).alias("source"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.expr(f"right(`{text}`, {TAIL})").alias("t"), F.length(text).alias("n"))
    return limited(rows).select("d", "source", "t", "n", "limits").mapInArrow(score, f"d {kind}, s string, score double").select(F.col("d").alias(doc_id), F.col("s").alias(source), "score", (F.col("score") >= 0.5).alias("cut"))
