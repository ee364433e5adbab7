"""Delimited lines taken apart by structural indexing; misfits get a reason."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English month abbreviations as dates spell them.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
#: Most layout rows that are accepted as a driver-side description.
MAX_LAYOUT_ROWS = 100_000

INT = r"^-?[0-9]{1,9}$"
DECIMAL = r"^-?[0-9]{1,10}(\.[0-9]{1,2})?$"


@dataclass(frozen=True)
class Layout:
    """How the lines of one table are written."""

    delimiter: str
    quote: str | None
    names: tuple[str, ...]
    types: tuple[str, ...]
    formats: tuple[str | None, ...]
    required: tuple[bool, ...]


def read_layouts(columns: DataFrame) -> dict[str, Layout]:
    """The layouts in a table like file_columns, by table name. A bounded description, not data."""
    rows = columns.select("table_name", "delimiter", "quote_char", "col_no", "column_name", "value_type", "date_format", "is_required").limit(MAX_LAYOUT_ROWS + 1).collect()
    if len(rows) > MAX_LAYOUT_ROWS:
        raise ValueError("the layout table is no layout table")
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["table_name"], r["col_no"])):
        found.setdefault(r["table_name"], []).append(r)
    return {
        t: Layout(
            rs[0]["delimiter"],
            rs[0]["quote_char"] or None,
            *(tuple(r[c] for r in rs) for c in ("column_name", "value_type", "date_format")),
            tuple(bool(r["is_required"]) for r in rs),
        )
        for t, rs in found.items()
    }


def structural_index(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, delimiter: int, quote: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of field-ending delimiters, their record, mask of records with wrong quoting).

    data holds all records' bytes, record i in data[starts[i]:ends[i]]. A prefix sum
    over the quote mask gives every byte's parity within its record; delimiters at
    even parity are structural. Quoting is right when every quote at even parity
    stands at a field's start or closes a doubled pair, every quote at odd parity is
    followed by a delimiter, a quote or the record's end, and the last parity is even.
    """
    n = len(starts)
    owner = np.repeat(np.arange(n), ends - starts)  # records lie next to each other
    wrong = np.zeros(n, dtype=bool)
    is_delimiter = data == delimiter
    if quote is None:
        at = np.flatnonzero(is_delimiter)
        return at, owner[at], wrong
    quotes = data == quote
    upto = np.concatenate([[0], np.cumsum(quotes)])
    odd = ((upto[:-1] - np.repeat(upto[starts], ends - starts)) & 1).astype(bool)  # parity before the byte
    wrong |= ((upto[ends] - upto[starts]) & 1).astype(bool)
    q = np.flatnonzero(quotes)
    if len(q):
        first, last = q == starts[owner[q]], q + 1 == ends[owner[q]]
        before, after = data[np.maximum(q - 1, 0)], data[np.minimum(q + 1, len(data) - 1)]
        opens_well = first | (before == delimiter) | (before == quote)
        closes_well = last | (after == delimiter) | (after == quote)
        bad = np.where(odd[q], ~closes_well, ~opens_well)
        wrong[owner[q[bad]]] = True
    at = np.flatnonzero(is_delimiter & ~odd)
    return at, owner[at], wrong


def record_ends(data: np.ndarray, quote: int | None) -> np.ndarray:
    """Positions of the line feeds in a block of text that end a record, i.e. lie outside quotes."""
    feeds = data == 10
    if quote is not None:
        feeds &= (np.cumsum(data == quote) & 1) == 0
    return np.flatnonzero(feeds)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array, gathered without a loop."""
    sizes = end - begin
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    gather = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[gather].tobytes()))


def date_parser(pattern: str):
    """A function from text to date or None for exactly this pattern.

    yyyy and yy take four and two digits (yy within 2000-2099), MM and dd two, M and
    d one or two, MMM a month's English abbreviation in any case; all else stands
    for itself.
    """
    parts = re.findall(r"yyyy|yy|MMM|MM|M|dd|d|.", pattern, re.S)
    forms = {"yyyy": "(?P<y>[0-9]{4})", "yy": "(?P<y>[0-9]{2})", "MMM": "(?P<b>[A-Za-z]{3})", "MM": "(?P<m>[0-9]{2})", "M": "(?P<m>[0-9]{1,2})", "dd": "(?P<d>[0-9]{2})", "d": "(?P<d>[0-9]{1,2})"}
    exact = re.compile("".join(forms.get(p, re.escape(p)) for p in parts))
    short = "yy" in parts

    def parse(text: str) -> datetime.date | None:
        m = exact.fullmatch(text)
        if not m:
            return None
        g = m.groupdict()
        if g.get("b"):
            if g["b"].upper() not in MONTHS:
                return None
            month = MONTHS.index(g["b"].upper()) + 1
        else:
            month = int(g.get("m") or 1)
        try:
            return datetime.date(int(g["y"]) + 2000 * short, month, int(g.get("d") or 1))
        except ValueError:
            return None

    return parse


def _check_column(values: pa.Array, kind: str, pattern: str | None, required: bool) -> tuple[np.ndarray, pa.Array]:
    """(mask of bad values, values in canonical text, null where empty)."""
    trimmed = pc.utf8_trim(values, characters=" ")
    empty = pc.equal(trimmed, "")
    good = pa.array(np.ones(len(values), dtype=bool))
    if kind == "int":
        good = pc.match_substring_regex(trimmed, INT)
    elif kind == "decimal":
        good = pc.match_substring_regex(trimmed, DECIMAL)
    elif kind == "date":
        parse = date_parser(pattern or "yyyy-MM-dd")
        coded = pc.dictionary_encode(trimmed)
        dates = [parse(x) for x in coded.dictionary.to_pylist()]  # each spelling once
        iso = pa.array([d and d.isoformat() for d in dates], pa.large_string())
        dated = iso.take(coded.indices)
        good, trimmed = pc.is_valid(dated), pc.if_else(empty, trimmed, pc.coalesce(dated, trimmed))
    bad = pc.if_else(empty, pa.scalar(required), pc.invert(good))
    text = trimmed if kind != "text" else values
    return bad.to_numpy(zero_copy_only=False), pc.if_else(empty, pa.scalar(None, pa.large_string()), text)


def parse_lines(lines: pa.Array, layout: Layout) -> tuple[list[str | None], list[list[str | None] | None]]:
    """(reason or None, fields or None) for each line of one layout."""
    reason, fields = parse_batch(lines, layout)
    return reason.tolist(), fields.to_pylist()


def parse_batch(lines: pa.Array, layout: Layout) -> tuple[np.ndarray, pa.ListArray]:
    """parse_lines on Arrow buffers: reasons as an object array, fields as a list array that is null where there is a reason."""
    n, width = len(lines), len(layout.names)
    reason = np.full(n, None, dtype=object)
    reason[np.asarray(pc.is_null(lines))] = "column_count"
    kept = np.flatnonzero(np.asarray(pc.is_valid(lines)))
    none = pa.nulls(n, pa.list_(pa.string()))
    if not len(kept):
        return reason, none
    lines = pa.concat_arrays([lines.cast(pa.large_string()).drop_null()])
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    quote = ord(layout.quote) if layout.quote else None
    at, owner, wrong = structural_index(data, starts, ends, ord(layout.delimiter), quote)
    counts = np.bincount(owner, minlength=len(kept)) + 1
    reason[kept[wrong]] = "quoting"
    miscounted = ~wrong & (counts != width)
    reason[kept[miscounted]] = "column_count"
    fit = np.flatnonzero(~wrong & ~miscounted)
    if not len(fit):
        return reason, none
    inner = at[np.isin(owner, fit)].reshape(len(fit), width - 1)
    edges = np.concatenate([starts[fit, None] - 1, inner, ends[fit, None]], axis=1)
    bad = np.zeros(len(fit), dtype=bool)
    columns = []
    padded = data if len(data) else np.zeros(1, dtype=np.uint8)
    for j, (kind, pattern, required) in enumerate(zip(layout.types, layout.formats, layout.required)):
        begin, end = edges[:, j] + 1, edges[:, j + 1].copy()
        if quote is not None:
            quoted = (end > begin) & (padded[np.minimum(begin, len(padded) - 1)] == quote)
            begin, end = begin + quoted, end - quoted
        values = _strings(data, begin, end)
        if quote is not None:
            values = pc.replace_substring(values, layout.quote * 2, layout.quote)
        wrong_value, values = _check_column(values, kind, pattern, required)
        bad |= wrong_value
        columns.append(values.cast(pa.string()))
    reason[kept[fit[bad]]] = "invalid_value"
    good = np.flatnonzero(~bad)
    # row by row: value j of fitting row i lies at j * rows + i
    order = (np.arange(width)[None, :] * len(fit) + good[:, None]).ravel()
    sizes = np.zeros(n + 1, dtype=np.int32)
    sizes[kept[fit[good]] + 1] = width
    absent = np.ones(n, dtype=bool)
    absent[kept[fit[good]]] = False
    flat = pa.concat_arrays(columns).take(pa.array(order))
    return reason, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), flat, mask=pa.array(absent))


def parse_rows(df: DataFrame, layouts: dict[str, Layout], *, id_col: str, table_col: str, line_col: str, keep: list[str] = ()) -> DataFrame:
    """(id, table, *keep, reason, fields) for each row of df; one scan, no shuffle.

    reason is null for a line that fits its layout, else the first of quoting,
    column_count and invalid_value that applies; fields holds the values of a
    fitting line as text (numbers trimmed, dates as yyyy-MM-dd, empty ones null).
    typed_rows turns them into typed columns.

    Method: the lines of a batch lie in one byte buffer; numpy masks of quotes and
    delimiters with prefix parity give the structural positions of all lines at
    once, and whole columns are type-checked by Arrow kernels.

    Defined results: a null line or one whose table has no layout has the wrong
    column count; an empty line is a single empty field; repeated rows stay
    repeated; other columns are ignored, whatever their names.
    """
    names = [id_col, table_col, *keep]
    types = dict(df.dtypes)
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(line_col).cast("string").alias("line"))
    schema = ", ".join([f"c{i} {types[c]}" for i, c in enumerate(names)] + ["reason string", "fields array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = b.column(1).cast(pa.large_string())
            reason = np.full(b.num_rows, "column_count", dtype=object)
            place = np.full(b.num_rows, -1, dtype=np.int64)  # of a row among the parsed ones
            parts, parsed_rows = [], 0
            for t in pc.unique(tables.drop_null()).to_pylist():
                if t in layouts:
                    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(tables, t), False)))
                    reason[at], fields = parse_batch(b.column(b.num_columns - 1).take(pa.array(at)), layouts[t])
                    place[at] = parsed_rows + np.arange(len(at))
                    parts.append(fields)
                    parsed_rows += len(at)
            fields = pa.concat_arrays(parts).take(pa.array(place, mask=place < 0)) if parts else pa.nulls(b.num_rows, pa.list_(pa.string()))
            out = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(reason, pa.string()), fields]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(names))] + ["reason", "fields"])

    parsed = rows.mapInArrow(run, schema)
    return parsed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "reason", "fields")


def typed_rows(parsed: DataFrame, table_name: str, layout: Layout, table_col: str, keep: list[str]) -> DataFrame:
    """The fitting lines of one table as typed columns after the keep columns."""

    def typed(i: int, kind: str) -> Column:
        c = F.col("fields")[i]
        return {"int": c.cast("int"), "decimal": c.cast("decimal(12,2)"), "date": c.cast("date").cast("timestamp_ntz")}.get(kind, c)

    return parsed.where((F.col(table_col) == table_name) & F.col("reason").isNull()).select(*keep, *[typed(i, k).alias(n) for i, (n, k) in enumerate(zip(layout.names, layout.types))])


def split_records(data: bytes, quote: str | None) -> list[str]:
    """The records of a text, which line feeds outside quotes end; a carriage return before one is dropped, empty records are left out.

    Where the quotes of the text do not come in pairs, the parity says nothing from the
    first odd one on: such a text is split at every line feed, so that one broken quote
    costs its own record and not the rest of the file.
    """
    block = np.frombuffer(data, dtype=np.uint8)
    q = ord(quote) if quote else None
    if q is not None and int((block == q).sum()) % 2:
        q = None
    ends = record_ends(block, q)
    starts = np.concatenate([[0], ends + 1])
    parts = (data[a:b] for a, b in zip(starts, np.concatenate([ends, [len(data)]])))
    return [t for p in parts if (t := p.removesuffix(b"\r").decode(errors="replace")).strip()]


def read_quoted_files(spark: SparkSession, paths: str | Sequence[str], layouts: dict[str, Layout], table_of: Column) -> DataFrame:
    """(source_file, table_name, line_no, row_data) of delimited files whose quoted fields may hold line feeds; parse_rows does the rest.

    table_of says from source_file which layout a file has; files of other tables are
    split at every line feed. A file is one task's work, as a quote that opens in one
    part of it may close in any other; its size is bounded by what an executor holds.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("source_file"), "content")
    rows = files.select("source_file", table_of.alias("table_name"), "content")
    quotes = {t: l.quote for t, l in layouts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, t, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                lines = split_records(c, quotes.get(t))
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(lines), pa.string()), pa.array([t] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], names=["source_file", "table_name", "line_no", "row_data"])

    return rows.mapInArrow(run, "source_file string, table_name string, line_no long, row_data string")
