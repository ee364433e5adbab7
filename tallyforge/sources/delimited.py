"""Delimited text without quoting, read exactly as its writers mean it, and typed by a declared schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The forms in which dates arrive, in the order in which they are tried.
DATE_FORMS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "yyyy-MM-dd", "MMddyyyy"]


@dataclass(frozen=True)
class TableSpec:
    """A table's columns with their kinds (text, int, long, decimal, date), keys and required columns."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    delimiter: str = "\t"
    header: bool = True
    constants: dict = field(default_factory=dict)


def split_lines(lines: DataFrame, delimiter: str, width: int) -> DataFrame:
    """(file, cells): NULs dropped, one trailing CR dropped, blank lines left out, surplus fields joined to the last,
    missing ones null, blank ones null, malformed UTF-8 as U+FFFD. lines has file and value."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("value")), "\\x00", "")
    text = F.regexp_replace(text, "\\r$", "")
    cells = F.split(text, "\\Q" + delimiter + "\\E", width)
    blank = lambda c: F.when(~c.rlike("^(?U)\\s*$"), c)
    padded = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: blank(F.get(cells, i)))
    return lines.where(~text.rlike("^(?U)\\s*$")).select("file", padded.alias("cells"))


def plain_path(c: Column) -> Column:
    """Local paths in one form: readers write file:/x or file:///x for the same file."""
    return F.regexp_replace(c, "^file:/+", "/")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, value) of text files; only line feeds end a line, so that a lone CR stays in its field."""
    return spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths)).select(plain_path(F.input_file_name()).alias("file"), "value")


def coerced(c: Column, kind: str) -> Column:
    """A text cell as its kind, null where it does not fit."""
    if kind == "decimal":
        return F.trim(c).try_cast("decimal(12,2)")
    if kind == "int":
        return F.trim(c).try_cast("double").try_cast("int")
    if kind == "long":
        return F.trim(c).try_cast("double").try_cast("long")
    if kind == "date":
        return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMS]).cast("timestamp_ntz")
    return c


def short_date(c: Column) -> Column:
    """dd-MMM-yy with years 69-99 in the last century, as the writers of these files count."""
    d = F.try_to_timestamp(F.initcap(F.lower(F.trim(c))), F.lit("dd-MMM-yy")).cast("date")
    return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)


def judged_lines(spark: SparkSession, paths: str | Sequence[str], spec: TableSpec, row_filter: Column | None = None) -> DataFrame:
    """(file, at, cells, error, skip, the typed columns): every line of all files, by one reader.

    A header line, recognised by carrying the first column's name, is bound by
    position after lower-casing; it is dropped wherever a file starts with one. A
    value that overflows its decimal is an error of its row; any other misfit becomes
    null. skip marks rows without error that lack a required column or that
    row_filter, a condition on the typed columns, does not hold for. at grows within
    a file.
    """
    return _judged(split_lines(read_lines(spark, paths), spec.delimiter, len(spec.columns)), spec, row_filter)


def _judged(cells: DataFrame, spec: TableSpec, row_filter: Column | None) -> DataFrame:
    names = [n for n, _ in spec.columns]
    if spec.header:
        cells = cells.where(~F.coalesce(F.lower(F.trim(F.col("cells")[0])) == names[0], F.lit(False)))
    get = {n: F.col("cells")[i] for i, n in enumerate(names)}
    kinds = dict(spec.columns)
    overflow = F.lit(False)
    for n, k in spec.columns:
        if k == "decimal":
            wide = F.trim(get[n]).try_cast("decimal(38,10)")
            overflow = overflow | (wide.isNotNull() & wide.try_cast("decimal(12,2)").isNull())
    missing = F.lit(False)
    for n in spec.required:
        missing = missing | coerced(get[n], kinds[n]).isNull()
    kept = [n for n in names if n not in spec.skipped]
    error = F.when(F.coalesce(overflow, F.lit(False)), "numeric overflow")
    rows = cells.select("file", F.monotonically_increasing_id().alias("at"), "cells", error.alias("error"), missing.alias("skip"), *[coerced(get[n], kinds[n]).alias(n) for n in kept], *[F.lit(v).alias(c) for c, v in spec.constants.items() if c not in names])
    return rows.withColumn("skip", F.col("error").isNull() & (F.col("skip") if row_filter is None else F.col("skip") | ~F.coalesce(row_filter, F.lit(False))))


def rows_of(judged: DataFrame) -> DataFrame:
    """The typed rows that are neither in error nor skipped, with file and at."""
    return judged.where("error is null and not skip").drop("cells", "error", "skip")


def rejects_of(judged: DataFrame) -> DataFrame:
    """(file, cells, error) of the rows in error."""
    return judged.where("error is not null").select("file", "cells", "error")


def read_delimited(spark: SparkSession, paths: str | Sequence[str], spec: TableSpec, row_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files; see judged_lines. Skipped rows are in neither."""
    judged = judged_lines(spark, paths, spec, row_filter)
    return rows_of(judged).drop("at"), rejects_of(judged)


def read_text(spark: SparkSession, text: str | bytes, spec: TableSpec, row_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a text in memory, by the same rules as files; its file is ''."""
    data = text.encode() if isinstance(text, str) else text
    lines = spark.createDataFrame([("", bytearray(x)) for x in data.split(b"\n")], "file string, value binary")
    judged = _judged(split_lines(lines, spec.delimiter, len(spec.columns)), spec, row_filter)
    return rows_of(judged).drop("at"), rejects_of(judged)


def hinted(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """df with text columns read as bool, float or int where every value fits; where one does not, the column stays text.

    A column has one type here, so that a value that does not fit cannot stay beside
    typed ones. One pass counts the misfits of all hinted columns.
    """
    typed = {c: F.lower(F.trim(c)).isin("true", "1", "yes") if k == "bool" else coerced(F.col(c), {"int": "long"}.get(k, k)) if k == "int" else F.trim(c).try_cast("double") for c, k in hints.items()}
    fits = {c: (F.lower(F.trim(c)).isin("true", "1", "yes", "false", "0", "no")) if hints[c] == "bool" else typed[c].isNotNull() for c in hints}
    misfits = df.agg(*[F.sum(F.when(F.col(c).isNotNull() & ~F.coalesce(fits[c], F.lit(False)), 1).otherwise(0)).alias(c) for c in hints]).first()
    return df.withColumns({c: typed[c] for c in hints if not misfits[c]})


def read_json_pages(spark: SparkSession, path: str, rename: dict[str, str]) -> DataFrame:
    """The results of landed API pages ({"results": [...]}) with renamed fields, blank text as null."""
    pages = spark.read.option("multiLine", True).json(path)
    rows = pages.select(F.explode("results").alias("r"))
    fields = {f.name for f in rows.schema["r"].dataType.fields}
    cell = lambda s: F.when(F.trim(F.col(f"r.{s}").cast("string")) != "", F.col(f"r.{s}").cast("string")) if s in fields else F.lit(None).cast("string")
    return rows.select(*[cell(s).alias(t) for s, t in rename.items()])


def read_csv_with_ids(spark: SparkSession, path: str, rename: dict[str, str], prefix: str, parts: list[str]) -> DataFrame:
    """A comma file with header: renamed columns and a synthetic id of prefix and parts, 'None' for a missing part."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    cols = [(F.col(f"`{have[s.lower()]}`") if s.lower() in have else F.lit(None).cast("string")).alias(t) for s, t in rename.items()]
    df = raw.select(*cols)
    return df.withColumn("sub_id", F.concat_ws(":", F.lit(prefix), *[F.coalesce(F.col(p).cast("string"), F.lit("None")) for p in parts]))
