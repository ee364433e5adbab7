"""Guarded read-only SQL over registered views."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_WORDS = ("select", "with", "explain")
MOST_ROWS, SECONDS = 1000, 15
#: Kinds of plan nodes that do more than read.
WRITING = ("Command", "ParsedStatement", "ScriptTransformation")
#: Functions that call any method of the JVM.
CALLS = r"\b(try_)?(reflect|java_method)\("


def guarded(sql: str) -> str:
    """The statement without outer blanks; ValueError for anything but a single read."""
    text = sql.strip()
    word = re.match(r"[A-Za-z]*", text).group(0).lower()
    if word not in FIRST_WORDS:
        raise ValueError("only SELECT, WITH and EXPLAIN are allowed")
    if ";" in text:
        raise ValueError("only one statement without semicolons is allowed")
    if re.match(r"explain\s+analy[sz]e\b", text, re.I):
        raise ValueError("EXPLAIN ANALYZE is not allowed")
    return text


def _walk(node) -> Iterator:
    """A JVM plan's nodes, those of its common table expressions and subqueries included."""
    yield node
    for part in (node.children(), node.innerChildren(), node.subqueries()):
        for i in range(part.size()):
            yield from _walk(part.apply(i))


def is_read(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed, not yet executed, statement only reads.

    The session's own parser gives the tree; Spark runs commands as soon as they are
    analysed, so the tree is looked at before spark.sql sees the text. No node of it
    may be a command, an insert or any other statement, start a script, or call into
    the JVM by name. Of EXPLAIN the explained statement is judged.
    """
    sc = spark.sparkContext
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if plan.getClass().getSimpleName() == "ExplainCommand":
        plan = plan.logicalPlan()
    classes = [sc._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in WRITING]
    for node in _walk(plan):
        if any(c.isInstance(node) for c in classes):
            return False
        if re.search(CALLS, node.expressions().toString(), re.I):
            return False
    return True


def run_sql(spark: SparkSession, sql: str, row_limit: int = 200, seconds: float = SECONDS) -> dict:
    """{columns, rows, truncated} or {error}; one row more than the limit is read to tell whether more exist.

    Only statements that read are handed to Spark (see is_read). A job that runs too
    long is cancelled by its tag.
    """
    limit = max(1, min(MOST_ROWS, int(row_limit)))
    sc, tag = spark.sparkContext, f"gate-{uuid.uuid4()}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    try:
        text = guarded(sql)
        if not is_read(spark, text):
            raise ValueError("only queries are allowed")
        df = spark.sql(text)
        sc.addJobTag(tag)
        timer.start()
        rows = df.limit(limit + 1).collect()
        return {"columns": df.columns, "rows": [serialised(r.asDict()) for r in rows[:limit]], "truncated": len(rows) > limit}
    except Exception as e:
        return {"error": str(e).strip().split("\n")[0]}
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def serialised(row: dict) -> dict:
    """Decimals as floats and dates as ISO text."""
    return {k: float(v) if type(v).__name__ == "Decimal" else v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.items()}


def describe_table(df: DataFrame, name: str, notes: dict[str, str] | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type, note, row_count) of a table whose name is a plain identifier.

    row_count is exact: for Parquet it comes from the footers, without reading rows.
    """
    if not re.fullmatch(r"[a-z0-9_]+", name):
        raise ValueError("not a table name")
    rows = [(name, i, f.name, f.dataType.simpleString(), (notes or {}).get(f.name)) for i, f in enumerate(df.schema.fields, 1)]
    columns = df.sparkSession.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, note string")
    return columns.select("*", df.agg(F.count(F.lit(1))).scalar().alias("row_count"))


def documentation(queries: dict, title: str = "Queries") -> str:
    """Markdown that lists queries by name with the first line of what is said of each."""
    lines = [f"# {title}", ""]
    for name in sorted(queries):
        said = (getattr(queries[name], "__doc__", None) or "").strip().split("\n")[0]
        lines.append(f"* `{name}`" + (f": {said}" if said else ""))
    return "\n".join(lines) + "\n"
