"""Rules on columns, checked by one expression per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind is required, numeric, date, enum, length or cross_field; low and high bound numbers and lengths.

    The values of a cross_field rule are a comparison (= <> < <= > >=) and the column it
    is made with; a null on either side breaks nothing.
    """

    column: str
    kind: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    pattern: str = "yyyy-MM-dd"

    def message(self) -> Column:
        """A message where the rule is broken, else null. Blank values break only ``required``."""
        c = F.col(self.column).cast("string")
        blank = F.coalesce(F.trim(c) == "", F.lit(True))
        if self.kind == "required":
            return F.when(blank, f"{self.column}: required")
        if self.kind == "cross_field":
            sign, other = self.values
            left, right = F.col(self.column), F.col(other)
            holds = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]
            return F.when(~blank & ~holds, f"{self.column}: not {sign} {other}")
        if self.kind == "enum":
            broken = ~c.isin(list(self.values))
        elif self.kind == "date":
            broken = F.try_to_timestamp(F.trim(c), F.lit(self.pattern)).isNull()
        else:
            n = F.length(c).cast("double") if self.kind == "length" else F.trim(c).try_cast("double")
            broken = n.isNull()
            if self.low is not None:
                broken = broken | (n < self.low)
            if self.high is not None:
                broken = broken | (n > self.high)
        return F.when(~blank & broken, f"{self.column}: not a valid {self.kind}")


def validated(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with _validation_errors, an array of messages (empty for good rows)."""
    return df.withColumn("_validation_errors", F.array_compact(F.array(*[r.message() for r in rules])) if rules else F.array().cast("array<string>"))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their messages)."""
    checked = validated(df, rules)
    return checked.where(F.size("_validation_errors") == 0).drop("_validation_errors"), checked.where(F.size("_validation_errors") > 0)
