"""Declarative rules that turn rows into violations or set them aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(column: str) -> tuple[str, Column]:
    """A rule: the column must hold a value."""
    return f"{column} required", F.col(column).isNotNull()


def one_of(column: str, values: Sequence[object]) -> tuple[str, Column]:
    """A rule: the column must hold one of the values; null is left to `required`."""
    return f"{column} in domain", F.col(column).isin(*values) | F.col(column).isNull()


def violations(rows: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, rule) for each rule that a row breaks, in one pass. A rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    return rows.select(*key, F.explode(broken).alias("rule"))


def set_aside(rows: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the others with the reason: one bad item does not stop a job."""
    good = F.coalesce(ok, F.lit(False))
    return rows.filter(good), rows.filter(~good).withColumn("reason", F.lit(reason))
