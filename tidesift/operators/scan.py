"""Scans and projections. Pruning and pushdown are Catalyst's: these only keep the plan declarative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, *paths: str, select: Sequence[str | Column] = ("*",), where: str | Column | None = None,
         sort_by: Sequence[str] = ()) -> DataFrame:
    """Columns of Parquet files for which a predicate holds, sorted within partitions if asked to.

    Several paths are one relation, as outputs of an earlier step are. ``select`` takes names, columns and SQL expressions.
    """
    df = spark.read.parquet(*paths)
    if where is not None:
        df = df.where(where)
    df = df.select(*(F.expr(c) if isinstance(c, str) else c for c in select))
    return df.sortWithinPartitions(*sort_by) if sort_by else df


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, with a relation's schema."""
    return df.limit(0)


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that a plan reads from each of its Parquet scans: what pruning left of the schema."""
    import re

    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [[c.split(":")[0] for c in m.split(",") if c] for m in re.findall(r"ReadSchema: struct<([^\n]*)>", text)]


def referenced_columns(spark: SparkSession, select: str, table_columns: Sequence[str], also: Sequence[str] = ()) -> list[str] | None:
    """Columns of a table that ``SELECT ... FROM _t ...`` refers to, plus ``also``; None if all are or the text can't be parsed."""
    import re

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(select).toString()
    except Exception:  # noqa: BLE001  the parser's errors have no common Python class
        return None
    if re.search(r"^'?Project \[\*|\bunresolvedstar\(", plan, re.I):
        return None
    names = set(re.findall(r"'(?:`?\w+`?\.)?`?(\w+)`?", plan))
    return [c for c in table_columns if c in names or c in also]
