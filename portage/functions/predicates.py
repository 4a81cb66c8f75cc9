"""Typed per-column filters: which operators a type allows, and the predicate they build."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operators offered for each class of column.
ORDERED_OPERATORS = ["=", "!=", ">", "<", ">=", "<=", "BETWEEN"]
TEXT_OPERATORS = ["LIKE", "NOT LIKE"]

# Database type names in each class, without length or precision.
ORDERED_TYPE_NAMES = ["NUMBER", "INTEGER", "LONG", "FLOAT", "DATE", "TIMESTAMP", "RAW"]
TEXT_TYPE_NAMES = ["VARCHAR", "VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR"]

_ORDERED_SPARK_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


class FilterError(ValueError):
    """A filter that does not fit its column; raised before any job starts."""


@dataclass(frozen=True)
class ColumnFilter:
    """One condition. ``op`` None leaves the column unfiltered; ``hi`` is the upper bound of BETWEEN."""

    column: str
    op: str | None
    lo: object = None
    hi: object = None


def operators_for_type(data_type: T.DataType) -> list[str]:
    if isinstance(data_type, _ORDERED_SPARK_TYPES):
        return list(ORDERED_OPERATORS)
    if isinstance(data_type, T.StringType):
        return list(TEXT_OPERATORS)
    return []


def operators_for_type_name(type_name: Column) -> Column:
    """Comma list of the operators a database type name allows, null for types that allow none."""
    base = F.upper(F.trim(F.regexp_replace(type_name, r"\(.*$", "")))
    return (
        F.when(base.isin(ORDERED_TYPE_NAMES), F.lit(",".join(ORDERED_OPERATORS)))
        .when(base.isin(TEXT_TYPE_NAMES), F.lit(",".join(TEXT_OPERATORS)))
    )


def allowed_operators(columns: DataFrame) -> DataFrame:
    """Operators offered for each row of a column catalog."""
    return columns.select(
        "owner", "table_name", "column_name", "data_type",
        operators_for_type_name(F.col("data_type")).alias("operators"),
    )


def typed_literal(df: DataFrame, value: object, data_type: T.DataType) -> Column:
    """``value`` as a literal to compare a column with. A value that does not parse raises here, not in a job.

    It has the column's type where that holds it exactly. A number that the type would round or cut, such as 45.7 for a
    whole-number column, and a point in time for a date column stay as they are, and the comparison is made in the wider
    type. The value is bound, never spliced into SQL text, so it may hold blanks and quotes.
    """
    if value is None:
        raise FilterError("a filter needs a value")
    kind = data_type.simpleString()
    wider = "timestamp_ntz" if isinstance(data_type, T.DateType) else None
    if isinstance(data_type, (T.IntegralType, T.DecimalType)):
        wider = "decimal(38,18)"
    wide = f"try_cast(:value AS {wider})" if wider else "null"
    same = f"try_cast(:value AS {kind}) = {wide}" if wider else "true"
    # A one-row relation: the optimizer folds the casts, no task runs.
    check = df.sparkSession.sql(
        f"SELECT try_cast(:value AS {kind}) AS own, {wide} AS wide, {same} AS same", args={"value": value}
    ).first()
    if check["wide"] is not None and check["same"] is not True:
        return F.lit(check["wide"]).cast(wider)
    if check["own"] is None:
        raise FilterError(f"{value!r} is no {data_type.simpleString()}")
    return F.lit(value).cast(data_type)


def predicate(df: DataFrame, item: ColumnFilter) -> Column | None:
    """The condition as a column over ``df``, or None when the column is unfiltered."""
    if item.op is None:
        return None
    field = next((f for f in df.schema.fields if f.name == item.column), None)
    if field is None:
        raise FilterError(f"no column {item.column!r}")
    op = item.op.upper()
    # Equality on text is the ordinary filter of a status column, so it is allowed for both classes.
    allowed = operators_for_type(field.dataType)
    if isinstance(field.dataType, T.StringType):
        allowed = allowed + ["=", "!="]
    if op not in allowed:
        raise FilterError(f"{op} does not apply to {item.column} {field.dataType.simpleString()}")
    column = F.col(f"`{item.column}`")
    if op in ("LIKE", "NOT LIKE"):
        matches = column.like(str(item.lo))
        return matches if op == "LIKE" else ~matches
    low = typed_literal(df, item.lo, field.dataType)
    if op == "BETWEEN":
        return column.between(low, typed_literal(df, item.hi, field.dataType))
    return {
        "=": column == low, "!=": column != low, ">": column > low,
        "<": column < low, ">=": column >= low, "<=": column <= low,
    }[op]


def conjunction(df: DataFrame, items: Iterable[ColumnFilter]) -> Column | None:
    """All conditions joined by AND; None when no column is filtered."""
    parts = [p for p in (predicate(df, item) for item in items) if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, items: Iterable[ColumnFilter]) -> DataFrame:
    condition = conjunction(df, items)
    return df if condition is None else df.where(condition)


def preview(df: DataFrame, items: Iterable[ColumnFilter], order_by: list[str], n: int) -> DataFrame:
    """First ``n`` rows of the filtered table, by the very predicate the extraction uses."""
    return apply_filters(df, items).orderBy(*order_by).limit(n)
