"""Object names, column names, key lists and SQL literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case all column names; two names that differ only by case are an error."""
    lowered = [name.lower() for name in df.columns]
    clashes = sorted({name for name in lowered if lowered.count(name) > 1})
    if clashes:
        raise ValueError(f"column names clash once lower-cased: {', '.join(clashes)}")
    return df.toDF(*lowered)


def normalise_name(name: Column, target_schema: str) -> Column:
    """Bare lower-case object name; null when the name is qualified by a foreign schema."""
    parts = F.split(name, r"\.")

    def bare(part: Column) -> Column:
        return F.lower(F.regexp_replace(part, '^"|"$', ""))

    last = bare(F.element_at(parts, -1))
    schema = bare(F.element_at(parts, 1))
    return F.when(F.size(parts) == 1, last).when(schema.isin(target_schema.lower(), "public"), last)


def key_list(columns: Column) -> Column:
    """An array of column names rendered as ``(a,b,c)``, lower case."""
    return F.concat(F.lit("("), F.lower(F.array_join(columns, ",")), F.lit(")"))


def sql_literal(column: Column, data_type: T.DataType) -> Column:
    """The value as an SQL literal: quotes doubled, NULL bare, binary as hex, timestamps and arrays typed."""
    text = column.cast("string")
    if isinstance(data_type, T.StringType):
        rendered = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        kind = "DOUBLE PRECISION" if isinstance(data_type, T.DoubleType) else "REAL"
        special = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
        rendered = F.when(special, F.concat(F.lit("CAST('"), text, F.lit(f"' AS {kind})"))).otherwise(text)
    elif isinstance(data_type, T.NumericType):
        rendered = text
    elif isinstance(data_type, T.BooleanType):
        rendered = F.upper(text)
    elif isinstance(data_type, T.BinaryType):
        rendered = F.concat(F.lit("'\\x"), F.lower(F.hex(column)), F.lit("'"))
    elif isinstance(data_type, T.DateType):
        rendered = F.concat(F.lit("DATE '"), text, F.lit("'"))
    elif isinstance(data_type, T.TimestampNTZType):
        rendered = F.concat(F.lit("TIMESTAMP '"), text, F.lit("'"))
    elif isinstance(data_type, T.TimestampType):
        # A point in time: without its offset it would be read in the zone of whoever runs the script.
        rendered = F.concat(F.lit("TIMESTAMPTZ '"), F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"), F.lit("'"))
    elif isinstance(data_type, T.ArrayType):
        inner = F.array_join(F.transform(column, lambda x: sql_literal(x, data_type.elementType)), ", ")
        rendered = F.concat(F.lit("CAST(ARRAY["), inner, F.lit(f"] AS {sql_type(data_type)})"))
    else:
        raise ValueError(f"no SQL literal for {data_type.simpleString()}")
    return F.coalesce(rendered, F.lit("NULL"))


def sql_type(data_type: T.DataType) -> str:
    """Column type in the emitted DDL."""
    # Target type names.
    plain = {
        T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
        T.FloatType: "REAL", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.StringType: "VARCHAR",
        T.BinaryType: "BYTEA", T.DateType: "DATE", T.TimestampType: "TIMESTAMPTZ", T.TimestampNTZType: "TIMESTAMP",
    }
    if isinstance(data_type, T.DecimalType):
        return f"NUMERIC({data_type.precision},{data_type.scale})"
    if isinstance(data_type, T.ArrayType):
        return f"{sql_type(data_type.elementType)}[]"
    for kind, name in plain.items():
        if isinstance(data_type, kind):
            return name
    raise ValueError(f"no SQL type for {data_type.simpleString()}")
