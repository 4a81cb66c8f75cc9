import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF

from portage.functions.names import key_list, lower_columns, normalise_name, sql_literal
from portage.functions.predicates import ColumnFilter, FilterError, allowed_operators, apply_filters, predicate
from portage.sources.tables import Extraction, extract, filters_from_rows, parquet_table


@pytest.fixture(scope="module")
def amounts(spark):
    return spark.createDataFrame(
        [(1, -5.0, "it's", dt.date(2020, 1, 31)), (2, 0.0, "a b", dt.date(2020, 2, 1)), (3, 7.5, None, None)],
        "id bigint, amount double, note string, day date",
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_between_takes_negatives_and_dates(amounts):
    assert ids(apply_filters(amounts, [ColumnFilter("amount", "BETWEEN", -6, -1)])) == [1]
    assert ids(apply_filters(amounts, [ColumnFilter("day", "BETWEEN", "2020-01-31", "2020-02-01")])) == [1, 2]


def test_points_in_time_keep_their_offset(spark):
    df = spark.sql("SELECT TIMESTAMP'2020-01-02 03:04:05.5+02:00' AS t")
    assert df.select(sql_literal(F.col("t"), df.schema["t"].dataType)).first()[0] == "TIMESTAMPTZ '2020-01-02 01:04:05.500000+00:00'"


def test_arrays_are_typed_literals(spark, duck):
    df = spark.createDataFrame([([1.5, None, -2.0], ["it's", "x"]), ([], None)], "v array<float>, t array<string>")
    found = df.select(*[sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).collect()
    duck.execute("SELECT " + ", ".join(f"{r.v} AS v{i}, {r.t} AS t{i}" for i, r in enumerate(found)))
    assert duck.fetchall() == [([1.5, None, -2.0], ["it's", "x"], [], None)]


def test_bounds_are_not_rounded_to_the_column_type(spark):
    df = spark.sql("SELECT id, CAST(id / 100 AS DECIMAL(15,2)) AS price FROM VALUES (44L), (45L), (46L) t(id)")
    assert ids(apply_filters(df, [ColumnFilter("id", "<", 45.7)])) == [44, 45]
    assert ids(apply_filters(df, [ColumnFilter("id", "=", 45.7)])) == []
    assert ids(apply_filters(df, [ColumnFilter("id", "BETWEEN", "44.5", "45.0")])) == [45]
    assert ids(apply_filters(df, [ColumnFilter("price", ">", 0.445)])) == [45, 46]
    assert ids(apply_filters(df, [ColumnFilter("price", "<=", "0.4501")])) == [44, 45]


def test_text_values_are_bound_not_spliced(amounts):
    assert ids(apply_filters(amounts, [ColumnFilter("note", "LIKE", "it's")])) == [1]
    assert ids(apply_filters(amounts, [ColumnFilter("note", "LIKE", "a b")])) == [2]
    assert ids(apply_filters(amounts, [ColumnFilter("note", "=", "x' OR '1'='1")])) == []


@pytest.mark.parametrize(
    "item",
    [
        ColumnFilter("amount", "LIKE", "1%"), ColumnFilter("note", ">", "a"), ColumnFilter("amount", "=", "five"),
        ColumnFilter("day", "BETWEEN", "2020-01-31", "soon"), ColumnFilter("missing", "=", 1), ColumnFilter("id", "=", None),
    ],
)
def test_bad_filters_raise_before_a_job(amounts, item):
    with pytest.raises(FilterError):
        predicate(amounts, item)


def test_unfiltered_columns_are_skipped(amounts):
    assert predicate(amounts, ColumnFilter("amount", None)) is None
    assert apply_filters(amounts, [ColumnFilter("amount", None)]) is amounts
    assert ids(apply_filters(amounts, filters_from_rows([{"column": "id", "op": ">=", "lo": 2}]))) == [2, 3]


def test_lower_columns_rejects_clashes(spark):
    clash = spark.range(1).toDF("A").withColumn("b", F.lit(1)).toDF("A", "a")
    with pytest.raises(ValueError, match="clash"):
        lower_columns(clash)


def test_schema_only_needs_no_key_and_no_scan(spark):
    texts = spark.createDataFrame([("x", 1)], "CODE string, n int")
    empty = extract(texts, Extraction("none"))
    assert empty.columns == ["code", "n"] and empty.count() == 0
    scan = extract(parquet_table(spark, SF, "orders"), Extraction("none"))
    assert "FileScan" not in scan._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = extract(
        parquet_table(spark, SF, "lineitem"), Extraction("custom", (ColumnFilter("l_shipdate", "<", "1996-01-01"),))
    ).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_operators_by_type_name(spark):
    columns = spark.createDataFrame(
        [("o", "t", "a", "TIMESTAMP(6)"), ("o", "t", "b", "CLOB"), ("o", "t", "c", "NVARCHAR2(10)")],
        "owner string, table_name string, column_name string, data_type string",
    )
    found = {r["column_name"]: r["operators"] for r in allowed_operators(columns).collect()}
    assert found == {"a": "=,!=,>,<,>=,<=,BETWEEN", "b": None, "c": "LIKE,NOT LIKE"}


def test_names_and_lists(spark):
    names = spark.createDataFrame([('"APP"."T1"',), ("X.T2",), ("public.T3",), ('"T4"',)], "n string")
    assert [r[0] for r in names.select(normalise_name(F.col("n"), "APP")).collect()] == ["t1", None, "t3", "t4"]
    lists = spark.createDataFrame([(["A", "B", "A"],)], "k array<string>")
    assert lists.select(key_list(F.col("k"))).first()[0] == "(a,b,a)"


def test_literals(spark):
    df = spark.createDataFrame(
        [("it's", 1.5, float("nan"), None, bytearray(b"\x0a\xff"), dt.datetime(2020, 1, 2, 3, 4, 5), True)],
        "s string, d double, x double, n int, b binary, t timestamp_ntz, f boolean",
    )
    out = df.select(*[sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert out.asDict() == {
        "s": "'it''s'", "d": "1.5", "x": "CAST('NaN' AS DOUBLE PRECISION)", "n": "NULL", "b": "'\\x0aff'",
        "t": "TIMESTAMP '2020-01-02 03:04:05'", "f": "TRUE",
    }


def test_points_in_time_are_not_cut_for_date_columns(spark):
    days = spark.sql("SELECT DATE'2020-01-01' + CAST(id AS INT) AS d FROM range(4)")
    of = lambda *items: [str(r.d)[-2:] for r in apply_filters(days, items).orderBy("d").collect()]
    assert of(ColumnFilter("d", "<", "2020-01-02 12:00:00")) == ["01", "02"]
    assert of(ColumnFilter("d", ">", "2020-01-02 12:00:00")) == ["03", "04"]
    assert of(ColumnFilter("d", "=", "2020-01-02 12:00:00")) == []
    assert of(ColumnFilter("d", "=", "2020-01-02 00:00:00")) == ["02"]
    assert of(ColumnFilter("d", "BETWEEN", "2020-01-01 00:00:01", "2020-01-03 23:00:00")) == ["02", "03"]
    assert of(ColumnFilter("d", ">=", "2020-01-03")) == ["03", "04"]
