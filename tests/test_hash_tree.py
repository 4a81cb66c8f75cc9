"""Key ranges and hash trees: ranges are disjoint and cover everything, trees find what the full comparison finds."""

import datetime
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from portage.operators import hash_tree, key_ranges, load, reconcile
from portage.sources.tables import JdbcSource, parquet_table


def mixed(spark, n=400, seed=1):
    draw = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    rows = [
        (
            draw.choice([None, 1, 2, 2, 2, 3]), draw.choice([None, "", "a'b", 'q"', "é", "zz"]) if draw.random() < 0.5 else f"t{draw.randrange(40)}",
            None if draw.random() < 0.1 else day + datetime.timedelta(draw.randrange(50)), i,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "a int, b string, c date, v int")


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_every_row_lies_in_one_range(spark, ranges):
    df = mixed(spark)
    parts = key_ranges.key_ranges(df, ["a", "b", "c"], ranges)
    assert len(parts) <= ranges and (ranges == 1 or len(parts) > 1)
    flags = df.select(parts.number().alias("n"), *[parts.between(i, i).cast("int").alias(f"r{i}") for i in range(len(parts))])
    for row in flags.collect():
        assert [r or 0 for r in row[1:]] == [int(i == row.n) for i in range(len(parts))]
    keys = sorted((r.n, (r.a is not None, r.a or 0), (r.b is not None, (r.b or "").encode())) for r in df.select("*", parts.number().alias("n")).collect())
    assert [k[1:] for k in keys] == sorted(k[1:] for k in keys)


def test_ranges_hold_about_equally_many_keys(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = key_ranges.key_ranges(lines, ["l_orderkey", "l_linenumber"], 16)
    again = key_ranges.key_ranges(lines.orderBy("l_comment" if "l_comment" in lines.columns else "l_quantity"), ["l_orderkey", "l_linenumber"], 16)
    assert parts == again and len(parts) == 16
    sizes = [r["count"] for r in lines.groupBy(parts.number().alias("n")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_ranges_of_a_table_without_keys(spark):
    empty = mixed(spark).limit(0)
    assert len(key_ranges.key_ranges(empty, ["a"], 9)) == 1
    nulls = spark.createDataFrame([(None,)] * 5, "a int")
    assert len(key_ranges.key_ranges(nulls, ["a"], 9)) == 1
    with pytest.raises(ValueError, match="ranges"):
        key_ranges.key_ranges(empty, ["a"], 0)


def test_covering_joins_the_nearest_intervals(spark):
    df = spark.range(1000)
    parts = key_ranges.key_ranges(df, ["id"], 50)
    for most in (1, 2, 3, 64):
        rows = df.where(parts.covering([0, 1, 5, 40, 42, 49], most)).select(parts.number().alias("n")).distinct().collect()
        numbers = {r.n for r in rows}
        assert {0, 1, 5, 40, 42, 49} <= numbers
        assert len(numbers) == {1: 50, 2: 16, 3: 10, 64: 6}[most]
    assert df.where(parts.covering([])).count() == 0


def test_timestamps_split_to_the_microsecond(spark):
    df = spark.range(300).select(F.expr("timestamp_micros(1600000000000000 + id)").alias("t"), F.expr("CAST(id AS DECIMAL(38, 10)) / 7").alias("d"))
    for key in (["t"], ["d"], ["d", "t"]):
        parts = key_ranges.key_ranges(df, key, 10)
        sizes = [df.where(parts.between(i, i)).count() for i in range(len(parts))]
        assert len(sizes) == 10 and sum(sizes) == 300 and min(sizes) > 5


def changed(df, seed):
    """A copy with lost, added, repeated and changed rows."""
    draw = random.Random(seed)
    picks = draw.sample(range(400), 40)
    lost, repeated, other = picks[:10], picks[10:20], picks[20:30]
    kept = df.where(~F.col("v").isin(lost)).withColumn("v", F.when(F.col("v").isin(other), F.col("v") + 1000).otherwise(F.col("v")))
    return kept.unionByName(df.where(F.col("v").isin(repeated))).unionByName(
        df.where(F.col("v").isin(picks[30:])).withColumns({"a": F.lit(9), "b": F.concat("b", F.lit("~"))})
    )


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_tree_equals_the_full_comparison(spark, as_rows, ranges):
    source = mixed(spark)
    target = changed(source, ranges)
    key = ["a", "b", "c"]
    full = reconcile.reconcile_content(source, target, key)
    tree = hash_tree.reconcile_tree(source, target, key, ranges)
    assert as_rows(tree.rows) == as_rows(full) and full.count() > 10
    named = {r.node for r in tree.parts.collect()}
    assert named == {r[0] for r in full.select(tree.ranges.number()).distinct().collect()}
    same = hash_tree.reconcile_tree(source, source.orderBy("v"), key, ranges)
    assert same.rows.isEmpty() and same.parts.isEmpty()


def test_tree_sees_types_columns_and_empty_sides(spark, as_rows):
    source = spark.sql("SELECT id, CAST(id AS INT) AS n, DATE'2020-01-01' AS d, 'x' AS gone FROM range(50)")
    target = spark.sql(
        "SELECT CAST(id AS DECIMAL(20,0)) AS ID, CAST(id AS DECIMAL(10,2)) + (CASE WHEN id = 45 THEN 0.7 ELSE 0 END) AS n,"
        " TIMESTAMP_NTZ'2020-01-01 00:00:00' + (CASE WHEN id = 7 THEN INTERVAL '13' HOUR ELSE INTERVAL '0' HOUR END) AS d FROM range(50)"
    )
    full = reconcile.reconcile_content(source, target, ["id"])
    assert as_rows(full) == sorted([
        (45, "changed", None, 1, 1), (7, "changed", None, 1, 1), (None, "lost_column", "gone", None, None),
    ], key=repr)
    assert as_rows(hash_tree.reconcile_tree(source, target, ["id"], 8).rows) == as_rows(full)
    half = spark.sql("SELECT id + 0.5 AS id FROM range(3)")
    whole = spark.sql("SELECT id FROM range(3)")
    assert [r.difference for r in reconcile.reconcile_content(whole, half, ["id"]).collect()] == ["changed"] * 3
    empty = source.limit(0)
    for one, other, word in ((source, empty, "lost"), (empty, source, "added")):
        found = hash_tree.reconcile_tree(one, other, ["id"], 8).rows
        assert found.count() == 50 and {r.difference for r in found.collect()} == {word}


def test_second_pass_skips_row_groups(spark, tmp_path):
    source = spark.range(0, 200_000, numPartitions=20).selectExpr("id", "id * 3 AS v")
    source.write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/source")
    source.withColumn("v", F.when(F.col("id") == 77_777, F.lit(0)).otherwise(F.col("v"))).write.parquet(f"{tmp_path}/target")
    sides = [spark.read.parquet(f"{tmp_path}/{name}") for name in ("source", "target")]
    tree = hash_tree.reconcile_tree(*sides, ["id"], 100)
    assert [tuple(r) for r in tree.rows.collect()] == [(77_777, "changed", None, 1, 1)]
    part = tree.parts.first()
    assert tree.parts.count() == 1 and part.source_rows == part.target_rows < 4000
    wanted = sides[0].where(tree.ranges.covering([part.node]))
    plan = wanted._jdf.queryExecution()
    assert "PushedFilters: [" in plan.toString() and "GreaterThan(id" in plan.toString()
    assert read_rows(wanted) <= 20_000


def read_rows(df):
    """Rows that the scan of a query gave out, before its filter."""
    df._jdf.collectToPython()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_database_read_by_a_key_of_text_and_number(spark, as_rows):
    # Text columns would be made as large objects otherwise, which have no order there.
    database = JdbcSource(
        "jdbc:derby:memory:splits;create=true", "org.apache.derby.jdbc.EmbeddedDriver", {"createTableColumnTypes": "segment VARCHAR(40)"}
    )
    rows = parquet_table(spark, SF, "customer").selectExpr(
        "c_mktsegment AS segment", "IF(c_custkey % 10 = 0, NULL, c_custkey) AS c_custkey", "c_acctbal"
    )
    load.load_jdbc(rows, database, "app_customer")
    found = database.table_by_key(spark, "app_customer", ["segment", "c_custkey"], 6)
    assert found.rdd.getNumPartitions() == 6
    assert as_rows(found) == as_rows(rows)
    assert as_rows(database.table_by_key(spark, "app_customer", ["c_custkey"], 4)) == as_rows(rows)
    load.load_jdbc(rows.limit(0), database, "app_none")
    assert database.table_by_key(spark, "app_none", ["segment"], 4).count() == 0
