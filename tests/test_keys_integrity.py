import pytest
from pyspark.sql import functions as F

from conftest import SF

from portage.operators import conflicts, graph, integrity, inventory, keys, reconcile, sequences
from portage.plans.suite import QUERIES
from portage.session import stage
from portage.sources.tables import parquet_table


@pytest.fixture(scope="module")
def catalog(spark):
    constraints = spark.createDataFrame(
        [
            ("APP", "PK_P", "PARENT", "P", None, None, None),
            ("APP", "FK_I", "ITEM", "R", "APP", "PK_P", "SET NULL"),
            ("APP", "FK_EMP", "EMP", "R", "APP", "PK_EMP", "CASCADE"),
            ("APP", "PK_EMP", "EMP", "P", None, None, None),
        ],
        "owner string, constraint_name string, table_name string, constraint_type string, r_owner string, "
        "r_constraint_name string, delete_rule string",
    )
    columns = spark.createDataFrame(
        [
            ("APP", "PK_P", "PARENT", "K2", 2), ("APP", "PK_P", "PARENT", "K1", 1), ("APP", "FK_I", "ITEM", "C2", 2),
            ("APP", "FK_I", "ITEM", "C1", 1), ("APP", "PK_EMP", "EMP", "ID", 1), ("APP", "FK_EMP", "EMP", "BOSS", 1),
        ],
        "owner string, constraint_name string, table_name string, column_name string, position int",
    )
    return constraints, columns


def test_composite_key_pairs_by_position(catalog):
    found = {r["constraint_name"]: r for r in keys.fk_grouped(*catalog).collect()}
    assert found["FK_I"]["src_columns"] == ["C1", "C2"] and found["FK_I"]["ref_columns"] == ["K1", "K2"]
    assert found["FK_I"]["on_delete"] == "SET NULL"


def test_a_wide_key_is_kept_whole(spark, catalog):
    wide = spark.createDataFrame([("APP", "T", "PK", f"C{i}", i) for i in range(1, 41)], "owner string, table_name string, constraint_name string, column_name string, position int")
    assert keys.keys_grouped(wide).first()["columns"] == [f"C{i}" for i in range(1, 41)]


def test_auto_column_is_a_key_column_with_a_sequence(spark):
    columns = spark.createDataFrame(
        [
            ("APP", "T", "ID", '"APP"."ISEQ_1".nextval'), ("APP", "T", "STATUS", "'O'"), ("APP", "T", "OTHER", "s2.NEXTVAL"),
        ],
        "owner string, table_name string, column_name string, data_default string",
    )
    pk = spark.createDataFrame([("APP", "T", "ID"), ("APP", "T", "STATUS")], "owner string, table_name string, column_name string")
    assert [tuple(r) for r in keys.auto_columns(columns, pk).collect()] == [("APP", "T", "ID", "ISEQ_1")]


def test_null_and_repeated_keys(spark, as_rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "a int, b string")
    assert as_rows(integrity.pk_violations(df, ["a", "b"])) == [(1, "a", 2), (2, None, 1)]


def test_orphans_exempt_null_parts(spark, as_rows):
    child = spark.createDataFrame([(1, 1), (1, None), (9, 9), (9, 9)], "x int, y int")
    parent = spark.createDataFrame([(1, 1)], "a int, b int")
    assert as_rows(integrity.fk_orphans(child, ["x", "y"], parent, ["a", "b"])) == [(9, 9, 2)]
    assert as_rows(integrity.keep_referenced(child, ["x", "y"], parent, ["a", "b"])) == [(1, 1), (1, None)]


def test_next_value_of_zero_and_of_nothing(spark):
    assert sequences.next_value(spark.createDataFrame([(0,), (-3,)], "k bigint"), "k").first()[0] == 1
    assert sequences.next_value(spark.createDataFrame([], "k bigint"), "k").first()[0] is None


def test_assigned_keys_are_dense_and_in_order(spark):
    df = spark.range(5000).select(
        # A third of the rows share one value of the leading sort column.
        F.when(F.col("id") < 1700, 7).otherwise(F.col("id") * 7919 % 1000).alias("v"), "id"
    )
    out = sequences.assign_keys(df, ["v", "id"], "k", 100, partitions=6).orderBy("k").collect()
    assert [r["k"] for r in out] == list(range(101, 5101))
    assert [(r["v"], r["id"]) for r in out] == sorted((r["v"], r["id"]) for r in out)
    plan = sequences.assign_keys(df, ["v", "id"], "k", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_content_tells_nulls_and_copies_apart(spark, as_rows):
    schema = "k int, a string, b string"
    source = spark.createDataFrame([(1, None, "x"), (2, "s", "s"), (3, "p", "p"), (4, "q", "q"), (4, "q", "q")], schema)
    target = spark.createDataFrame([(1, "x", None), (2, "s", "s"), (4, "q", "q"), (5, "n", "n")], schema)
    assert as_rows(reconcile.reconcile_content(source, target, ["k"])) == [
        (1, "changed", None, 1, 1), (3, "lost", None, 1, 0), (4, "changed", None, 2, 1), (5, "added", None, 0, 1),
    ]


def test_content_is_compared_in_the_types_of_the_source(spark, as_rows):
    source = spark.sql("SELECT id, CAST(id AS INT) AS n, TIMESTAMP_NTZ'2020-01-02 03:04:05' AS t FROM range(4)")
    target = spark.sql(
        "SELECT CAST(id AS DECIMAL(20,0)) AS id, CAST(id AS DECIMAL(38,10)) + (CASE WHEN id = 2 THEN 7000000000 ELSE 0 END) AS n,"
        " TIMESTAMP'2020-01-02 03:04:05' AS t FROM range(4)"
    )
    assert as_rows(reconcile.reconcile_content(source, target, ["id"])) == [(2, "changed", None, 1, 1)]


def test_content_matches_names_in_any_case_and_reports_lost_columns(spark, as_rows):
    source = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "ID int, NAME string, NOTE string")
    target = spark.createDataFrame([(1, "a", True), (2, "c", True)], "id int, name string, loaded boolean")
    assert as_rows(reconcile.reconcile_content(source, target, ["id"])) == sorted([
        (2, "changed", None, 1, 1), (None, "added_column", "loaded", None, None), (None, "lost_column", "note", None, None),
    ], key=repr)
    with pytest.raises(ValueError, match="key column"):
        reconcile.reconcile_content(source, target.drop("id"), ["id"])


def test_target_without_primary_key_fails(spark):
    schema = "owner string, table_name string, column_name string"
    source = spark.createDataFrame([("A", "T", "ID"), ("A", "U", "ID"), ("B", "U", "ID")], schema)
    target = spark.createDataFrame([("a", "u", "id")], schema)
    states = {(r["owner"], r["table_name"]): r["state"] for r in reconcile.reconcile_pk(source, target).collect()}
    assert states == {("a", "t"): "failed", ("a", "u"): "done", ("b", "u"): "failed"}


def test_foreign_keys_of_the_same_name_in_two_owners_are_told_apart(spark, as_rows):
    schema = "owner string, table_name string, constraint_name string"
    source = spark.createDataFrame([("A", "T", "FK"), ("B", "T", "FK")], schema)
    target = spark.createDataFrame([("a", "t", "fk")], schema)
    assert as_rows(reconcile.missing_constraints(source, target)) == [("B", "T", "FK")]


def test_keys_may_refer_to_unique_constraints(spark, as_rows):
    schema = "owner string, constraint_name string, table_name string, constraint_type string, r_owner string, r_constraint_name string"
    constraints = spark.createDataFrame([
        ("A", "U1", "P", "U", None, None), ("A", "F1", "C", "R", "A", "U1"), ("A", "P1", "Q", "P", None, None), ("A", "F2", "C", "R", "A", "P1"),
    ], schema)
    assert as_rows(keys.fk_edges(constraints)) == [("A.C", "A.P"), ("A.C", "A.Q")]


def test_sequences_of_defaults_in_both_spellings(spark):
    spelt = {
        '"HR"."EMP_SEQ".nextval': "EMP_SEQ", "emp_seq.nextval": "emp_seq", "nextval('orders_id_seq'::regclass)": "orders_id_seq",
        "nextval('app.\"Orders_Id\"'::regclass)": "Orders_Id", "NEXTVAL('app.s1')": "s1",
    }
    df = spark.createDataFrame([(d,) for d in spelt], "d string")
    assert [r[0] for r in df.select(keys.sequence_of(df.d)).collect()] == list(spelt.values())


def test_conflicts_fold_case(spark, as_rows):
    def names(*values):
        return spark.createDataFrame([(v,) for v in values], "table_name string")

    selected, existing, replace = names("A", "B", "C"), names("a", "b", "z"), names("B")
    assert as_rows(conflicts.existing_among(selected, existing, "table_name")) == [("A",), ("B",)]
    assert as_rows(conflicts.drop_unreplaced(selected, existing, replace, "table_name")) == [("B",), ("C",)]
    assert as_rows(conflicts.plan_report(selected, existing, replace, "table_name")) == [
        ("A", "keep"), ("B", "replace"), ("C", "create"),
    ]
    assert as_rows(conflicts.common_names(names("x", "y", "y"), names("y", "q"))) == [("y",)]
    assert as_rows(conflicts.names_only_in(names("x", "y", "y"), names("y"))) == [("x",), ("y",)]


def test_failures_are_listed_once(spark, as_rows):
    status = spark.createDataFrame(
        [("A", "failed", None), ("B", "blocked", "A"), ("B", "blocked", "A"), ("C", "done", None)],
        "name string, state string, blocked_by string",
    )
    assert as_rows(conflicts.failures(status)) == [("A", "failed", None), ("B", "blocked", "A")]


def test_kinds_and_system_schemas(spark):
    objects = spark.createDataFrame(
        [("pgabc", "f", "o", "r"), ("pg_catalog", "g", "o", "r"), ("app", "h", "o", "m"), ("app", "i", "o", "?")],
        "schema string, name string, owner string, kind string",
    )
    out = inventory.user_objects(objects).select("name", inventory.decode_kind(F.col("kind")).alias("kind"))
    assert sorted(tuple(r) for r in out.collect()) == [("h", "MATERIALIZED_VIEW"), ("i", "?")]
    tables, rest = inventory.route_objects(
        spark.createDataFrame([("o", "t", "TABLE"), ("o", "v", "VIEW")], "owner string, name string, type string")
    )
    assert tables.count() == 1 and rest.first()["name"] == "v"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_read_keys_only_and_combine_before_the_shuffle(spark):
    lines = parquet_table(spark, SF, "lineitem")
    for df in (
        integrity.pk_violations(lines, ["l_orderkey", "l_linenumber"]),
        integrity.fk_orphans(lines, ["l_orderkey"], parquet_table(spark, SF, "orders"), ["o_orderkey"]),
        reconcile.reconcile_content(lines.select("l_orderkey"), lines.select("l_orderkey"), ["l_orderkey"]),
    ):
        plan = plan_of(df)
        assert "partial_" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan
        # Counting happens below the exchange.
        assert plan.index("Exchange hashpartitioning") < plan.rindex("partial_")


def test_no_operator_joins_without_keys(spark, catalog):
    for df in (keys.fk_grouped(*catalog), keys.fk_edges(catalog[0]), keys.auto_columns(
        spark.createDataFrame([("APP", "T", "ID", "s.nextval")], "owner string, table_name string, column_name string, data_default string"),
        keys.pk_columns(*catalog),
    )):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_foreign_keys_are_gathered_before_they_meet(spark):
    """Nothing is grouped behind the join with the keys referred to."""
    constraints = spark.createDataFrame(
        [("A", "PK1", "T1", "P", None, None, None), ("A", "FK1", "T2", "R", "A", "PK1", "CASCADE"), ("A", "FK1", "T2", "R", "A", "PK1", "CASCADE"),
         ("A", "FK2", "T2", "R", "A", "GONE", "CASCADE")],
        "owner string, constraint_name string, table_name string, constraint_type string, r_owner string, r_constraint_name string, delete_rule string",
    )
    columns = spark.createDataFrame(
        [("A", "PK1", "T1", "K2", 2), ("A", "PK1", "T1", "K1", 1), ("A", "FK1", "T2", "B", 2), ("A", "FK1", "T2", "A", 1), ("A", "FK1", "T2", "A", 1),
         ("A", "FK1", "T2", "C", 3), ("A", "FK2", "T2", "D", 1)],
        "owner string, constraint_name string, table_name string, column_name string, position int",
    )
    found = keys.fk_grouped(constraints, columns)
    assert [tuple(r) for r in found.collect()] == [("A", "T2", "FK1", "A", "T1", "CASCADE", ["A", "B"], ["K1", "K2"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def test_staged_tables_are_zstd(spark, tmp_path):
    from portage.session import stage

    stage(spark.range(3), str(tmp_path / "t"))
    assert list((tmp_path / "t").glob("*.zstd.parquet"))


def test_catalogs_built_of_dealt_lines_are_the_shapes(spark):
    """Orders and lines that come twice, lines without order, and nulls in every column the shapes read."""
    from portage.sources import instance_catalog as cat

    make = spark.createDataFrame
    tables = {
        "orders": make([(1, 1, "F"), (1, 1, "F"), (1, 2, "O"), (2, None, None), (3, 1, "P"), (None, 1, "F"), (5, 1, "O")], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": make(
            [(k, p, s, n, f, t) for k in (1, 2, 3, 9, None) for p, s, n, f, t in [
                (1, 1, 1, "A", "F"), (1, 1, 1, "A", "F"), (1, 2, 2, "N", "O"), (None, 1, 3, "R", "O"), (2, None, None, None, None), (2, 2, 4, "A", "O")]],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string",
        ),
        "part": make([(1, "Brand#1"), (2, "Brand#2")], "p_partkey long, p_brand string"),
        "customer": make([(1, "BUILDING", 1)], "c_custkey long, c_mktsegment string, c_nationkey long"),
        "supplier": make([(1, 1)], "s_suppkey long, s_nationkey long"), "nation": make([(1, 1)], "n_nationkey long, n_regionkey long"),
        "region": make([(1,)], "r_regionkey long"), "conversations": make([(1, 1, "user"), (1, 0, "user")], "conv_id long, turn long, role string"),
    }
    for name, text in cat.PLANS.items():
        inputs = {t: df for t, df in tables.items() if "{" + t + "}" in text}
        built = spark.sql(text.replace("{parts}", "3"), **inputs)
        shape = spark.sql(cat.SHAPES[name], **{t: df for t, df in tables.items() if "{" + t + "}" in cat.SHAPES[name]})
        assert built.dtypes == shape.dtypes
        assert sorted(map(repr, built.collect())) == sorted(map(repr, shape.collect())), name


def test_references_are_dealt_before_they_are_made_distinct(spark):
    from portage.operators.inventory import distinct_references

    found = distinct_references(spark.createDataFrame([("A", "b", "TABLE"), ("A", "b", "TABLE"), (None, "b", None)], "referenced_owner string, referenced_name string, referenced_type string"))
    assert {tuple(r) for r in found.collect()} == {("A", "b", "TABLE"), (None, "b", None)} and found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_names_are_not_broadcast(spark, tmp_path):
    """names take many times their stored bytes in memory, so Spark's estimate by the files is too low."""
    ids = spark.range(500_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("id"))
    names = stage(
        ids.select(F.concat(F.lit("OWNER_"), F.col("id") % 7).alias("owner"), F.concat(F.lit("TABLE_"), "id").alias("table_name")),
        str(tmp_path / "names"),
    )
    existing = names.where("owner = 'OWNER_1'").select("table_name")
    nodes = names.where("owner = 'OWNER_2'").select(F.concat_ws(".", "owner", "table_name").alias("node"))
    edges = names.select(F.concat_ws(".", "owner", "table_name").alias("child"), F.concat(F.lit("X."), "table_name").alias("parent"))
    for df in (
        conflicts.drop_unreplaced(names, existing, existing, "table_name"), conflicts.plan_report(names, existing, existing, "table_name"),
        graph.missing_dependencies(edges, nodes),
    ):
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_small_tables_may_be_broadcast(spark, tmp_path):
    few = stage(spark.range(100).select(F.concat(F.lit("TABLE_"), "id").alias("table_name")), str(tmp_path / "few"))
    assert "BroadcastHashJoin" in _plan(conflicts.existing_among(few, few, "table_name"))


def test_names_are_moved_without_numbers(catalog):
    """the number that names are sorted by is no column of the rows that are moved."""
    plan = _plan(keys.fk_columns(*catalog).hint("merge"))
    assert "_number" not in plan and "hash(owner" in plan


def test_keys_of_both_sides_are_looked_for_once(spark):
    """the primary keys go through one join, not through one for each side."""
    plan = _plan(QUERIES["recon_pk"](spark, SF))
    assert "Join" not in plan and "Scan parquet" in plan
