import glob
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF

from portage.operators import load, runlog, script, stored_code
from portage.operators.integrity import pk_violations
from portage.plans.migrate import ForeignKey, TableSpec, migrate
from portage.plans.from_catalog import table_specs
from portage.plans.suite import table_specs as table_specs_of_the_suite
from portage.plans.whole_script import write_whole_script
from portage.session import drop_dir, new_work_dir, path_exists, sized_for, work_root
from portage.sources.database_catalog import ORACLE, POSTGRES, DatabaseCatalog
from portage.sources.tables import JdbcSource, extract, has_rows, parquet_table


def test_work_folder_is_the_one_the_cluster_names(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        drop_dir(spark, "/tmp/elsewhere")


def test_load_counts_in_the_same_pass_without_a_shuffle(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    done = load.load_parquet(df, str(tmp_path / "t"), "id", max_records_per_file=10)
    assert (done.n_rows, done.max_value) == (100, 99)
    assert len(glob.glob(str(tmp_path / "t" / "*.parquet"))) >= 10
    empty = load.load_parquet(df.where("false"), str(tmp_path / "e"), "id")
    assert (empty.n_rows, empty.max_value) == (0, None)


def check_snapshot(spark, target):
    target.load(spark.range(5).toDF("k"), "t")
    with pytest.raises(RuntimeError):
        with load.snapshot(spark, target, "t") as copy:
            target.load(spark.range(50, 52).toDF("k"), "t")
            raise RuntimeError
    assert sorted(r[0] for r in target.read(spark, "t").collect()) == [0, 1, 2, 3, 4]
    assert not path_exists(spark, copy)
    with load.snapshot(spark, target, "t") as copy:
        target.load(spark.range(1).toDF("k"), "t")
    assert target.read(spark, "t").count() == 1 and not path_exists(spark, copy)
    with load.snapshot(spark, target, "not_there") as copy:
        assert copy is None


def test_snapshot_of_a_folder(spark, tmp_path):
    target = load.ParquetTarget(str(tmp_path))
    check_snapshot(spark, target)
    with pytest.raises(RuntimeError), load.snapshot(spark, target, "new"):
        target.load(spark.range(2).toDF("k"), "new")
        raise RuntimeError
    assert not target.exists(spark, "new")


def test_a_failed_new_table_leaves_nothing_and_self_references_are_checked(spark, tmp_path):
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 99)], "id int, boss int")
    own = (ForeignKey(("boss",), "emp", ("id",)),)
    done = migrate(spark, {"emp": TableSpec(staff, ("id",), own)}, str(tmp_path / "a")).first()
    assert (done["state"], done["fk_orphan_rows"]) == ("done", 1)
    failed = migrate(spark, {"emp": TableSpec(staff, ("id",), own, check_keys=True)}, str(tmp_path / "b")).first()
    assert failed["state"] == "failed" and not (tmp_path / "b" / "emp").exists()


def test_failure_is_carried_forward(spark, tmp_path):
    bad = spark.range(3).select(F.assert_true(F.col("id") < 0).alias("x"), F.col("id").alias("k"))
    child = spark.createDataFrame([(1, 0)], "k int, p int")
    tables = {
        "leaf": TableSpec(child, ("k",), (ForeignKey(("p",), "middle", ("k",)),)),
        "middle": TableSpec(child, ("k",), (ForeignKey(("p",), "root", ("k",)),)),
        "root": TableSpec(bad, ("k",)),
        "other": TableSpec(child, ("k",), (ForeignKey(("p",), "not_in_the_run", ("k",)),)),
        "loop_a": TableSpec(child, ("k",), (ForeignKey(("p",), "loop_b", ("k",)),)),
        "loop_b": TableSpec(child, ("k",), (ForeignKey(("p",), "loop_a", ("k",)),)),
    }
    log = new_work_dir(spark, "log")
    report = {r["table_name"]: r for r in migrate(spark, tables, str(tmp_path / "target"), log_path=log).collect()}
    assert {n: r["state"] for n, r in report.items()} == {
        "root": "failed", "middle": "blocked", "leaf": "blocked", "other": "done", "loop_a": "stalled", "loop_b": "stalled",
    }
    assert report["leaf"]["blocked_by"] == report["middle"]["blocked_by"] == "root"
    states = [r["state"] for r in runlog.read(spark, log).collect()]
    assert "failed" in states and "executing" in states
    with pytest.raises(ValueError):
        runlog.log_event(spark, log, "odd", "x")


def test_key_checks_can_reject_a_table(spark, tmp_path):
    target = str(tmp_path / "target")
    good = spark.createDataFrame([(1,), (2,)], "k int")
    assert migrate(spark, {"t": TableSpec(good, ("k",), check_keys=True)}, target).first()["state"] == "done"
    doubled = TableSpec(good.union(good), ("k",), check_keys=True)
    assert migrate(spark, {"t": doubled}, target).first()["state"] == "failed"
    # The rejected load was rolled back to the earlier table.
    assert spark.read.parquet(f"{target}/t").count() == 2


def test_script_replays_to_an_equal_table(spark, duck, tmp_path):
    part = extract(parquet_table(spark, SF, "customer")).withColumn("c_name", F.concat("c_name", F.lit("'s")))
    lines = script.table_ddl(part, "app.customer").unionByName(script.inserts(part, "app.customer"))
    key = spark.createDataFrame(
        [(script.PRIMARY_KEY, "app.customer", script.primary_key_ddl("app.customer", ["C_CUSTKEY"]))],
        "section int, seq string, value string",
    )
    script.write_script(lines.unionByName(key), str(tmp_path / "script"))
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "script" / "*.txt"))))
    assert text.startswith("CREATE TABLE") and text.rstrip().endswith("ADD PRIMARY KEY (c_custkey);")
    duck.execute("CREATE SCHEMA IF NOT EXISTS app")
    for statement in text.strip().split("\n"):
        duck.execute(statement)
    replayed = sorted(duck.execute("SELECT * FROM app.customer").fetchall())
    assert replayed == sorted(tuple(r) for r in part.collect())


def test_whole_script_replays_to_equal_tables(spark, duck, tmp_path):
    specs = table_specs_of_the_suite(spark, SF)
    code = spark.createDataFrame([
        ("VIEW", "CREATE OR REPLACE VIEW whole.names AS SELECT n_name\nFROM whole.nation"),
        ("TRIGGER", "CREATE TRIGGER t ON x;"), ("FUNCTION", "CREATE FUNCTION f();"),
    ], "target_type string, script string")
    path = str(tmp_path / "script")
    write_whole_script(spark, specs, path, "whole", code)
    files = sorted(glob.glob(f"{path}/*/*/part-*.txt"))
    sections = list(dict.fromkeys(f.split("/")[-3] for f in files))
    assert sections == ["1-tables", "2-rows", "3-primary-keys", "4-sequences", "5-foreign-keys", "6-routines", "7-views", "8-triggers"]
    engine = pytest.importorskip("duckdb").connect()
    engine.execute("CREATE SCHEMA whole")
    # The engine of the test adds no foreign keys to tables that exist, and has no triggers and no such routines.
    for file in files:
        section = file.split("/")[-3]
        if section[0] in "123457":
            text = open(file).read()
            if section[0] == "3":  # keys that the data itself repeats cannot be added
                for statement in text.strip().split("\n"):
                    name = statement.split()[2].split(".")[1]
                    if pk_violations(extract(specs[name].data, specs[name].extraction), list(specs[name].primary_key)).isEmpty():
                        engine.execute(statement)
            elif section[0] != "5" and text.strip():
                engine.execute(text)
    for name, spec in specs.items():
        frame = extract(spec.data, spec.extraction)
        ours = sorted(map(repr, (tuple(r) for r in frame.collect())))
        theirs = engine.execute(f"SELECT {', '.join(frame.columns)} FROM whole.{name}").fetchall()
        if name in ("embeddings",):
            assert len(theirs) == len(ours)
            continue
        assert sorted(map(repr, theirs)) == ours, name
    assert engine.execute("SELECT count(*) FROM whole.names").fetchall() == [(25,)]
    last = engine.execute("SELECT max(o_orderkey) FROM whole.orders").fetchall()[0][0]
    assert engine.execute("SELECT nextval('whole.orders_o_orderkey_seq')").fetchall() == [(last + 1,)]


def test_quarantine_keeps_whole_bodies(spark, tmp_path):
    rejected = spark.createDataFrame(
        [("o", "n", "PROCEDURE", "factory", "a\n'b'\n\"c\"")],
        "owner string, name string, type string, reason string, body string",
    )
    stored_code.write_quarantine(rejected, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first()["body"] == "a\n'b'\n\"c\""


# JDBC: an embedded engine inside the session's own process; it listens on no port ------------------------------


@pytest.fixture(scope="module")
def database():
    return JdbcSource("jdbc:derby:memory:portage;create=true", "org.apache.derby.jdbc.EmbeddedDriver")


def test_jdbc_round_trip(spark, database):
    orders = extract(parquet_table(spark, SF, "orders"))
    done = load.load_jdbc(orders, database, "app_orders", "o_orderkey", connections=3)
    assert (done.n_rows, done.max_value) == (1500, 1499)
    # A second load replaces the table.
    load.load_jdbc(orders.where("o_orderkey < 1000"), database, "app_orders")
    assert database.table(spark, "app_orders").count() == 1000
    load.load_jdbc(orders, database, "app_orders", truncate=True)

    back = database.table(spark, "app_orders", "o_orderkey", partitions=4)
    assert back.rdd.getNumPartitions() == 4
    assert back.count() == 1500
    keys = ["o_orderkey", "o_custkey", "o_totalprice"]
    assert back.select(*keys).exceptAll(orders.select(*keys)).isEmpty()


def test_jdbc_pushdown_and_query(spark, database):
    load.load_jdbc(extract(parquet_table(spark, SF, "part")), database, "app_part")
    whole = database.table(spark, "app_part")
    cheap = whole.where("p_size < 10").select("p_partkey")
    assert "LessThan(p_size,10)" in cheap._jdf.queryExecution().executedPlan().toString().replace(" ", "").replace("P_SIZE", "p_size")
    assert has_rows(whole, "part").first()["has_rows"]
    direct = database.query(spark, 'SELECT "p_partkey" FROM app_part WHERE "p_size" < 10')
    assert direct.count() == cheap.count()


def test_jdbc_partitioned_read_of_an_empty_table(spark, database):
    load.load_jdbc(spark.range(0).toDF("k"), database, "nothing")
    assert database.table(spark, "nothing", "k", partitions=4).count() == 0


def test_snapshot_of_a_database_table(spark, database):
    target = load.JdbcTarget(database)
    check_snapshot(spark, target)
    with pytest.raises(RuntimeError), load.snapshot(spark, target, "brand_new"):
        target.load(spark.range(2).toDF("k"), "brand_new")
        raise RuntimeError
    assert target.read(spark, "brand_new").count() == 0


def test_a_fault_is_not_taken_for_an_absent_table(spark, database):
    assert not load.JdbcTarget(database).exists(spark, "never_made")
    broken = load.JdbcTarget(replace(database, driver="no.such.Driver"))
    with pytest.raises(Exception, match="no.such.Driver"):
        broken.exists(spark, "t")


def test_database_to_database_from_catalog_rows(spark, database):
    for name, schema in (("SRC_PARENT", "ID int, NAME string"), ("SRC_CHILD", "ID int, PARENT_ID int")):
        rows = [(1, "a"), (2, "b")] if name == "SRC_PARENT" else [(10, 1), (11, 2), (12, None)]
        load.load_jdbc(spark.createDataFrame(rows, schema), database, name)
    constraints = spark.createDataFrame(
        [
            ("APP", "PK_PARENT", "SRC_PARENT", "P", None, None, None), ("APP", "PK_CHILD", "SRC_CHILD", "P", None, None, None),
            ("APP", "FK_CHILD", "SRC_CHILD", "R", "APP", "PK_PARENT", "CASCADE"),
        ],
        "owner string, constraint_name string, table_name string, constraint_type string, r_owner string, "
        "r_constraint_name string, delete_rule string",
    )
    cons_columns = spark.createDataFrame(
        [
            ("APP", "PK_PARENT", "SRC_PARENT", "ID", 1), ("APP", "PK_CHILD", "SRC_CHILD", "ID", 1),
            ("APP", "FK_CHILD", "SRC_CHILD", "PARENT_ID", 1),
        ],
        "owner string, constraint_name string, table_name string, column_name string, position int",
    )
    columns = spark.createDataFrame(
        [("APP", "SRC_PARENT", "ID", "NUMBER", '"APP"."ISEQ_1".nextval', 1)],
        "owner string, table_name string, column_name string, data_type string, data_default string, position int",
    )
    specs = table_specs(
        spark, database, "APP", ["SRC_PARENT", "SRC_CHILD"], constraints, cons_columns, columns, partitions=2, qualified=False
    )
    assert specs["src_child"].primary_key == ("id",) and specs["src_parent"].auto_column == "id"
    assert specs["src_parent"].data.rdd.getNumPartitions() == 2
    # The target uses other names than the source, as both live in one engine here.
    target = load.JdbcTarget(database, "TARGET")
    spark._jvm.java.sql.DriverManager.getConnection(database.url).createStatement().execute("CREATE SCHEMA TARGET")
    report = {r["table_name"]: r for r in migrate(spark, specs, target).collect()}
    assert {n: (r["state"], r["level"], r["rows_out"], r["fk_orphan_rows"]) for n, r in report.items()} == {
        "src_parent": ("done", 0, 2, 0), "src_child": ("done", 1, 3, 0),
    }
    assert report["src_parent"]["next_value"] == 3


def test_catalog_queries_quote_the_owner(database):
    for queries in (ORACLE, POSTGRES):
        catalog = DatabaseCatalog(database, "O'NEIL", queries)
        for name in queries:
            assert "'O''NEIL'" in catalog.sql(name) and "{" not in catalog.sql(name)


def test_catalog_table_has_lower_case_columns(spark, database):
    catalog = DatabaseCatalog(database, "SYS", {"cat_tables": "SELECT TABLENAME AS table_name FROM SYS.SYSTABLES WHERE {owner} = 'SYS'"})
    found = catalog.table(spark, "cat_tables")
    assert found.columns == ["table_name"] and found.where("table_name = 'SYSTABLES'").count() == 1


def test_partitions_follow_the_data_size():
    assert sized_for(1)["spark.sql.shuffle.partitions"] == "200"
    assert int(sized_for(10 << 40)["spark.sql.shuffle.partitions"]) == 20480
    assert sized_for(100 << 40)["spark.sql.shuffle.partitions"] == "50000"


# Commits and resumed runs ---------------------------------------------------------------------------------------


def refuse(written):
    raise RuntimeError("refused")


def test_a_folder_is_swapped_after_its_check(spark, tmp_path):
    target = load.ParquetTarget(str(tmp_path))
    assert target.commit(spark.range(5).toDF("k"), "t", "k") == load.Loaded(5, 4)
    seen = []
    # The old table stays readable while the new one is loaded, from itself too.
    done = target.commit(target.read(spark, "t").where("k > 1"), "t", check=lambda df: seen.append((df.count(), target.read(spark, "t").count())))
    assert done.n_rows == 3 and seen == [(3, 5)] and target.read(spark, "t").count() == 3
    with pytest.raises(RuntimeError, match="refused"):
        target.commit(spark.range(9).toDF("k"), "t", check=refuse)
    with pytest.raises(RuntimeError, match="refused"):
        target.commit(spark.range(9).toDF("k"), "new", check=refuse)
    assert target.read(spark, "t").count() == 3 and not target.exists(spark, "new")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_a_commit_that_broke_between_its_renames_is_taken_back(spark, tmp_path):
    target = load.ParquetTarget(str(tmp_path))
    target.commit(spark.range(5).toDF("k"), "t")
    (tmp_path / "t").rename(tmp_path / "t.replaced-1")
    with pytest.raises(RuntimeError, match="refused"):
        target.commit(spark.range(9).toDF("k"), "t", check=refuse)
    assert target.read(spark, "t").count() == 5


def test_rows_that_arrive_twice_are_loaded_again(spark, database, monkeypatch):
    target = load.JdbcTarget(database)
    target.commit(spark.range(4).toDF("k"), "once")
    write, calls = load.write_jdbc, []

    def rerun(df, to, table, connections, truncate=False):
        """A task whose first attempt was lost after its commit: its rows are in the table twice."""
        write(df, to, table, connections, truncate)
        calls.append(table)
        if len(calls) == 1:
            df.limit(3).write.format("jdbc").mode("append").options(url=to.url, driver=to.driver, dbtable=table).save()

    monkeypatch.setattr(load, "write_jdbc", rerun)
    assert target.commit(spark.range(10).toDF("k"), "once", "k") == load.Loaded(10, 9)
    assert calls == ["once_loading"] * 2
    assert sorted(r.k for r in target.read(spark, "once").collect()) == list(range(10))
    assert not target.exists(spark, "once_loading")


def test_a_database_table_keeps_its_rows_when_a_load_fails(spark, database):
    target = load.JdbcTarget(database)
    target.commit(spark.range(4).toDF("k"), "kept")
    with pytest.raises(RuntimeError, match="refused"):
        target.commit(spark.range(9).toDF("k"), "kept", check=refuse)
    with pytest.raises(Exception, match="(?i)table/view|does not exist"):
        database.execute(spark, "DELETE FROM kept", "INSERT INTO kept SELECT * FROM no_such_table")
    assert target.read(spark, "kept").count() == 4
    assert target.commit(spark.range(2).selectExpr("id AS k", "id AS other"), "kept").n_rows == 2
    assert sorted(target.read(spark, "kept").columns) == ["k", "other"]


def test_a_broken_run_goes_on_and_loads_each_table_once(spark, tmp_path, monkeypatch):
    rows = spark.range(6).selectExpr("id AS k", "id AS up")
    tables = {
        "a": TableSpec(rows, ("k",), auto_column="k"), "b": TableSpec(rows, ("k",), (ForeignKey(("up",), "a", ("k",)),)),
        "c": TableSpec(rows, ("k",), (ForeignKey(("up",), "b", ("k",)),)), "d": TableSpec(rows, ("k",)),
    }
    commit, loads, broken = load.ParquetTarget.commit, [], ["b"]

    def counted(self, df, name, *rest, **more):
        if name in broken:
            raise KeyboardInterrupt  # the driver goes down in the second wave
        done = commit(self, df, name, *rest, **more)
        loads.append(name)
        return done

    monkeypatch.setattr(load.ParquetTarget, "commit", counted)
    go = lambda run: migrate(spark, tables, str(tmp_path / "out"), status_path=str(tmp_path / "status"), run_id=run)
    with pytest.raises(KeyboardInterrupt):
        go("monday/1")
    assert {r.table_name: r.state for r in runlog.states(spark, str(tmp_path / "status"), "monday/1").collect()} == {
        "a": "done", "b": "started", "d": "done",
    }
    broken.clear()
    report = {r.table_name: r for r in go("monday/1").collect()}
    assert sorted(loads) == ["a", "b", "c", "d"]
    assert {n: (r.state, r.level, r.rows_out) for n, r in report.items()} == {
        "a": ("done", 0, 6), "b": ("done", 1, 6), "c": ("done", 2, 6), "d": ("done", 0, 6),
    }
    assert report["a"].next_value == 6
    go("tuesday")
    assert len(loads) == 8
