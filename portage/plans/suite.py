"""The registered queries: every operator over whole business tables, or over catalogs derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.functions import rewrite_rules as R
from portage.functions.names import key_list, lower_columns, normalise_name
from portage.functions.predicates import ColumnFilter, allowed_operators, preview
from portage.operators import closure, conflicts, graph, hash_tree, integrity, inventory, key_ranges, keys, reconcile, runlog, script, sequences
from portage.operators import stored_code as code
from portage.operators.load import ParquetTarget, load_parquet, snapshot
from portage.operators.textdep import contains_join
from portage.plans import whole_script
from portage.plans.migrate import ForeignKey, TableSpec, migrate
from portage.session import new_work_dir, stage
from portage.sources import instance_catalog as cat
from portage.sources.tables import Extraction, extract, has_rows, parquet_table, spread

#: Schema the stored code is moved to.
TARGET_SCHEMA = "app"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Key columns with a running number, for the restart values.
NUMBERED = {
    "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id",
    "documents": "doc_id", "pages": "page_id", "benchmark": "item_id",
}

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return parquet_table(spark, sf, name)


def _filtered(spark: SparkSession, sf: str, table: str, *items: ColumnFilter) -> DataFrame:
    return extract(_t(spark, sf, table), Extraction("custom", items))


# Scans and sinks --------------------------------------------------------------------------------------------


@query
def scan_full(spark, sf):
    return extract(_t(spark, sf, "lineitem"))


@query
def scan_query(spark, sf):
    text = """
        SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        WHERE o.o_orderstatus = 'F' AND c.c_mktsegment = 'BUILDING'"""
    return spark.sql(text, orders=_t(spark, sf, "orders"), customer=_t(spark, sf, "customer"))


@query
def load_overwrite(spark, sf):
    path = new_work_dir(spark, "load") + "/orders"
    load_parquet(_t(spark, sf, "customer"), path)
    load_parquet(extract(_t(spark, sf, "orders")), path, "o_orderkey")
    return spark.read.parquet(path)


@query
def snapshot_restore(spark, sf):
    target = ParquetTarget(new_work_dir(spark, "restore"))
    target.load(_t(spark, sf, "orders"), "orders")
    try:
        with snapshot(spark, target, "orders"):
            target.load(_filtered(spark, sf, "orders", ColumnFilter("o_orderstatus", "=", "F")), "orders")
            raise RuntimeError("the load is rejected")
    except RuntimeError:
        pass
    return target.read(spark, "orders")


@query
def run_log(spark, sf):
    path = new_work_dir(spark, "run-log")
    events = _t(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "failed").otherwise("executing")
    for kind in (F.col("event_type") == "error", F.col("event_type") != "error"):
        rows = events.where(kind)
        runlog.append(rows.select("event_id", *runlog.log_line(F.col("ts"), state, F.col("event_type"))), path)
    return runlog.read(spark, path)


@query
def script_inserts(spark, sf):
    # Whole numbers, decimals, dates, quotes, line breaks and nulls; the tests replay arrays and the other types.
    names = ("orders", "documents", "benchmark", "labels", "conversations")
    return reduce(DataFrame.unionByName, [script.inserts(extract(_t(spark, sf, n)), f"{TARGET_SCHEMA}.{n}") for n in names])


@query
def script_ddl(spark, sf):
    constraints, cons_columns, columns = (
        cat.cat_constraints(spark, sf), cat.cat_cons_columns(spark, sf), cat.cat_columns(spark, sf)
    )
    # The primary keys are looked for once, for their statements and for the sequences.
    primary = stage(keys.pk_columns(constraints, cons_columns), new_work_dir(spark, "keys"))
    auto = keys.auto_columns(columns, primary)
    known = cat.cat_sequences(spark, sf).select(
        F.col("sequence_owner").alias("owner"), "sequence_name", (F.col("last_number") + 1).alias("start_with")
    )
    starts = auto.join(known, ["owner", "sequence_name"], "left").select("table_name", "column_name", "start_with")
    return script.catalog_ddl(columns, constraints, cons_columns, starts, TARGET_SCHEMA, primary)


# Filters ----------------------------------------------------------------------------------------------------


@query
def cols_lower(spark, sf):
    customer = _t(spark, sf, "customer")
    return lower_columns(customer.toDF(*[c.upper() for c in customer.columns]))


@query
def name_normalise(spark, sf):
    key = F.col("o_orderkey").cast("string")
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('"APP"."ORD_'), key, F.lit('"')))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Public.Ord_"), key))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("OTHER.ORD_"), key))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit('"ORD_'), key, F.lit('"')))
        .otherwise(F.concat(F.lit("ORD_"), key))
    )
    return _t(spark, sf, "orders").select(
        "o_orderkey", raw.alias("raw_name"), normalise_name(raw, TARGET_SCHEMA).alias("name")
    )


@query
def flt_eq(spark, sf):
    return _filtered(spark, sf, "orders", ColumnFilter("o_custkey", "=", 77))


@query
def flt_ne(spark, sf):
    return _filtered(spark, sf, "orders", ColumnFilter("o_orderstatus", "!=", "F"))


@query
def flt_gt(spark, sf):
    return _filtered(spark, sf, "orders", ColumnFilter("o_orderdate", ">", "1997-01-01"))


@query
def flt_lt(spark, sf):
    return _filtered(spark, sf, "lineitem", ColumnFilter("l_shipdate", "<", "1996-01-01 00:00:00"))


@query
def flt_ge(spark, sf):
    return _filtered(spark, sf, "lineitem", ColumnFilter("l_quantity", ">=", "45"))


@query
def flt_le(spark, sf):
    return _filtered(spark, sf, "customer", ColumnFilter("c_acctbal", "<=", -100))


@query
def flt_between(spark, sf):
    return _filtered(spark, sf, "orders", ColumnFilter("o_totalprice", "BETWEEN", 1000, 20000))


@query
def flt_like(spark, sf):
    return _filtered(spark, sf, "part", ColumnFilter("p_type", "LIKE", "ECON%"))


@query
def flt_not_like(spark, sf):
    return _filtered(spark, sf, "part", ColumnFilter("p_name", "NOT LIKE", "%widget"))


@query
def flt_conjunction(spark, sf):
    return _filtered(
        spark, sf, "lineitem",
        ColumnFilter("l_quantity", "BETWEEN", 10, 30),
        ColumnFilter("l_returnflag", "LIKE", "R%"),
        ColumnFilter("l_discount", ">=", 0.05),
        ColumnFilter("l_tax", None),
    )


@query
def flt_preview(spark, sf):
    return preview(
        _t(spark, sf, "orders"), [ColumnFilter("o_totalprice", ">", 100000)], ["o_orderdate", "o_orderkey"], 25
    )


@query
def flt_allowed_ops(spark, sf):
    return allowed_operators(cat.cat_columns(spark, sf))


@query
def extract_skeleton(spark, sf):
    return extract(_t(spark, sf, "lineitem"), Extraction("none"))


@query
def extract_modes(spark, sf):
    heavy = Extraction("custom", (ColumnFilter("l_quantity", ">", 40),))
    return reconcile.row_counts({
        "orders": extract(_t(spark, sf, "orders"), Extraction("all")),
        "lineitem": extract(_t(spark, sf, "lineitem"), heavy),
        "part": extract(_t(spark, sf, "part"), Extraction("none")),
    })


@query
def probe_nonempty(spark, sf):
    probes = [has_rows(_t(spark, sf, t), t) for t in TABLES]
    probes.append(has_rows(_t(spark, sf, "lineitem").where(F.col("l_quantity") < 0), "denied"))
    return reduce(DataFrame.unionByName, probes)


# Inventory --------------------------------------------------------------------------------------------------


@query
def inv_tables(spark, sf):
    return inventory.owned_by(cat.cat_tables(spark, sf), "SALES_F")


@query
def inv_columns(spark, sf):
    return inventory.owned_by(cat.cat_columns(spark, sf), "SALES_F").select(
        "table_name", "column_name", "data_type", "data_default"
    )


@query
def inv_user_objects(spark, sf):
    return inventory.user_dependencies(cat.cat_dependencies(spark, sf))


@query
def inv_objects(spark, sf):
    return inventory.all_objects(cat.cat_tables(spark, sf), cat.cat_views(spark, sf), cat.source_lines(spark, sf))


@query
def inv_owned(spark, sf):
    roles = _t(spark, sf, "customer").select(F.col("c_name").alias("owner"), F.col("c_custkey").alias("role_id"))
    schemas = _t(spark, sf, "nation").select(F.col("n_name").alias("schema"), F.col("n_nationkey").alias("schema_id"))
    return inventory.owned_report(cat.cat_objects(spark, sf), roles, schemas)


@query
def kind_decode(spark, sf):
    return cat.cat_objects(spark, sf).select("name", "kind", inventory.decode_kind(F.col("kind")).alias("object_type"))


@query
def trigger_map(spark, sf):
    customer = _t(spark, sf, "customer")
    functions = customer.select(
        F.concat(F.lit("FN_"), "c_custkey").alias("function_name"), F.col("c_mktsegment").alias("function_owner")
    )
    tables = cat.cat_tables(spark, sf).select("table_name", F.col("owner").alias("table_owner"))
    schemas = _t(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("schema"), F.substring("o_orderpriority", 1, 1).cast("int").alias("schema_id")
    ).distinct()
    return inventory.trigger_map(cat.cat_triggers(spark, sf), functions, tables, schemas)


# Keys -------------------------------------------------------------------------------------------------------


def _constraints(spark, sf):
    return cat.cat_constraints(spark, sf), cat.cat_cons_columns(spark, sf)


@query
def pk_columns(spark, sf):
    return keys.pk_columns(*_constraints(spark, sf))


@query
def fk_columns(spark, sf):
    return keys.fk_columns(*_constraints(spark, sf))


@query
def fk_targets(spark, sf):
    return keys.fk_targets(*_constraints(spark, sf))


@query
def fk_grouped(spark, sf):
    return keys.fk_grouped(*_constraints(spark, sf)).withColumns({
        "src_columns": F.array_join("src_columns", ","), "ref_columns": F.array_join("ref_columns", ","),
    })


@query
def key_list_rendered(spark, sf):
    grouped = keys.keys_grouped(keys.pk_columns(*_constraints(spark, sf)))
    return grouped.select("owner", "table_name", key_list(F.col("columns")).alias("key_list"))


QUERIES["key_list"] = QUERIES.pop("key_list_rendered")


@query
def auto_column(spark, sf):
    return keys.auto_columns(cat.cat_columns(spark, sf), keys.pk_columns(*_constraints(spark, sf)))


@query
def seq_next(spark, sf):
    planned = auto_column(spark, sf).select(F.col("owner").alias("sequence_owner"), "sequence_name")
    return sequences.migrated_sequences(planned, cat.cat_sequences(spark, sf))


@query
def seq_actions(spark, sf):
    existing = cat.cat_sequences(spark, sf).select(F.lower("sequence_name").alias("sequence_name"))
    return sequences.sequence_actions(auto_column(spark, sf), existing)


@query
def next_value(spark, sf):
    parts = [
        sequences.next_value(_t(spark, sf, t), c).select(F.lit(t).alias("table_name"), F.col("next_value").cast("bigint"))
        for t, c in NUMBERED.items()
    ]
    empty = sequences.next_value(_t(spark, sf, "orders").where(F.lit(False)), "o_orderkey")
    parts.append(empty.select(F.lit("empty").alias("table_name"), F.col("next_value").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


@query
def seq_assign(spark, sf):
    orders = _t(spark, sf, "orders")
    # One number for the run, as a sequence's current value.
    last = orders.agg(F.max("o_orderkey")).first()[0]
    rows = orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return sequences.assign_keys(rows, ["o_orderdate", "o_orderkey"], "new_key", last)


# Integrity and reconciliation -------------------------------------------------------------------------------


@query
def pk_violations(spark, sf):
    return integrity.pk_violations(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def fk_orphans(spark, sf):
    parents = _filtered(spark, sf, "customer", ColumnFilter("c_acctbal", ">", 0))
    return integrity.fk_orphans(_t(spark, sf, "orders"), ["o_custkey"], parents, ["c_custkey"])


@query
def extract_referential(spark, sf):
    customer = _filtered(spark, sf, "customer", ColumnFilter("c_acctbal", ">", 0))
    orders = integrity.keep_referenced(_t(spark, sf, "orders"), ["o_custkey"], customer, ["c_custkey"])
    return integrity.keep_referenced(_t(spark, sf, "lineitem"), ["l_orderkey"], orders, ["o_orderkey"])


def _closed(spark, sf):
    """Customers above a balance; every sixteenth order follows another one, and every fiftieth customer names one of theirs."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(
        (F.col("o_orderkey") > 3) & (F.col("o_orderkey") % 16 == 0), F.floor(F.col("o_orderkey") / 4)
    ).alias("o_follows"))
    named = orders.where("o_custkey % 50 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("c_order"))
    customer = _filtered(spark, sf, "customer", ColumnFilter("c_acctbal", ">", -900)).select("c_custkey", "c_acctbal")
    customer = customer.join(named.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return closure.referential_closure({"customer": customer, "orders": orders, "lineitem": lines}, [
        closure.Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
        closure.Reference("orders", ("o_follows",), "orders", ("o_orderkey",)),
        closure.Reference("customer", ("c_order",), "orders", ("o_orderkey",)),
        closure.Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ])


@query
def extract_closure(spark, sf):
    """Keys that stay when a reference of a table to itself and a cycle of two tables are closed."""
    kept = _closed(spark, sf).kept
    parts = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")]
    return reduce(DataFrame.unionByName, [kept[t].select(F.lit(t).alias("table_name"), F.col(k).alias("key")) for t, k in parts])


@query
def extract_removed(spark, sf):
    return _closed(spark, sf).removed


@query
def count_rows(spark, sf):
    return reconcile.row_counts({t: _t(spark, sf, t) for t in TABLES})


@query
def recon_counts(spark, sf):
    base = new_work_dir(spark, "recon")
    names = ["customer", "orders", "lineitem"]
    for name in names[:2]:
        load_parquet(extract(_t(spark, sf, name)), f"{base}/{name}")
    load_parquet(_filtered(spark, sf, "lineitem", ColumnFilter("l_returnflag", "LIKE", "R")), f"{base}/lineitem")
    return reconcile.reconcile_counts(
        reconcile.row_counts({n: _t(spark, sf, n) for n in [*names, "part"]}),
        reconcile.row_counts({n: spark.read.parquet(f"{base}/{n}") for n in names}),
    )


@query
def recon_pk(spark, sf):
    # Both sides come from these, so they are looked for once.
    found = stage(keys.pk_columns(*_constraints(spark, sf)).select("owner", "table_name", "column_name"), new_work_dir(spark, "keys"))
    # The target lost the keys of one owner and has another column in those of a second.
    target = found.where("owner <> 'SALES_P'").select(
        "owner", F.lower("table_name").alias("table_name"),
        F.when(F.col("owner") == "SALES_F", F.lit("extra")).otherwise(F.lower("column_name")).alias("column_name"),
    )
    return reconcile.reconcile_pk(found, target)


@query
def recon_fk(spark, sf):
    source = cat.cat_constraints(spark, sf).where("constraint_type = 'R'").select("owner", "table_name", "constraint_name")
    target = source.where("owner <> 'SALES_O'").select("owner", "table_name", F.lower("constraint_name").alias("constraint_name"))
    return reconcile.missing_constraints(source, target)


@query
def recon_sources(spark, sf):
    orders = _t(spark, sf, "orders")
    name = F.concat(F.lit("src_"), "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "FUNCTION").when(F.col("o_orderstatus") == "O", "PROCEDURE").otherwise("TRIGGER")
    table = F.concat(F.lit("customer_"), "o_custkey")
    expected = orders.select(F.upper(name).alias("name"), kind.alias("type"), table.alias("table_name"))
    present = orders.where("o_orderpriority <> '5-LOW'").select(name.alias("name"), kind.alias("type"))
    bound = orders.where("o_orderpriority <> '1-URGENT'").select(name.alias("name"), table.alias("table_name"))
    return reconcile.missing_sources(expected, present, bound)


@query
def recon_content(spark, sf):
    source = _t(spark, sf, "orders")
    price = F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = source.where("o_orderstatus <> 'P'").withColumn("o_totalprice", price)
    added = source.where("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    # The target's names are in lower case, and it lost a column and has one of its own.
    upper = source.withColumnsRenamed({c: c.upper() for c in source.columns})
    target = kept.unionByName(added).drop("o_orderpriority").withColumn("loaded", F.lit(True))
    found = reconcile.reconcile_content(upper, target, ["O_ORDERKEY"])
    return found.withColumnRenamed("O_ORDERKEY", "o_orderkey")


@query
def recon_tree(spark, sf):
    """The content check by hash trees: single keys differ here and there, so most ranges are read once."""
    source = _t(spark, sf, "orders")
    off = F.pmod(F.col("o_orderkey"), F.lit(997))
    price = F.when(off == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    moved = F.when(off == 2, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    target = source.where(off != 0).withColumns({"o_totalprice": price, "o_orderkey": moved})
    return hash_tree.reconcile_tree(source, target, ["o_orderkey"]).rows


@query
def scan_split(spark, sf):
    """A table read range by range of its two-column key: every row comes exactly once."""
    lines = _t(spark, sf, "lineitem")
    parts = key_ranges.key_ranges(lines, ["l_orderkey", "l_linenumber"], 8)
    return reduce(DataFrame.unionByName, [lines.where(parts.between(i, i)) for i in range(len(parts))])


# Conflicts and plan -----------------------------------------------------------------------------------------


def _existing_tables(spark, sf):
    found = cat.cat_tables(spark, sf).where(F.col("owner").isin("SALES_F", "GEO", "SUPPLY"))
    return found.select(F.lower("table_name").alias("table_name"))


def _replaced_tables(spark, sf):
    return cat.cat_tables(spark, sf).where("table_name LIKE 'ORDERS%' OR owner = 'GEO'").select("table_name")


@query
def conflict_tables(spark, sf):
    return conflicts.existing_among(cat.cat_tables(spark, sf), _existing_tables(spark, sf), "table_name")


@query
def conflict_keep(spark, sf):
    return conflicts.drop_unreplaced(
        cat.cat_tables(spark, sf), _existing_tables(spark, sf), _replaced_tables(spark, sf), "table_name"
    )


@query
def conflict_sources(spark, sf):
    lines = cat.source_lines(spark, sf)
    selected = lines.select("owner", F.upper("name").alias("name"), "type").distinct()
    orders = _t(spark, sf, "orders")
    # Triggers exist in the target under another type, so they are no conflict.
    existing = orders.where("o_orderstatus <> 'O'").select(
        F.concat(F.lit("src_"), "o_orderkey").alias("name"), F.lit("function").alias("type")
    )
    return conflicts.existing_sources(selected, existing)


@query
def plan_report(spark, sf):
    return conflicts.plan_report(
        cat.cat_tables(spark, sf), _existing_tables(spark, sf), _replaced_tables(spark, sf), "table_name"
    )


@query
def status_summary(spark, sf):
    orders = _t(spark, sf, "orders")
    status = orders.select(
        F.concat(F.lit("ORDERS_"), "o_orderkey").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked")
        .alias("state"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("CUSTOMER_"), "o_custkey")).alias("blocked_by"),
    )
    return conflicts.status_summary(status)


# Dependencies -----------------------------------------------------------------------------------------------


def _nodes(spark, sf, condition="true"):
    return cat.cat_tables(spark, sf).where(condition).select(F.concat_ws(".", "owner", "table_name").alias("node"))


def _turn_nodes(spark, sf):
    return _t(spark, sf, "conversations").select(F.concat(F.lit("TURN_"), "conv_id", F.lit("_"), "turn").alias("node"))


def _turn_edges(spark, sf):
    later = _t(spark, sf, "conversations").where("turn > 0")
    return later.select(
        F.concat(F.lit("TURN_"), "conv_id", F.lit("_"), "turn").alias("child"),
        F.concat(F.lit("TURN_"), "conv_id", F.lit("_"), F.col("turn") - 1).alias("parent"),
    )


@query
def dep_semi(spark, sf):
    selected = inventory.owned_by(cat.cat_tables(spark, sf), "SALES_F")
    return keys.referenced_tables(cat.cat_constraints(spark, sf), selected)


@query
def dep_sources(spark, sf):
    dependencies = cat.cat_dependencies(spark, sf)
    selected = dependencies.where("owner = 'SALES_F' OR type = 'FUNCTION'").select("owner", "name")
    return inventory.dependency_rows(dependencies, selected, ["PROCEDURE", "FUNCTION", "VIEW", "SEQUENCE"])


@query
def distinct_deps(spark, sf):
    return inventory.distinct_references(cat.cat_dependencies(spark, sf))


@query
def dep_missing(spark, sf):
    edges = keys.fk_edges(cat.cat_constraints(spark, sf), distinct=False)
    return graph.missing_dependencies(edges, _nodes(spark, sf, "owner IN ('SALES_F', 'GEO', 'BUILDING')"))


@query
def dep_closure(spark, sf):
    edges = keys.fk_edges(cat.cat_constraints(spark, sf), distinct=False)
    return graph.dependency_closure(edges, _nodes(spark, sf, "owner = 'SALES_F' AND table_name LIKE 'SHIPMENT%'"))


@query
def dep_levels(spark, sf):
    nodes = _nodes(spark, sf).unionByName(_turn_nodes(spark, sf))
    edges = keys.fk_edges(cat.cat_constraints(spark, sf), distinct=False).unionByName(_turn_edges(spark, sf))
    return graph.dependency_levels(nodes, edges)


@query
def dep_blocked(spark, sf):
    edges = keys.fk_edges(cat.cat_constraints(spark, sf), distinct=False)
    failed = _t(spark, sf, "customer").where("c_acctbal < 0").select(
        F.concat("c_mktsegment", F.lit(".CUSTOMER_"), "c_custkey").alias("node")
    )
    return graph.blocked_by_failure(edges, failed)


@query
def dep_cycles(spark, sf):
    # Returned lines make the supplier depend on the customer, the others the customer on the supplier.
    trade = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    customer, supplier, returned = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey"), F.col("l_returnflag") == "R"
    traded = trade.where("l_returnflag is not null").select(
        F.when(returned, supplier).otherwise(customer).alias("child"), F.when(returned, customer).otherwise(supplier).alias("parent")
    )
    # A conversation the user ends closes a cycle: its first turn depends on its last.
    turns = _t(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))
    closing = last.where("role = 'user'").select(
        F.concat(F.lit("TURN_"), "conv_id", F.lit("_0")).alias("child"),
        F.concat(F.lit("TURN_"), "conv_id", F.lit("_"), "turn").alias("parent"),
    )
    edges = reduce(DataFrame.unionByName, [traded, _turn_edges(spark, sf), closing])
    return graph.dependency_cycles(edges)


@query
def contains_join_texts(spark, sf):
    return contains_join(
        spread(_t(spark, sf, "documents")), _t(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text"
    )


QUERIES["contains_join"] = QUERIES.pop("contains_join_texts")


def _routine_names(spark, sf):
    """Names to look for, with the schema in front unless it is the public one."""
    part, supplier, customer = (_t(spark, sf, t) for t in ("part", "supplier", "customer"))
    other = F.when(F.col("p_size") > 40, "other").otherwise("public")
    named = [
        part.select(other.alias("schema"), F.concat(F.lit("part_"), "p_partkey").alias("name")),
        supplier.select(F.lit("public").alias("schema"), F.concat(F.lit("seq_"), "s_suppkey").alias("name")),
        customer.select(F.lit("public").alias("schema"), F.concat(F.lit("customer_"), "c_custkey").alias("name")),
        _t(spark, sf, "region").select(F.lit("other").alias("schema"), F.lit("dept").alias("name")).distinct(),
    ]
    full = F.when(F.col("schema") != "public", F.concat_ws(".", "schema", "name")).otherwise(F.col("name"))
    return reduce(DataFrame.unionByName, named).select(full.alias("searched"))


@query
def dep_by_text(spark, sf):
    bodies = _bodies(spark, sf).select("name", "body")
    names = _routine_names(spark, sf).withColumn("full_name", F.col("searched"))
    return contains_join(bodies, names, "name", "body", "full_name", "searched")


# Stored code ------------------------------------------------------------------------------------------------


def _bodies(spark, sf):
    return cat.bodies(spark, sf)


def _rule(spark, sf, rules, late=None):
    return code.apply_rules(_bodies(spark, sf), rules, late).select("owner", "name", "type", "body")


@query
def src_assemble(spark, sf):
    return code.assemble(cat.source_lines(spark, sf))


@query
def src_tokens(spark, sf):
    return code.tokens(spread(_t(spark, sf, "documents")), ["doc_id"], "text")


@query
def rw_types(spark, sf):
    return _rule(spark, sf, [R.types])


@query
def rw_pct_type(spark, sf):
    return _rule(spark, sf, [R.pct_type(TARGET_SCHEMA)])


@query
def rw_qualify(spark, sf):
    return _rule(spark, sf, [R.qualify(TARGET_SCHEMA)])


@query
def rw_trigger_rows(spark, sf):
    return _rule(spark, sf, [R.trigger_rows])


@query
def rw_nextval(spark, sf):
    return _rule(spark, sf, [R.nextval])


@query
def rw_params(spark, sf):
    return _rule(spark, sf, [R.params])


@query
def rw_cursor(spark, sf):
    return _rule(spark, sf, [R.cursors])


@query
def rw_pragma(spark, sf):
    return _rule(spark, sf, [R.pragmas])


@query
def rw_raise(spark, sf):
    return _rule(spark, sf, [R.raise_name], [R.raise_call])


@query
def rw_notice(spark, sf):
    return _rule(spark, sf, [], [R.notices])


@query
def rw_sleep(spark, sf):
    return _rule(spark, sf, [R.sleep])


@query
def rw_dual(spark, sf):
    return code.apply_rules(_bodies(spark, sf).where("type = 'TRIGGER'"), [R.drop_dual]).select(
        "owner", "name", "type", "body"
    )


@query
def rw_for_paren(spark, sf):
    return _rule(spark, sf, [R.for_paren])


@query
def rw_loop_record(spark, sf):
    rows = code.masked(_bodies(spark, sf)).withColumn("_code", R.cursors(F.col("_code")))
    return rows.select("owner", "name", "type", R.loop_record(F.col("_code")).alias("declaration"))


@query
def src_untranslatable(spark, sf):
    return code.reads_system_views(_bodies(spark, sf), cat.cat_views(spark, sf))


@query
def src_triage(spark, sf):
    return code.triage(_bodies(spark, sf), cat.cat_views(spark, sf), TARGET_SCHEMA)


@query
def src_quarantine(spark, sf):
    path = new_work_dir(spark, "quarantine")
    code.write_quarantine(code.quarantined(_bodies(spark, sf), cat.cat_views(spark, sf), TARGET_SCHEMA), path)
    schema = "owner string, name string, type string, body string, reason string"
    return spark.read.schema(schema).json(path)


@query
def src_blocked(spark, sf):
    return code.blocked_by_calls(_bodies(spark, sf), cat.cat_views(spark, sf), TARGET_SCHEMA)


def _ready(spark, sf):
    return code.ready(_bodies(spark, sf), cat.cat_views(spark, sf), TARGET_SCHEMA)


@query
def rw_envelope(spark, sf):
    return code.rewrite_routines(_ready(spark, sf), TARGET_SCHEMA)


@query
def rw_trigger(spark, sf):
    return code.rewrite_block_triggers(_ready(spark, sf), TARGET_SCHEMA)


@query
def rw_trigger_call(spark, sf):
    return code.rewrite_call_triggers(_ready(spark, sf), TARGET_SCHEMA)


@query
def trigger_balance(spark, sf):
    return code.trigger_balance(_ready(spark, sf), TARGET_SCHEMA)


@query
def rw_view(spark, sf):
    return code.rewrite_views(cat.cat_views(spark, sf), TARGET_SCHEMA)


# The whole run ----------------------------------------------------------------------------------------------


def table_specs(spark, sf) -> dict[str, TableSpec]:
    """All tables with their keys; customers are filtered, and order lines follow their orders."""
    def fk(column, parent, parent_column):
        return ForeignKey((column,), parent, (parent_column,))

    data = {t: _t(spark, sf, t) for t in TABLES}
    positive = Extraction("custom", (ColumnFilter("c_acctbal", ">", 0),))
    return {
        "region": TableSpec(data["region"], ("r_regionkey",)),
        "nation": TableSpec(data["nation"], ("n_nationkey",), (fk("n_regionkey", "region", "r_regionkey"),)),
        "customer": TableSpec(
            data["customer"], ("c_custkey",), (fk("c_nationkey", "nation", "n_nationkey"),), "c_custkey", positive
        ),
        "supplier": TableSpec(
            data["supplier"], ("s_suppkey",), (fk("s_nationkey", "nation", "n_nationkey"),), "s_suppkey"
        ),
        "part": TableSpec(data["part"], ("p_partkey",), (), "p_partkey"),
        "orders": TableSpec(
            data["orders"], ("o_orderkey",), (fk("o_custkey", "customer", "c_custkey"),), "o_orderkey"
        ),
        "lineitem": TableSpec(
            data["lineitem"], ("l_orderkey", "l_linenumber"),
            (fk("l_orderkey", "orders", "o_orderkey"), fk("l_partkey", "part", "p_partkey"),
             fk("l_suppkey", "supplier", "s_suppkey")),
        ),
        "events": TableSpec(data["events"], ("event_id",), (), "event_id"),
        "documents": TableSpec(data["documents"], ("doc_id",), (), "doc_id"),
        "embeddings": TableSpec(data["embeddings"], ("vec_id",), (), "vec_id"),
        "pages": TableSpec(data["pages"], ("page_id",), (), "page_id"),
        "benchmark": TableSpec(data["benchmark"], ("item_id",), (), "item_id"),
        "labels": TableSpec(data["labels"], ("doc_id",), (fk("doc_id", "documents", "doc_id"),)),
        "conversations": TableSpec(data["conversations"], ("conv_id", "turn")),
    }


@query
def migrate_report(spark, sf):
    """Filtered customers without referential closure: the report names the orphan orders."""
    return migrate(spark, table_specs(spark, sf), new_work_dir(spark, "target"))


@query
def migrate_referential(spark, sf):
    """The same with referential closure: orders and lines of dropped customers stay behind."""
    return migrate(spark, table_specs(spark, sf), new_work_dir(spark, "target"), referential=True)


@query
def script_full(spark, sf):
    """One script of all tables, sequences and stored code: how many lines each of its parts has."""
    path = new_work_dir(spark, "script")
    emitted = code.rewrite_all(_bodies(spark, sf), cat.cat_views(spark, sf), TARGET_SCHEMA)
    emitted = stage(emitted.select("target_type", "script"), new_work_dir(spark, "emitted-code"))
    whole_script.write_whole_script(spark, table_specs(spark, sf), path, TARGET_SCHEMA, emitted)
    return whole_script.read_script(spark, path).groupBy("section", "name").agg(F.count(F.lit(1)).alias("n_lines"))
