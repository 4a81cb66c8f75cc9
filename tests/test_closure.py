"""Referential closure against plain Python: rows without a parent are taken away until nothing changes."""

import random

import pytest

from portage.operators.closure import Reference, referential_closure
from portage.plans.migrate import ForeignKey, TableSpec, migrate


def plain(tables, references):
    """Rows by index that stay, for tables as lists of dicts."""
    kept = {t: set(range(len(rows))) for t, rows in tables.items()}
    while True:
        drop = {
            (r.child, i)
            for r in references for i in kept[r.child]
            if None not in (key := tuple(tables[r.child][i][c] for c in r.columns))
            and key not in {tuple(tables[r.parent][j][c] for c in r.parent_columns) for j in kept[r.parent]}
        }
        if not drop:
            return kept
        for t, i in drop:
            kept[t].discard(i)


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_python(spark, seed):
    draw = random.Random(seed)
    pick = lambda n: draw.choice([None, *range(n)])
    tables = {
        "a": [{"id": i, "boss": pick(45), "b_id": pick(40) if draw.random() < 0.5 else None, "n": i} for i in range(40)],
        "b": [{"id": draw.randrange(45), "a_id": pick(42), "x": pick(6), "y": pick(6), "n": i} for i in range(60)],
        "c": [{"x": pick(6), "y": pick(6), "n": i} for i in range(25)],
    }
    references = [
        Reference("a", ("boss",), "a", ("id",)), Reference("a", ("b_id",), "b", ("id",)), Reference("b", ("a_id",), "a", ("id",)),
        Reference("b", ("x", "y"), "c", ("x", "y")), Reference("c", ("x",), "elsewhere", ("x",)),
    ]
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} int" for c in rows[0])) for t, rows in tables.items()}
    found = referential_closure(frames, references)
    expected = plain(tables, references[:4])
    for t in tables:
        assert sorted(r.n for r in found.kept[t].collect()) == sorted(expected[t])
        assert found.kept[t].columns == frames[t].columns
    totals = {r.table_name: r.n_rows for r in found.removed.where("reference is null").collect()}
    assert totals == {t: len(tables[t]) - len(expected[t]) for t in tables if len(tables[t]) > len(expected[t])}
    for r in found.removed.where("reference is not null").collect():
        ref = next(x for x in references if x.name == r.reference)
        left = {tuple(tables[ref.parent][j][c] for c in ref.parent_columns) for j in expected[ref.parent]}
        keys = [tuple(row[c] for c in ref.columns) for row in tables[ref.child]]
        assert r.n_rows == sum(None not in k and k not in left for k in keys)


def test_a_chain_falls_link_by_link_and_a_loop_stays(spark):
    rows = [(i, i - 1) for i in range(1, 9)] + [(20, 21), (21, 20), (30, 30), (40, None)]
    people = spark.createDataFrame(rows, "id int, boss int")
    found = referential_closure({"people": people}, [Reference("people", ("boss",), "people", ("id",))])
    assert sorted(r.id for r in found.kept["people"].collect()) == [20, 21, 30, 40]
    assert found.rounds == 8


def test_a_parent_key_that_repeats_goes_with_its_last_row(spark):
    parents = spark.createDataFrame([(1, None), (1, 7), (2, 7), (2, 8)], "code int, other int")
    children = spark.createDataFrame([(1,), (2,), (None,)], "code int")
    others = spark.createDataFrame([(5,)], "other int")
    found = referential_closure({"p": parents, "c": children, "o": others}, [
        Reference("p", ("other",), "o", ("other",)), Reference("c", ("code",), "p", ("code",)),
    ])
    assert [tuple(r) for r in found.kept["p"].collect()] == [(1, None)]
    assert sorted((r.code or 0) for r in found.kept["c"].collect()) == [0, 1]


def test_nothing_to_remove_and_empty_tables(spark):
    people = spark.createDataFrame([(1, None), (2, 1)], "id int, boss int")
    boss = Reference("people", ("boss",), "people", ("id",))
    found = referential_closure({"people": people}, [boss])
    assert found.rounds == 0 and found.kept["people"] is people and found.removed.isEmpty()
    assert referential_closure({"people": people.limit(0)}, [boss]).kept["people"].isEmpty()
    assert referential_closure({"people": people}, []).kept["people"] is people
    gone = referential_closure({"people": people, "none": people.limit(0)}, [Reference("people", ("boss",), "none", ("id",))])
    assert [r.id for r in gone.kept["people"].collect()] == [1]


def test_referential_run_leaves_no_orphans_of_its_own_key(spark, tmp_path):
    people = spark.createDataFrame([(1, None), (2, 99), (3, 2), (4, 1)], "id int, boss int")
    tasks = spark.createDataFrame([(1, 4), (2, 3), (3, None)], "task int, owner int")
    report = migrate(spark, {
        "people": TableSpec(people, ("id",), (ForeignKey(("boss",), "people", ("id",)),)),
        "tasks": TableSpec(tasks, ("task",), (ForeignKey(("owner",), "people", ("id",)),)),
    }, f"{tmp_path}/out", referential=True, log_path=f"{tmp_path}/log")
    assert {r.table_name: (r.state, r.rows_out, r.fk_orphan_rows) for r in report.collect()} == {
        "people": ("done", 2, 0), "tasks": ("done", 2, 0),
    }
    log = " ".join(str(r) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert "2 rows without a parent: people(boss) -> people(id)" in log and "1 rows without a parent: tasks(owner)" in log
