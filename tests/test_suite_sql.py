"""Every registered query against its SQL in another engine."""

from collections import Counter

import pytest

from conftest import SF

from portage.plans.suite import QUERIES
from portage.plans.suite_sql import ORACLE_SQL


def normal(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(normal(v) for v in row) for row in df.select(*columns).collect())
    duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(normal(row[i]) for i in order) for row in duck.fetchall())
    assert ours == theirs
