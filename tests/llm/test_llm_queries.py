"""The registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF

from portage.llm.oracle import ORACLE_SQL
from portage.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(map(tuple, df.select(columns).collect()))
    duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    assert ours == Counter(tuple(row[names.index(c)] for c in columns) for row in duck.fetchall())


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
