"""Every core query against its SQL; those without SQL have to run."""

import pytest

from noteweave.plans import registry
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = spark_rows(df)
    if name in registry.ORACLE:
        assert rows == sql_rows(duck, registry.ORACLE[name], sorted(df.columns))


def test_names_do_not_clash():
    assert len(registry.QUERIES) == sum(len(p.QUERIES) for p in registry.PARTS)
    assert set(registry.ORACLE) <= set(registry.QUERIES)
