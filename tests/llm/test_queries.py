"""Every query of the training-data problems; those with SQL against it."""

import pytest

from noteweave.llm import queries
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA

COLUMNS = {"p1_found": ["hub_id", "typed_id"], "p3_found": ["row_id", "tbl"], "p4_found": ["b_hi", "b_lo"], "p5_found": ["doc_id", "kind"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind", "line_no"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = spark_rows(df)
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in queries.ORACLE:
        assert rows == sql_rows(duck, queries.ORACLE[name], sorted(df.columns))
