"""Queries of the subpackage that have SQL, against it; and that each of its queries runs on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from tidelog.llm import queries

COLUMNS = {
    "p2_found": [("lifelog_id", "string"), ("turn_no", "bigint"), ("first_node_id", "bigint"), ("last_node_id", "bigint")],
    "p3_found": [("field", "string"), ("record_key", "string"), ("pii_kind", "string"), ("start_pos", "bigint")],
    "p4_found": [("name_a", "string"), ("name_b", "string")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("item_id", "bigint"), ("doc_id", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.dtypes == COLUMNS.get(name, df.dtypes)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
