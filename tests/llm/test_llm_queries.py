import pytest
from compare import differences

from reactionloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, duck, data):
    assert not differences(QUERIES[name](spark, data), duck, ORACLE[name])


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p6_round_trip", "p7_pieces"])
def test_query_gives_distinct_rows(name, spark, data):
    rows = QUERIES[name](spark, data).collect()
    assert rows and len(set(rows)) == len(rows)
    if name == "p6_round_trip":
        assert all(r["same"] for r in rows)
