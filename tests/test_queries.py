import pytest

from nearfield.plans import reference_queries


@pytest.mark.parametrize("name", sorted(reference_queries.ORACLES))
def test_query_equals_sql(name, same):
    same(reference_queries.QUERIES[name], reference_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(reference_queries.QUERIES) - set(reference_queries.ORACLES)))
def test_other_queries_have_rows(name, spark, sf_dir):
    assert reference_queries.QUERIES[name](spark, sf_dir).count() > 0
