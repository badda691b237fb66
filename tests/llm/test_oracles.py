import pytest

from noticelake.llm import queries
from tests.check import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, con, sf, name):
    assert compare(con, queries.QUERIES[name](spark, sf), queries.ORACLE[name]) is None
