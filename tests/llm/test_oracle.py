"""Queries that SQL can express, against DuckDB on whole tables."""

import pytest

pytest.importorskip("chronolith.llm.queries")
from chronolith.llm import queries  # noqa: E402

from ..conftest import SF, same_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).fetchdf())
