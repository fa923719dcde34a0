"""Every query that SQL can say, against DuckDB."""

import pytest

from millrace.functions import queries as functions
from millrace.operators import queries as operators
from millrace.plans import queries as plans
from millrace.sources import queries as sources
from millrace.streaming import queries as streaming
from tests.oracle import FOLDER, database, same

CASES = [(m, n) for m in (operators, functions, plans, sources, streaming) for n in m.oracle_sql()]


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_same_as_sql(spark, db, module, name):
    same(spark, db, module.queries()[name], module.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in plans.oracle_sql()])
def test_kernels_run(spark, name):
    assert plans.queries()[name](spark, FOLDER).count() > 0
