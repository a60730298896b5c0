"""Registered queries against their SQL counterparts."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from recollect.operators.staging import stage
from recollect.plans import queries
from recollect.plans import views as V
from recollect.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_counterpart_belongs_to_a_query():
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() - ORACLE.keys() == {"baseline_score"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1308


@pytest.fixture(scope="module")
def stored_views(spark):
    """The views written once and read back by every query, to keep the run short."""
    memo = {}

    def stored(view):
        def read(session, sf, *args):
            key = (view.__name__, sf, args)
            if key not in memo:
                memo[key] = stage(view(session, sf, *args), view.__name__)
            return memo[key]
        return read

    patch = pytest.MonkeyPatch()
    for name in ("users", "samples", "items"):
        patch.setattr(V, name, stored(getattr(V, name)))
    patch.setattr(queries, "stored_users", lambda session, sf: V.users(session, sf))
    yield
    patch.undo()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, stored_views, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    assert differences(got, duck.execute(ORACLE[name]).df()) is None
