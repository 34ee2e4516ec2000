"""Every registered query against its SQL; those without SQL against what must hold."""

import pytest

from compare import connection, same_rows
from conftest import SMALL
from matchbook.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"logo_logistic"}))
def test_reruns_agree(spark, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_optimal_beats_greedy(spark):
    from pyspark.sql import functions as F

    from matchbook.plans.analytics import _slot_costs

    best = QUERIES["optimal_controls"](spark, SMALL)
    assert best.groupBy("slot").count().where("count > 1").isEmpty()
    assert best.groupBy("candidate").count().where("count > 1").isEmpty()
    greedy = QUERIES["greedy_one_to_one"](spark, SMALL).join(_slot_costs(spark, SMALL), ["slot", "candidate"])
    # as many or more slots are served; with as many, at no higher cost
    a, b = best.agg(F.count("*"), F.sum("cost")).first(), greedy.agg(F.count("*"), F.sum("cost")).first()
    assert (a[0], -a[1]) >= (b[0], -b[1])
